"""The queries of this package, by name, and their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

#: name -> module; a module has ``query(spark, sf_dir)`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_passages": "passages",
    "op2_toxicity": "toxicity",
    "op3_vptree_neighbours": "vptree",
    "op4_ngram_jaccard": "jaccard",
    "op5_quality": "quality",
    "op6_chat_format": "chat",
    "op7_decontaminate": "decontaminate",
    "op8_pii": "pii",
    "op9_line_dedup": "lines",
    "op10_pack": "pack",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}
