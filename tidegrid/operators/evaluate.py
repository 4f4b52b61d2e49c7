"""Recall and latency evaluation."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.vectors import recall_at_k
from .knn import knn_batch


def recall_per_query(truth: DataFrame, found: DataFrame, id_col: str = "vector_id") -> DataFrame:
    """query_id, recall: share of the true ids that were found; queries without hits have 0."""
    t = truth.groupBy("query_id").agg(F.collect_set(id_col).alias("t"))
    f = found.groupBy("query_id").agg(F.collect_set(id_col).alias("f"))
    both = t.join(f, "query_id", "left")
    none = F.array().cast(dict(t.dtypes)["t"])
    return both.select("query_id", recall_at_k("t", F.coalesce("f", none)).alias("recall"))


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: per name the element at rank ceil(share * n); 0 without values."""
    made = [F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {column})"), F.lit(0.0)).alias(n) for n, p in shares.items()]
    return values.agg(*made)


def recall_stats(recalls: DataFrame) -> DataFrame:
    """One row: min, mean and nearest-rank p95; zeros without queries."""
    zero = F.lit(0.0)
    return recalls.agg(
        F.coalesce(F.min("recall"), zero).alias("min"),
        F.coalesce(F.avg("recall"), zero).alias("mean"),
        F.coalesce(F.expr("percentile_disc(0.95) within group (order by recall)"), zero).alias("p95"),
    )


def spikes(series: DataFrame, n: str, value: str, threshold: float, key: str | None = None) -> DataFrame:
    """Rows at which the value is more than the threshold above the row before, within each key's series."""
    before = F.lag(value).over((W.partitionBy(key) if key else W).orderBy(n))
    return series.withColumn("jump", F.col(value) - before).where(F.col("jump") > threshold)


MARK = b"MWGT"  # fixed value: the cache format's first four bytes


def truth_bytes(ids: np.ndarray, n_base: int) -> bytes:
    """The cache format of ground truth: a mark, three counts and the ids, little-endian."""
    ids = np.asarray(ids, "<u8")
    return MARK + struct.pack("<QQQ", n_base, *ids.shape) + ids.tobytes()


def truth_ids(raw: bytes, n_base: int, n_queries: int, k: int) -> np.ndarray | None:
    """The cached ids; None if the cache is of something else."""
    if raw[:4] != MARK or len(raw) < 28:
        return None
    if struct.unpack("<QQQ", raw[4:28]) != (n_base, n_queries, k) or len(raw) != 28 + 8 * n_queries * k:
        return None
    return np.frombuffer(raw, "<u8", offset=28).reshape(n_queries, k)


def ground_truth(corpus: DataFrame, queries: DataFrame, k: int, path: str) -> np.ndarray:
    """The ids of each query's k nearest, queries by id: from the cache file if it is of these counts, else computed and cached."""
    from ..sources.vecs import open_files

    n_base, n_queries = corpus.count(), queries.count()
    fs, at = open_files(path)
    if fs.get_file_info(at).is_file:
        with fs.open_input_file(at) as f:
            if (held := truth_ids(f.read(), n_base, n_queries, min(k, n_base))) is not None:
                return held
    rows = knn_batch(corpus, queries, k).orderBy("query_id", "rank").select("vector_id").toPandas()  # k ids a query
    ids = rows["vector_id"].to_numpy().reshape(n_queries, -1)
    with fs.open_output_stream(f"{at}.tmp") as f:
        f.write(truth_bytes(ids, n_base))
    fs.move(f"{at}.tmp", at)
    return ids


def series_summary(series: DataFrame, n: str, value: str, key: str | None = None) -> DataFrame:
    """Per key the first, last, least and greatest value of a series, and its growth from first to last."""
    first, last = F.min_by(value, n), F.max_by(value, n)
    made = [first.alias("first"), last.alias("last"), F.min(value).alias("least"), F.max(value).alias("peak"), (last - first).alias("growth")]
    return series.groupBy(*([key] if key else [])).agg(*made)


def resident_bytes() -> tuple[int, int]:
    """This process's memory in use now and at most."""
    with open("/proc/self/status") as f:
        found = {k: int(v.split()[0]) << 10 for k, v in (line.split(":", 1) for line in f) if k in ("VmRSS", "VmHWM")}
    return found["VmRSS"], found["VmHWM"]


def require_recall(found: float, least: float) -> float:
    if found < least:
        raise InvalidArgument(f"recall {found} is below {least}")
    return found
