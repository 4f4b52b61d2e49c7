"""Names, packed ids, sizes and levels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _col

__all__ = [
    "bucket_name", "bucket_number", "estimate_memory_bytes", "geometric_level", "internal_id", "internal_position", "node_id", "node_position",
    "payload_crc32", "penalised_score", "snapshot_name", "snapshot_number", "vectors_per_block", "wal_name", "wal_number",
]

OFFSET_BITS, ALIGN_BITS, MAX_LEVEL = 18, 3, 32


def node_id(block: Column | str, offset: Column | str) -> Column:
    """A 32-bit address: 14 bits of block, 18 bits of the offset in units of 8 bytes."""
    return F.shiftleft(_col(block).cast("long"), OFFSET_BITS).bitwiseOR(F.shiftright(_col(offset).cast("long"), ALIGN_BITS))


def node_position(node: Column | str) -> tuple[Column, Column]:
    """(block, offset) of an address."""
    n = _col(node).cast("long")
    return F.shiftrightunsigned(n, OFFSET_BITS), F.shiftleft(n.bitwiseAND((1 << OFFSET_BITS) - 1), ALIGN_BITS)


def internal_id(block: Column | str, row: Column | str, per_block: int) -> Column:
    return (_col(block).cast("long") * per_block + _col(row)).cast("long")


def internal_position(internal: Column | str, per_block: int) -> tuple[Column, Column]:
    n = _col(internal).cast("long")
    return F.floor(n / per_block), F.pmod(n, F.lit(per_block))


def vectors_per_block(limit_bytes: Column | str, dim: Column | str) -> Column:
    """How many vectors with their 8-byte ids fit."""
    return F.floor(_col(limit_bytes) / (_col(dim) * 4 + 8)).cast("long")


def estimate_memory_bytes(dim: Column | str, m: Column | str, m_max0: Column | str, level: Column | str) -> Column:
    """Bytes of a graph node: its vector, aligned to 8, and its edge slots."""
    vector = F.floor((_col(dim) * 4 + 7) / 8) * 8
    return (vector + (_col(m_max0) + _col(level) * _col(m)) * 4).cast("long")


def geometric_level(uniform: Column | str, m: int) -> Column:
    """floor(-ln(u) / ln(m)), from 0 to 32."""
    raw = F.floor(-F.ln(_col(uniform)) / F.lit(math.log(m)))
    return F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), raw)).cast("int")


def penalised_score(dist: Column | str, degree: Column | str, cap: Column | str, penalty: float = 0.8) -> Column:
    """Distance made longer for neighbours whose edge slots are filling up."""
    return _col(dist) * (1 + penalty * _col(degree) / _col(cap))


def payload_crc32(payload: Column | str) -> Column:
    return F.crc32(_col(payload))


def wal_name(seq: Column | str) -> Column:
    return F.concat(F.lpad(_col(seq).cast("string"), 20, "0"), F.lit(".wal"))


def wal_number(name: Column | str) -> Column:
    return _number(name, r"(?:^|/)([0-9]+)\.wal$")


def bucket_name(seq: Column | str) -> Column:
    return F.concat(F.lit("seq_"), _col(seq).cast("string"))


def bucket_number(name: Column | str) -> Column:
    return _number(name, r"(?:^|/)seq_([0-9]+)$")


def snapshot_name(millis: Column | str) -> Column:
    return F.concat(F.lit("snap_"), _col(millis).cast("string"))


def snapshot_number(name: Column | str) -> Column:
    return _number(name, r"(?:^|/)snap_([0-9]+)$")


def _number(name: Column | str, pattern: str) -> Column:
    digits = F.regexp_extract(_col(name), pattern, 1)
    return F.when(digits != "", digits).cast("long")
