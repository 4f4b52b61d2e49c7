"""Vector functions as Columns, in double precision, adding from the first component to the last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument

__all__ = ["as_doubles", "cosine_distance", "distance", "dot_product", "euclidean_distance", "euclidean_distance_sq", "neg_dot", "normalize", "recall_at_k", "validate_recall_score", "vector_norm"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), term), F.lit(0.0), lambda acc, x: acc + x)


def euclidean_distance_sq(a: Column | str, b: Column | str) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(euclidean_distance_sq(a, b))


def dot_product(a: Column | str, b: Column | str) -> Column:
    """The plain product: larger is closer. Rank by ``neg_dot``."""
    return _fold(a, b, lambda x, y: x * y)


def neg_dot(a: Column | str, b: Column | str) -> Column:
    return -dot_product(a, b)


def vector_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """From 0 to 2; 1 if either vector is zero."""
    both = vector_norm(a) * vector_norm(b)
    return F.when(both == 0, 1.0).otherwise(1.0 - dot_product(a, b) / F.when(both == 0, 1.0).otherwise(both))


def normalize(v: Column | str) -> Column:
    """Scaled to length one; a zero vector stays."""
    norm = vector_norm(v)
    return F.transform(as_doubles(v), lambda x: F.when(norm > 0, x / F.when(norm > 0, norm).otherwise(1.0)).otherwise(x))


_METRICS = {"l2sq": euclidean_distance_sq, "l2": euclidean_distance, "dot": dot_product, "neg_dot": neg_dot, "cosine": cosine_distance}


def distance(a: Column | str, b: Column | str, metric: str = "l2sq", check: bool = True) -> Column:
    """The named distance; vectors of different lengths raise an error."""
    if metric not in _METRICS:
        raise InvalidArgument(f"unknown metric {metric!r}; known: {', '.join(_METRICS)}")
    value = _METRICS[metric](a, b)
    if not check:
        return value
    same = F.size(_col(a)) == F.size(_col(b))
    return F.when(same, value).otherwise(F.raise_error(F.lit("vector dimension mismatch")).cast("double"))


def recall_at_k(truth: Column | str, found: Column | str) -> Column:
    """Share of the distinct true ids that were found; no truth raises an error."""
    truth = F.array_distinct(_col(truth))
    share = F.size(F.array_intersect(truth, _col(found))) / F.size(truth)
    return F.when(F.size(truth) > 0, share).otherwise(F.raise_error(F.lit("recall needs at least one true id")).cast("double"))


def validate_recall_score(score: Column | str) -> Column:
    """'ok', 'not_finite' or 'out_of_range'."""
    s = _col(score).cast("double")
    odd = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return F.when(odd, "not_finite").when((s < 0) | (s > 1), "out_of_range").otherwise("ok")
