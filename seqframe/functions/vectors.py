"""Vector expressions in float64 (F22, J9, A16/A17 in-row forms)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_l2(a, b) -> Column:
    """sum((a_i - b_i)^2) in double; direct form, no negative values."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_distance(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def l2_norm(a) -> Column:
    sq = F.transform(_col(a), lambda x: F.pow(x.cast("double"), 2))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def in_ball(center, radius, subject) -> Column:
    """Subject strictly inside the ball around center."""
    return l2_distance(center, subject) < _col(radius)


def to_double_array(a) -> Column:
    return F.transform(_col(a), lambda x: x.cast("double"))
