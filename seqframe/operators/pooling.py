"""Pooling of token vectors into row vectors (C11: A16, A17) and batched
model inference over a column (X4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long(df: DataFrame, group_col: str, vec_col: str, mask_col: str | None) -> DataFrame:
    cols = [F.col(group_col)]
    if mask_col:
        cols.append(F.col(mask_col))
    return df.select(*cols, F.posexplode(F.col(vec_col)).alias("dim", "_x"))


def mean_pool(df: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """``(group, dim, value)`` mean over all positions of a group
    (padding included, as in the reference).  Vectors are exploded to
    (dim, value) and averaged with partial aggregation, so a group of any
    size is never gathered in one place."""
    return (_long(df, group_col, vec_col, None).groupBy(group_col, "dim")
            .agg(F.avg(F.col("_x").cast("double")).alias("value")))


def masked_mean_pool(df: DataFrame, group_col: str, vec_col: str, mask_col: str) -> DataFrame:
    """Sum over unmasked positions / count of unmasked positions."""
    long = _long(df, group_col, vec_col, mask_col).where(F.col(mask_col))
    return long.groupBy(group_col, "dim").agg(F.avg(F.col("_x").cast("double")).alias("value"))


def to_vectors(pooled: DataFrame, group_col: str, out_col: str = "embedding") -> DataFrame:
    """``(group, dim, value)`` -> ``(group, array)``; a group holds exactly one
    entry per dimension, so the regroup is bounded by the vector width."""
    return (pooled.groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_p"))
            .select(group_col, F.transform("_p", lambda s: s["value"]).alias(out_col)))


def embed(df: DataFrame, text_col: str, make_model: Callable, dim: int, batch_size: int = 32,
          out_col: str = "embedding", element_type: str = "float") -> DataFrame:
    """Run a user model over a string column in Arrow batches on the
    executors (``predict_batch_udf``).  ``make_model()`` is called once per
    Python worker and returns ``f(np.ndarray[str]) -> np.ndarray[n, dim]``."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType, FloatType

    elem = DoubleType() if element_type == "double" else FloatType()
    udf = predict_batch_udf(make_model, return_type=ArrayType(elem), batch_size=batch_size)
    return df.withColumn(out_col, udf(F.col(text_col)))
