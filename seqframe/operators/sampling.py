"""Top-k, temperature-weighted sampling over a candidate table (T5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import gumbel


def topk_sample(df: DataFrame, group_col: str, token_col: str, logit_col: str, k: int = 1,
                temperature: float = 1.0, seed: int = 0, step: int = 0) -> DataFrame:
    """``(group, token)``: keep the k highest logits per group (ties by token;
    Spark plans a partial ``WindowGroupLimit`` before the shuffle), then draw
    one by Gumbel-max on ``logit / T`` with a hash draw per (seed, step,
    group, token).  k = 1 is the argmax.  Returns the token itself (Q8)."""
    w = Window.partitionBy(group_col).orderBy(F.col(logit_col).desc(), F.col(token_col))
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    if k == 1:
        return top.select(group_col, token_col)
    score = F.col(logit_col) / F.lit(float(temperature)) + gumbel(F.lit(seed), F.lit(step), F.col(group_col),
                                                                  F.col(token_col))
    return (top.withColumn("_s", score).groupBy(group_col)
            .agg(F.max_by(F.col(token_col), F.struct(F.col("_s"), F.col(token_col))).alias(token_col)))
