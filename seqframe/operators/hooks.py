"""User functions over groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_aggregate(df: DataFrame, keys: Sequence[str], col: str, fn: Callable[[pd.Series], object], return_type: str,
                      max_rows: int = 1_000_000, out_col: str = "value") -> DataFrame:
    """``(keys..., out_col, n)``: ``fn`` of the values of ``col`` of each group, as a pandas Series without a set order.

    A group is held by one task, so groups are counted first (partial counts, one row a group and task) and one of more
    than ``max_rows`` rows raises; nothing is left out.  A function that can be put together from parts belongs
    into built-in aggregates instead."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most > max_rows:
        raise ValueError(f"a group has {most} rows; the function takes at most {max_rows}")

    @F.pandas_udf(return_type)
    def call(values: pd.Series) -> object:
        return fn(values)

    # Spark takes either pandas or built-in aggregates in one agg
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    return df.groupBy(*keys).agg(call(F.col(col)).alias(out_col)).join(counts.withColumnsRenamed({k: f"{k}_of" for k in keys}), same).drop(*[f"{k}_of" for k in keys])
