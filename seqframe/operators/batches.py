"""Loader batches and collation (C5: T4, W7, F12-F14, X3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import next_token_x, nonzero_mask, pad_right, stop_appended
from ..functions.random import hash_order
from .ranking import md5_bucket, prefix_rank


def assign_batches(df: DataFrame, id_col: str, batch_size: int = 64, seed: int = 0, epoch: int = 0) -> DataFrame:
    """T4: per-epoch seeded shuffle (md5 of ``seed|epoch|id``) cut into
    consecutive batches; adds ``batch_id`` and ``row`` (position in batch)."""
    d = df.withColumn("_h", hash_order(F.lit(seed), F.lit(epoch), F.col(id_col)))
    r = prefix_rank(d, md5_bucket("_h"), [F.col("_h"), F.col(id_col)], rank_col="_r")
    return (r.withColumn("batch_id", F.floor((F.col("_r") - 1) / batch_size).cast("long"))
             .withColumn("row", F.pmod(F.col("_r") - 1, F.lit(batch_size)).cast("int"))
             .drop("_h", "_r", "total_n"))


def collate(df: DataFrame, batch_col: str, seq_col: str = "sequence", tags_col: str = "conditioning_tags",
            mode: str = "separate") -> DataFrame:
    """Pad rows to their batch maximum (W7, a window max per batch).

    * ``separate``      - F12: ``sequence``, ``conditioning_tags`` padded with 0
    * ``next_token``    - F13: ``x_seq = [22]+seq``, ``y_seq = seq+[22]``, masks
    * ``stop_appended`` - F14: ``sequence = seq+[22]`` padded, ``tag_mask``
    """
    # W7 as an aggregate + equi-join rather than a window: the per-batch
    # maxima are partially aggregated, and a hot batch key on the join is
    # split by AQE's skew-join handling instead of landing in one task.
    m = df.groupBy(batch_col).agg(F.max(F.size(F.col(seq_col))).alias("_m"),
                                  F.max(F.size(F.col(tags_col))).alias("_tm"))
    d = df.join(m, batch_col).withColumn("sequence_lengths", F.size(F.col(seq_col)))
    d = d.withColumn("_ptags", pad_right(F.col(tags_col), F.col("_tm")))
    if mode == "separate":
        out = d.withColumn("_seq", pad_right(F.col(seq_col), F.col("_m")))
    elif mode == "next_token":
        y = stop_appended(F.col(seq_col), F.col("_m"))
        out = (d.withColumn("x_seq", next_token_x(F.col(seq_col), F.col("_m")))
                .withColumn("y_seq", y).withColumn("seq_mask", nonzero_mask(F.col("y_seq"))))
    elif mode == "stop_appended":
        out = d.withColumn("_seq", stop_appended(F.col(seq_col), F.col("_m")))
    else:
        raise ValueError(f"unknown collate mode {mode!r}")
    if "_seq" in out.columns:
        out = out.drop(seq_col).withColumnRenamed("_seq", "sequence")
    out = out.drop(tags_col).withColumnRenamed("_ptags", "conditioning_tags")
    out = out.withColumn("tag_mask", nonzero_mask(F.col("conditioning_tags")))
    return out.drop("_m", "_tm")
