"""Dictionaries: indexing by descending count (W4) and value->index lookup
(J3).  A dictionary is ``(value string, count long, idx int)``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import key_bucket, prefix_rank

#: A dictionary of at most so many values goes to each task whole, and lists are mapped within their rows.
HELD_VALUES = 1 << 18

ROOT_SENTINEL = -1  # count given to an appended 'root' so it sorts last


def index_by_count(counts: DataFrame, start: int = 1, nbuckets: int = 16) -> DataFrame:
    """``idx`` = position in (count desc, value asc) order + start - 1.
    The rank uses buckets of the whole key (count, value), so no single task
    sorts all of it, however many values share a count."""
    bucket = key_bucket(counts, [("count", True), ("value", False)], nbuckets)
    r = prefix_rank(counts, bucket, [F.col("count").desc(), F.col("value")], rank_col="_r")
    return r.select("value", "count", (F.col("_r") + F.lit(start - 1)).cast("int").alias("idx"))


def _with_root(kept_counts: DataFrame, root: str) -> DataFrame:
    """Append ``root`` (sorting last) when it was not itself frequent (Q16)."""
    spark = kept_counts.sparkSession
    missing = (spark.createDataFrame([(root,)], "value string")
               .join(kept_counts.select("value"), "value", "left_anti")
               .withColumn("count", F.lit(ROOT_SENTINEL).cast("long")))
    return kept_counts.select("value", F.col("count").cast("long")).unionByName(missing)


def category_dictionary(kept_counts: DataFrame, root: str = "root") -> DataFrame:
    """Category ids 1..T in (count desc, value) order, ``root`` last if added."""
    d = index_by_count(_with_root(kept_counts, root), start=1)
    return d.withColumn("count", F.when(F.col("count") == ROOT_SENTINEL, None).otherwise(F.col("count")))


def conditioning_dictionary(category_counts: DataFrame, tag_counts: DataFrame, root: str = "root",
                            compat_overlap: bool = False, nbuckets: int = 16) -> DataFrame:
    """One id space for categories and tags: ``(kind, value, count, idx)``.

    Categories take 1..T (``root`` appended last if missing); tags follow at
    T+1.. - or at T.. with ``compat_overlap``, reproducing the reference's
    shared id between the last category and the first tag (Q3).  Both kinds
    are ranked in one bucketed pass ordered by (kind, count desc, value), so
    T never has to travel through the driver."""
    cats = _with_root(category_counts, root).withColumn("kind", F.lit(0))
    tags = tag_counts.select("value", F.col("count").cast("long")).withColumn("kind", F.lit(1))
    both = cats.unionByName(tags)
    bucket = key_bucket(both, [("kind", False), ("count", True), ("value", False)], nbuckets)
    r = prefix_rank(both, bucket, [F.col("kind"), F.col("count").desc(), F.col("value")], rank_col="_r")
    shift = F.when((F.col("kind") == 1) & F.lit(compat_overlap), F.lit(1)).otherwise(F.lit(0))
    return r.select(
        F.when(F.col("kind") == 0, "category").otherwise("tag").alias("kind"),
        "value",
        F.when(F.col("count") == ROOT_SENTINEL, None).otherwise(F.col("count")).alias("count"),
        (F.col("_r") - shift).cast("int").alias("idx"),
    )


def has_unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null or occurs twice; shuffles nothing but ids."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("different")).first()
    return r["n"] == r["different"]


def list_mapping(dictionary: DataFrame, out: str = "idx", strict: bool = False) -> Callable[[Column], Column] | None:
    """What maps the elements of a list within its row to the dictionary's ``out``, order kept; unknown ones are dropped, or raise
    if ``strict``, and a null list gives an empty one.  None for a dictionary of more than ``HELD_VALUES`` values or with a
    value that occurs twice: that takes a join."""
    rows = (dictionary.where(F.col("value").isNotNull()).select("value", F.col(out).alias("out"))
            .limit(HELD_VALUES + 1).toArrow().combine_chunks())
    values, outs = (rows[c].chunk(0) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("value", "out"))
    if len(values) > HELD_VALUES or pc.count_distinct(values).as_py() < len(values):
        return None

    def mapped(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        at = pc.index_in(flat, value_set=values.cast(flat.type))
        if strict and at.null_count:
            raise ValueError(f"unknown dictionary value: {flat.filter(at.is_null())[0].as_py()}")
        known = np.concatenate(([0], np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        return pa.ListArray.from_arrays(pa.array(known[np.concatenate(([0], ends)).astype(np.int64)], pa.int32()), outs.take(at.drop_null()))

    # not deterministic for Spark, which would work it out again for a filter on the result
    return F.arrow_udf(mapped, T.ArrayType(dictionary.schema[out].dataType)).asNondeterministic()


def lookup(df: DataFrame, id_col: str, col: str, dictionary: DataFrame, out_col: str,
           strict: bool = True, unique_ids: bool = False) -> DataFrame:
    """Map a scalar or every element of an array column through the
    dictionary; order kept.  ``strict`` raises on an unknown value, otherwise
    unknown values are dropped (array) or left null (scalar).

    Arrays are exploded, joined and regrouped by id, so rows of one id share
    their elements.  Where ids are known to be unique (``has_unique_ids``) and
    the dictionary is small, arrays are mapped within their rows instead."""
    d = dictionary.select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
    is_array = dict(df.dtypes)[col].startswith("array")
    if not is_array:
        j = df.join(d, df[col] == d["_v"], "left")
        if strict:
            j = j.withColumn("_i", F.when(F.col("_i").isNull() & F.col(col).isNotNull(),
                                          F.raise_error(F.concat(F.lit("unknown dictionary value: "), F.col(col))))
                             .otherwise(F.col("_i")))
        return j.withColumnRenamed("_i", out_col).drop("_v")
    mapping = list_mapping(dictionary, strict=strict) if unique_ids else None
    if mapping:
        return df.withColumn(out_col, mapping(F.col(col)))
    ex = (df.select(F.col(id_col).alias("_rid"), F.posexplode_outer(F.col(col)).alias("_pos", "_v"))
          .where(F.col("_pos").isNotNull()))
    j = ex.join(d, "_v", "left")
    if strict:
        j = j.withColumn("_i", F.when(F.col("_i").isNull(),
                                      F.raise_error(F.concat(F.lit("unknown dictionary value: "), F.col("_v"))))
                         .otherwise(F.col("_i")))
    else:
        j = j.where(F.col("_i").isNotNull())
    g = (j.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("_pos", "_i"))).alias("_p"))
         .select("_rid", F.transform("_p", lambda s: s["_i"]).alias(out_col)))
    out = df.join(g, df[id_col] == g["_rid"], "left").drop("_rid")
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.array().cast("array<int>")))
