"""Corpus curation operators.

Generators use the ``_outer`` form plus an explicit null filter: plain
``explode`` makes Catalyst infer ``size(array) > 0`` and push it into the
scan, which evaluates the (expensive) array expression twice.

Records are any DataFrame with an id column, a category column, an integer
length column, a tag array column and a sequence column; names are
parameters so the same code runs on the record schema and on stand-ins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import hash_order
from ..session import sized
from .dictionary import list_mapping
from .ranking import hash_rank, keys_at, up_to


def length_filter(df: DataFrame, length_col: str, min_len: int, max_len: int) -> DataFrame:
    """P5: inclusive range; pushed to the Parquet scan as two range filters."""
    return df.where(F.col(length_col).between(min_len, max_len))


def drop_untagged(df: DataFrame, tags_col: str, has_tags=None) -> DataFrame:
    """Drop rows whose tag array is empty or null.  ``has_tags`` may
    give a cheaper equivalent predicate on the raw input, so the filter that
    Catalyst pushes into the scan does not evaluate the tag extraction a
    second time."""
    return df.where(has_tags if has_tags is not None else (F.size(F.col(tags_col)) > 0))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: ``(value, count)``; nulls excluded; partial aggregation before the
    shuffle so a hot value costs one row per input partition."""
    return (df.where(F.col(col).isNotNull())
            .groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


def occurrence_counts(df: DataFrame, tags_col: str) -> DataFrame:
    """A2: counts of tag occurrences over exploded lists (not distinct rows)."""
    return (df.select(F.explode_outer(F.col(tags_col)).alias("value")).where(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias("count")))


def dictionary_counts(df: DataFrame, category_col: str, tags_col: str) -> DataFrame:
    """A1 + A2 in one pass: ``(kind, value, count)`` for the category column
    (one per row, nulls excluded) and for every tag occurrence.  One explode,
    one partially aggregated shuffle for both dictionaries."""
    items = F.concat(
        F.array(F.struct(F.lit("category").alias("kind"), F.col(category_col).cast("string").alias("value"))),
        F.transform(F.col(tags_col), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value"))))
    e = df.select(F.explode_outer(items).alias("_e")).select("_e.kind", "_e.value").where(F.col("value").isNotNull())
    return e.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("count"))


def threshold(counts: DataFrame, min_count: int) -> DataFrame:
    """A3: ``HAVING count >= min_count`` - the kept dictionary.  Its size is
    bounded by total/min_count, which is what makes the later joins cheap."""
    return counts.where(F.col("count") >= min_count)


def fold_rare(df: DataFrame, col: str, kept: DataFrame, other: str = "root") -> DataFrame:
    """Values outside the kept dictionary (and nulls) become ``other``.

    Left equi-join on the value.  The dictionary is written first, so Spark
    knows its size when it plans: up to the broadcast threshold the rows are
    not shuffled by a column where one value may hold a third of them."""
    k = sized(kept.select(F.col("value").alias("_kv"), F.lit(True).alias("_keep")))
    j = df.join(k, df[col] == k["_kv"], "left")
    return j.withColumn(col, F.when(F.col("_keep"), F.col(col)).otherwise(F.lit(other))).drop("_kv", "_keep")


def keep_tags(df: DataFrame, id_col: str, tags_col: str, kept: DataFrame,
              drop_empty: bool = True, out_col: str | None = None, unique_ids: bool = False) -> DataFrame:
    """P8 + A4 + J1 (+ P9): keep only dictionary tags, in original order.

    Tags are exploded with their position, semi-joined to the dictionary and
    regrouped per row id (a group is one row's own tags), then joined back.
    ``drop_empty`` uses an inner join (rows left without tags vanish);
    otherwise a left join gives them an empty array.  Where ids are known to
    be unique and the dictionary is small, tags are picked within their rows
    instead, with the same result."""
    out_col = out_col or tags_col
    mapping = list_mapping(kept.select("value").distinct(), "value") if unique_ids else None
    if mapping:
        j = df.withColumn(out_col, mapping(F.col(tags_col)))
        return j.where(F.size(out_col) > 0) if drop_empty else j
    exploded = (df.select(F.col(id_col).alias("_rid"), F.posexplode_outer(F.col(tags_col)).alias("_pos", "_tag"))
                .where(F.col("_tag").isNotNull()))
    kept_vals = kept.select(F.col("value").alias("_tag"))
    survivors = exploded.join(kept_vals, "_tag", "left_semi")
    regrouped = (survivors.groupBy("_rid")
                 .agg(F.array_sort(F.collect_list(F.struct("_pos", "_tag"))).alias("_pairs"))
                 .select("_rid", F.transform("_pairs", lambda s: s["_tag"]).alias("_kept")))
    how = "inner" if drop_empty else "left"
    j = df.join(regrouped, df[id_col] == regrouped["_rid"], how)
    j = j.withColumn(out_col, F.coalesce(F.col("_kept"), F.array().cast("array<string>")))
    return j.drop("_rid", "_kept")


def split_cuts(n_col, val_frac: float, test_frac: float):
    """Cut points exactly like ``int(n*(1-v-t))`` and ``int(n*(1-t))``."""
    train_frac = 1 - val_frac - test_frac
    val_end = 1 - test_frac
    return F.floor(n_col * F.lit(train_frac)), F.floor(n_col * F.lit(val_end))


def hash_split(df: DataFrame, id_col: str, seed: int = 147, val_frac: float = 0.1,
               test_frac: float = 0.1) -> DataFrame:
    """W3 + A18 + T4: seeded permutation (md5 of ``seed|id``), exact cuts.

    Adds ``split`` (train / val / test), ``rank`` (1-based position in the
    permutation) and ``split_rank`` (position inside its split)."""
    r = hash_rank(df, seed, id_col)
    end_train, end_val = split_cuts(F.col("total_n"), val_frac, test_frac)
    r = r.withColumn("split", F.when(F.col("rank") <= end_train, "train")
                     .when(F.col("rank") <= end_val, "val").otherwise("test"))
    r = r.withColumn("split_rank", F.when(F.col("split") == "train", F.col("rank"))
                     .when(F.col("split") == "val", F.col("rank") - end_train)
                     .otherwise(F.col("rank") - end_val).cast("long"))
    return r.drop("total_n")


def split_by_keys(df: DataFrame, id_col: str, seed: int = 147, val_frac: float = 0.1, test_frac: float = 0.1, dev_sizes: dict | None = None) -> DataFrame:
    """W3 + A18 (+ P10): the splits of ``hash_split`` without ranks.  The keys at the cut positions are found from
    counts of key prefixes, and ``split`` is then a comparison within the row: rows, and the texts they carry, are
    neither sorted nor shuffled.  With ``dev_sizes`` a column ``dev`` marks the first rows of each split.

    Equals ``hash_split`` for ids that are unique; rows of one id stay in one split."""
    d = df.withColumn("_h", hash_order(F.lit(seed), F.col(id_col)))
    sizes = dev_sizes or {}

    def positions(n: int) -> list[int]:
        ends = [math.floor(n * (1 - val_frac - test_frac)), math.floor(n * (1 - test_frac)), n]
        starts = [0, *ends[:2]]
        return [*ends[:2], *[a + min(sizes.get(s, 0), b - a) for s, a, b in zip(("train", "val", "test"), starts, ends, strict=True)]]

    _, (train, val, *dev) = keys_at(d.select("_h", id_col), "_h", id_col, positions)
    in_train, in_val = up_to("_h", id_col, train), up_to("_h", id_col, val)
    out = d.withColumn("split", F.when(in_train, "train").when(in_val, "val").otherwise("test"))
    if dev_sizes:
        firsts = [up_to("_h", id_col, k) for k in dev]
        out = out.withColumn("dev", F.when(F.col("split") == "train", firsts[0]).when(F.col("split") == "val", firsts[1]).otherwise(firsts[2]))
    return out.drop("_h")


def dev_subsets(split_df: DataFrame, sizes: dict | None = None) -> DataFrame:
    """P10: first N rows of each split in permutation order (a row cap that
    is the feature: dev subsets)."""
    sizes = sizes or {"train": 10000, "val": 5000, "test": 5000}
    cond = None
    for name, n in sizes.items():
        c = (F.col("split") == name) & (F.col("split_rank") <= n)
        cond = c if cond is None else (cond | c)
    return split_df.where(cond)
