"""Encoding rows into token ids and conditioning ids (C4: J3 F2 F5 F9 F10 F11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import hash_shuffle, maybe_reverse
from ..functions.random import hash_uniform
from ..functions.vocab import encode
from .dictionary import list_mapping, lookup


def keep_by_dropout(arr: Column, row_id: Column, rate: float, seed: int, salt: str) -> Column:
    """Independent dropout per item: keep when the hash draw > rate.
    Rate 0 keeps all, rate 1 drops all (exactly, not by chance)."""
    if rate <= 0:
        return arr
    if rate >= 1:
        return F.filter(arr, lambda x: F.lit(False))
    return F.filter(arr, lambda x, i: hash_uniform(F.lit(seed), row_id, F.lit(salt), i) > F.lit(float(rate)))


def conditioning_ids(category_id: Column, tag_ids: Column, row_id: Column, root_id: Column,
                     taxon_dropout: float = 0.0, attribute_dropout: float = 0.0, seed: int = 0,
                     shuffle: bool = True) -> Column:
    """F10 + F11: [category id] + tag ids, each dropped independently, the
    ``root`` id if nothing is left, then shuffled by hash."""
    cat = keep_by_dropout(F.array(category_id), row_id, taxon_dropout, seed, "c")
    tags = keep_by_dropout(tag_ids, row_id, attribute_dropout, seed, "t")
    # bound to a name, or the list is worked out for its size and once more for itself
    ids = F.transform(F.array(F.concat(cat, tags)), lambda x: F.when(F.size(x) == 0, F.array(root_id)).otherwise(x))[0]
    return hash_shuffle(ids, F.lit(seed), row_id, F.lit("o")) if shuffle else ids


def root_index(dictionary: DataFrame, root: str = "root") -> int:
    """The ``root`` category id: one scalar read from the (small) dictionary."""
    row = dictionary.where((F.col("kind") == "category") & (F.col("value") == root)).select("idx").first()
    if row is None:
        raise ValueError(f"category dictionary has no {root!r} entry")
    return int(row[0])


def encode_corpus(df: DataFrame, id_col: str, seq_col: str, category_col: str, tags_col: str,
                  dictionary: DataFrame, taxon_dropout: float = 0.0, attribute_dropout: float = 0.0,
                  reverse: bool = False, seed: int = 0, mode: str = "unk", root: str = "root",
                  shuffle: bool = True, unique_ids: bool = False) -> DataFrame:
    """C4: ``(id, sequence array<int>, conditioning_tags array<int>, sequence_length)``.

    ``dictionary`` is the conditioning dictionary ``(kind, value, idx)``; the
    category lookup is an equi-join (broadcast at run time by AQE when
    small), tag ids go through the ordered lookup (J3), strict by default as
    in the reference."""
    cats = dictionary.where(F.col("kind") == "category").select("value", "idx")
    tags = dictionary.where(F.col("kind") == "tag").select("value", "idx")
    root_id = root_index(dictionary, root)
    d = lookup(df, id_col, category_col, cats, "_cat", strict=True)
    d = lookup(d, id_col, tags_col, tags, "_tags", strict=True, unique_ids=unique_ids)
    seq = encode(F.col(seq_col), mode)
    if mode == "strict":
        from ..functions.vocab import assert_encoded
        seq = assert_encoded(seq)
    d = d.withColumn("sequence", seq)
    out = d.select(
        F.col(id_col).alias("id"),
        (maybe_reverse(F.col("sequence"), F.lit(seed), F.col(id_col), F.lit("r")) if reverse
         else F.col("sequence")).alias("sequence"),
        conditioning_ids(F.col("_cat"), F.col("_tags"), F.col(id_col), F.lit(root_id), taxon_dropout,
                         attribute_dropout, seed, shuffle).alias("conditioning_tags"),
        F.size("sequence").alias("sequence_length"),
    )
    return out


def encode_curated(df: DataFrame, id_col: str, seq_col: str, category_col: str, tags_col: str,
                   dictionary: DataFrame, taxon_dropout: float = 0.0, attribute_dropout: float = 0.0,
                   reverse: bool = False, seed: int = 0, mode: str = "unk", root: str = "root",
                   shuffle: bool = True, drop_untagged: bool = True, unique_ids: bool = False) -> DataFrame:
    """C2 + C4 fused: fold rare categories to ``root``, keep only dictionary
    tags and map them to ids with ONE explode / join / regroup (a tag is kept
    exactly when it has an id).  Same result as ``keep_tags`` followed by
    ``encode_corpus`` with half the shuffles; with none where ids are known to
    be unique and the dictionary is small."""
    cats = dictionary.where(F.col("kind") == "category").select(F.col("value").alias("_cv"), F.col("idx").alias("_cat"))
    tags = dictionary.where(F.col("kind") == "tag").select(F.col("value").alias("_tv"), F.col("idx").alias("_ti"))
    root_id = root_index(dictionary, root)
    mapping = list_mapping(dictionary.where(F.col("kind") == "tag")) if unique_ids else None
    if mapping:
        d = df.withColumn("_tags", mapping(F.col(tags_col)))
        d = d.where(F.size("_tags") > 0) if drop_untagged else d
    else:
        d = _tags_regrouped(df, id_col, tags_col, tags, drop_untagged)
    d = d.join(cats, d[category_col] == cats["_cv"], "left")
    d = d.withColumn("_cat", F.coalesce(F.col("_cat"), F.lit(root_id)))
    seq = encode(F.col(seq_col), mode)
    d = d.withColumn("sequence", seq)
    return d.select(
        F.col(id_col).alias("id"),
        (maybe_reverse(F.col("sequence"), F.lit(seed), F.col(id_col), F.lit("r")) if reverse
         else F.col("sequence")).alias("sequence"),
        conditioning_ids(F.col("_cat"), F.col("_tags"), F.col(id_col), F.lit(root_id), taxon_dropout,
                         attribute_dropout, seed, shuffle).alias("conditioning_tags"),
        F.size("sequence").alias("sequence_length"),
    )


def _tags_regrouped(df: DataFrame, id_col: str, tags_col: str, tags: DataFrame, drop_untagged: bool) -> DataFrame:
    """``df`` with ``_tags``: ids of the tags (_tv, _ti) by explode, join and regroup."""
    ex = (df.select(F.col(id_col).alias("_rid"), F.posexplode_outer(F.col(tags_col)).alias("_pos", "_tv"))
          .where(F.col("_tv").isNotNull()))
    ids = (ex.join(tags, "_tv").groupBy("_rid")
           .agg(F.array_sort(F.collect_list(F.struct("_pos", "_ti"))).alias("_p"))
           .select("_rid", F.transform("_p", lambda s: s["_ti"]).alias("_tags")))
    d = df.join(ids, df[id_col] == ids["_rid"], "inner" if drop_untagged else "left")
    return d.withColumn("_tags", F.coalesce(F.col("_tags"), F.array().cast("array<int>")))
