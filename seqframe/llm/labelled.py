"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, text) of at most ``max_rows`` labelled documents that are not held out and have at most ``max_chars`` characters, in a hashed
    order of doc_id; half of the rows are kept for each label as far as there are enough."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id), folds, fold)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2) for y in (0, 1)]
    chosen = parts[0].union(parts[1])
    rows = docs.select(F.col(doc_id).alias("id2"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    # at most max_rows rows of two numbers
    return rows.join(F.broadcast(chosen), F.col("id2") == F.col("id")).select("y", "text")
