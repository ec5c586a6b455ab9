"""How the driver tables stand in for the reference's inputs, in Spark and in
the DuckDB oracle dialect (kept side by side so both stay in step).

* ``documents`` -> records: ``lang`` = category, ``n_chars`` = length,
  lower-case ASCII words = tags, upper-cased ASCII letters = sequence
  (letters outside the 25-symbol alphabet, e.g. J, are unknown -> id 21).
* ``benchmark`` / ``conversations`` -> sequences to encode, perturb, batch.
* ``embeddings`` -> two embedding sets of one table: even ``vec_id`` is the
  reference set, odd the subject set (every row is used by one side).
* ``events`` -> property bags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_words, letters, words
from ..functions.vocab import STANDARD, SYMBOL_TO_ID, UNK
from ..session import read_table

ROUND = 6


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, category, length, tags, sequence)`` from ``documents``."""
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"),
                    F.col("n_chars").alias("length"), words("text").alias("tags"),
                    letters("text").alias("sequence"), has_words("text").alias("has_tags"))


def sequences(spark: SparkSession, sf_dir: str, table: str = "benchmark") -> DataFrame:
    """``(id, sequence)`` from a text table."""
    d = read_table(spark, sf_dir, table)
    key = "item_id" if table == "benchmark" else "doc_id"
    return d.select(F.col(key).alias("id"), letters("text").alias("sequence"))


def embedding_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, embedding, label, set)``; ``set`` is ``ref`` or ``subject``."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label",
                    F.when(F.pmod(F.col("vec_id"), F.lit(2)) == 0, "ref").otherwise("subject").alias("set"))


# ---------------------------------------------------------------- SQL side
SQL_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
SQL_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def sql_chars(expr: str) -> str:
    return f"list_filter(string_split({expr}, ''), lambda ch: ch <> '')"


def sql_u(*parts: str) -> str:
    """The hash uniform of ``functions.random.hash_uniform`` in DuckDB."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT) / 4294967296.0)"


def sql_md5(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def sql_encode_char(c: str) -> str:
    whens = " ".join(f"WHEN '{s}' THEN {i}" for s, i in sorted(SYMBOL_TO_ID.items(), key=lambda kv: (kv[1], kv[0])))
    return f"(CASE {c} {whens} ELSE {UNK} END)"


def sql_decode_char(c: str) -> str:
    inlist = ", ".join(f"'{s}'" for s in STANDARD)
    return f"(CASE WHEN {c} IN ({inlist}) THEN {c} ELSE 'X' END)"


def sql_dist(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))")


SQL_EMB_SETS = ("SELECT vec_id, embedding, label, CASE WHEN vec_id % 2 = 0 THEN 'ref' ELSE 'subject' END AS set "
                "FROM embeddings")
