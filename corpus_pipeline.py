"""From documents to token ids: quality rules, near duplicates, repeated passages, the mix of sources, encoding.

Each stage takes what the one before kept, as it stands in Parquet.  Cases (nulls, empty and very long texts, ties
and repeated rows, empty tables, other columns) are those of the stages' operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm.common import shared_path
from seqframe.llm.jaccard import one_of_each
from seqframe.llm.mixing import mixed_documents
from seqframe.llm.piece_encoding import encode_pieces, numbered_copies
from seqframe.llm.quality_rules import keep_good
from seqframe.llm.substring_dedup import remove_repeats

#: Words in a row that count as a repeated passage.
PASSAGE = 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    return one_of_each(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier too go; the text is the words that are left."""
    kept = remove_repeats(docs, n=PASSAGE, words="passage_words__", removed="passage_removed__")
    sizes = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.withColumns(sizes).select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights; a document taken several times stands several times."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document that the mix takes, cut with merge-dropout; each copy by draws of its own."""
    import public_tokenizers

    copies = numbered_copies(docs.select("doc_id", "source", "text"))
    encoded = encode_pieces(copies, public_tokenizers.path("piece_bpe_32k.model"), copy="copy", keep=["doc_id", "source"])
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "lossless", "ids")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("encoding", encoding),
]

#: SQL can't express the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
