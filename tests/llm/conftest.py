import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, empty and long texts, ties, repeated rows, and columns named like those the operators make."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("th", "on", "er", "in", "st") for b in ("a", "e", "ing", "ou", "ly", "nd")]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 40, 120])))
        if i % 7 == 0:
            text = passage + "\n" + text
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None))
    rows += [(100, rows[14][1] + " extra", "en", "a", 1), (101, rows[14][1], "en", "a", 1), (102, rows[14][1], "fr", None, 1)]
    rows += [(103, None, None, None, None), (104, "", "en", "a", 0), (105, " \t\n ", "en", "a", 4), (106, "one", "en", "a", 3), (None, passage, "en", "b", 1), (None, None, "en", "b", 1)]
    rows += [(107, " ".join(rng.choice(words) for _ in range(30_000)), "en", "a", 1)]
    rows += [rows[3], rows[14]]
    extra = ["verdict", "n_words", "mix_key", "c", "t", "tok", "places", "ids", "qr_t", "jaccard_t", "dedup_spans", "label", "rank"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(extra)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")]))
