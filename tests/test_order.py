"""Splits by cut keys, dictionary order by composite buckets, numbered lines, substitution plans."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from seqframe.functions.random import hash_order
from seqframe.operators import curate as C
from seqframe.operators import ranking
from seqframe.operators.dictionary import conditioning_dictionary, index_by_count
from seqframe.operators.perturb import random_substitution
from seqframe.operators.ranking import key_bucket, keys_at
from seqframe.sources.files import numbered_lines, read_dictionary, write_dictionary


@pytest.mark.parametrize("n,pick", [(0, 4096), (1, 4096), (7, 4096), (1000, 4096), (1000, 1)])
def test_split_by_keys_equals_split_by_ranks(spark, monkeypatch, n, pick):
    monkeypatch.setattr(ranking, "PICK_ROWS", pick)
    df = spark.range(n).repartition(5).withColumn("text", F.lit("x"))
    sizes = {"train": 40, "val": 5, "test": 10**6}
    want = {r.id: (r.split, r.split_rank <= sizes[r.split]) for r in C.hash_split(df, "id", 3).collect()}
    got = {r.id: (r.split, r.dev) for r in C.split_by_keys(df, "id", 3, dev_sizes=sizes).collect()}
    assert got == want


def test_split_by_keys_shuffles_no_row(spark):
    df = spark.range(500).withColumn("text", F.repeat(F.lit("x"), 100))
    plan = C.split_by_keys(df, "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Join" not in plan


def test_keys_at_positions(spark):
    df = spark.range(300).withColumn("h", hash_order(F.lit(1), F.col("id")))
    rows = sorted((r.h, r.id) for r in df.collect())
    total, keys = keys_at(df, "h", "id", lambda n: [0, 1, n // 2, n])
    assert total == 300 and keys == [None, rows[0], rows[149], rows[299]]


def test_rows_of_one_id_stay_in_one_split(spark):
    df = spark.range(20).union(spark.range(20)).withColumn("r", F.rand(1))
    got = C.split_by_keys(df, "id", 5, 0.25, 0.25).groupBy("id").agg(F.countDistinct("split").alias("n"))
    assert got.where("n > 1").count() == 0


@pytest.mark.parametrize("equal", [0.9, 1.0])
def test_no_bucket_holds_the_equal_counts(spark, equal):
    rng = random.Random(1)
    rows = [(f"w{i:05d}é", 7 if rng.random() < equal else rng.randrange(1000)) for i in range(8000)]
    df = spark.createDataFrame(rows, "value string, count long").repartition(6)
    sizes = [r["count"] for r in df.withColumnRenamed("count", "c").groupBy(key_bucket(df.withColumnRenamed("count", "c"), [("c", True), ("value", False)], 16).alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 8000 / 16
    want = [v for v, _ in sorted(rows, key=lambda x: (-x[1], x[0].encode()))]
    assert [r.value for r in sorted(index_by_count(df).collect(), key=lambda r: r.idx)] == want


def test_dictionary_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], "value string, count long")
    assert index_by_count(none).count() == 0
    one = spark.createDataFrame([("a", 5)], "value string, count long")
    assert [(r.kind, r.value, r.idx) for r in conditioning_dictionary(none, one).orderBy("idx").collect()] == [("category", "root", 1), ("tag", "a", 2)]


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:1700]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[1700:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = numbered_lines(spark, str(tmp_path))
        assert df.select(F.col("line")).distinct().count() == 3000
        assert [r.value for r in sorted(df.collect(), key=lambda r: r.line)] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("with_counts", [True, False])
def test_dictionary_files_give_ids(spark, tmp_path, with_counts):
    rows = [("b,c", 9, 1), ('q"t', 8, 2), ("a", 8, 3), ("é", 1, 4)]
    write_dictionary(spark.createDataFrame(rows, "value string, count long, idx int"), str(tmp_path / "d"), with_counts)
    back = read_dictionary(spark, str(tmp_path / "d")).orderBy("idx").collect()
    assert [(r.value, r["count"], r.idx) for r in back] == [(v, n if with_counts else None, i) for v, n, i in rows]


def test_substitution_sorts_keys_once_a_row(spark):
    """Four times the length takes about four times as long, not sixteen."""
    def seconds(n):
        df = spark.createDataFrame([(i, "ACDEFGHIKL" * (n // 10)) for i in range(8)], "id long, sequence string").coalesce(1)
        df = random_substitution(df, "id", "sequence", 0.25, 2, 1).select(F.sum(F.hash("gen")))
        df.collect()
        start = time.time()
        df.collect()
        return time.time() - start

    seconds(400)
    short, long = seconds(2000), seconds(16000)
    assert long < 24 * short + 1


def test_substitution_changes_what_it_should(spark):
    rows = random_substitution(spark.createDataFrame([(1, "ACDJX" * 40), (2, ""), (3, "AC")], "id long, sequence string"), "id", "sequence", 0.3, 2, 4).collect()
    for r in rows:
        assert sum(a != b for a, b in zip(r.orig, r.gen)) == math.floor(len(r.orig) * 0.3) and len(r.orig) == len(r.gen)
        assert set(r.gen) <= set("ACDEFGHIKLMNPQRSTVWYXJ")
