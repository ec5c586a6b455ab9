"""Curation, split, dictionaries, conditioning ids (FIXTURES X2, X3, X5, X7)."""
import hashlib

from pyspark.sql import functions as F

from seqframe.operators import curate as C
from seqframe.operators.dictionary import category_dictionary, conditioning_dictionary, lookup
from seqframe.operators.encode import conditioning_ids, encode_curated
from seqframe.operators.ranking import exact_quantiles, hash_rank, prefix_rank, range_bucket

X2 = [(1, "a", ["t1", "t2"], "AAC"), (2, "a", ["t1"], "AX"), (3, "b", ["t2", "t3"], "MKV"),
      (4, None, ["t1", "t3", "t4"], "GG"), (5, "a", [], "AC"), (6, "c", ["t4"], "AAAAAA"),
      (7, "b", ["t5"], "KL")]


def x2(spark):
    df = spark.createDataFrame(X2, "id long, category string, tags array<string>, sequence string")
    return df.withColumn("length", F.length("sequence"))


def curate_x2(spark):
    f = C.drop_untagged(C.length_filter(x2(spark), "length", 2, 5), "tags")
    cats = C.threshold(C.value_counts(f, "category"), 2)
    tags = C.threshold(C.occurrence_counts(f, "tags"), 2)
    kept = C.keep_tags(C.fold_rare(f, "category", cats), "id", "tags", tags)
    return f, cats, tags, kept


def test_curation_fixture(spark):
    f, cats, tags, kept = curate_x2(spark)
    assert {(r.value, r["count"]) for r in cats.collect()} == {("a", 2), ("b", 2)}
    assert {(r.value, r["count"]) for r in tags.collect()} == {("t1", 3), ("t2", 2), ("t3", 2)}
    got = {r.id: (r.category, r.tags) for r in kept.collect()}
    assert got == {1: ("a", ["t1", "t2"]), 2: ("a", ["t1"]), 3: ("b", ["t2", "t3"]), 4: ("root", ["t1", "t3"])}


def test_keep_tags_left_keeps_empty_rows(spark):
    f, _, tags, _ = curate_x2(spark)
    kept = C.keep_tags(f, "id", "tags", tags, drop_empty=False)
    assert {r.id: r.tags for r in kept.collect()}[7] == []


def test_dictionary_counts_one_pass(spark):
    f, _, _, _ = curate_x2(spark)
    d = {(r.kind, r.value): r["count"] for r in C.dictionary_counts(f, "category", "tags").collect()}
    assert d[("category", "a")] == 2 and d[("tag", "t1")] == 3 and ("category", None) not in d


def test_hash_split_fixture(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    s = {r.k: r.split for r in C.hash_split(df, "k", 147, 0.1, 0.1).collect()}
    assert {k for k, v in s.items() if v == "train"} == {5, 8, 7, 9, 0, 4, 3, 1}
    assert [k for k, v in s.items() if v == "val"] == [2] and [k for k, v in s.items() if v == "test"] == [6]


def test_hash_rank_is_global_order_and_partition_independent(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    want = sorted(range(3000), key=lambda i: (hashlib.md5(f"9|{i}".encode()).hexdigest(), i))
    for parts in (1, 7):
        got = hash_rank(df.repartition(parts), 9, "k").orderBy("rank").select("k").collect()
        assert [r.k for r in got] == want


def test_split_sizes_sum_and_disjoint(spark):
    df = spark.range(1234).select(F.col("id").alias("k"))
    s = C.hash_split(df, "k", 1, 0.1, 0.1)
    sizes = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": int(1234 * 0.8), "val": int(1234 * 0.9) - int(1234 * 0.8),
                     "test": 1234 - int(1234 * 0.9)}
    assert s.select("k").distinct().count() == 1234
    dev = C.dev_subsets(s, {"train": 10, "val": 5, "test": 5})
    assert {r.split: r["count"] for r in dev.groupBy("split").count().collect()} == {"train": 10, "val": 5, "test": 5}


def test_prefix_rank_running_sums(spark):
    rows = [(float(i % 17), 1 if i % 3 == 0 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, pos long").groupBy("score").agg(F.sum("pos").alias("tp"))
    r = prefix_rank(df, range_bucket(df, "score", 4, descending=True), [F.col("score").desc()], measures=["tp"])
    got = [(x.score, x.rank, x.cum_tp) for x in r.orderBy("rank").collect()]
    acc, want = 0, []
    for i, (score, tp) in enumerate(sorted(((x.score, x.tp) for x in df.collect()), reverse=True)):
        acc += tp
        want.append((score, i + 1, acc))
    assert got == want


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    vals = [int(x) for x in np.random.default_rng(1).integers(0, 500, 999)] + [7] * 300
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.p: r.value for r in exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert abs(got[p] - float(np.quantile(vals, p))) < 1e-9


def test_dictionary_index_fixture(spark):
    cats = spark.createDataFrame([("a", 5), ("b", 3)], "value string, count long")
    tags = spark.createDataFrame([("t1", 9), ("t2", 4), ("t3", 2)], "value string, count long")
    d = {(r.kind, r.value): r.idx for r in conditioning_dictionary(cats, tags).collect()}
    assert d == {("category", "a"): 1, ("category", "b"): 2, ("category", "root"): 3,
                 ("tag", "t1"): 4, ("tag", "t2"): 5, ("tag", "t3"): 6}
    c = {(r.kind, r.value): r.idx for r in conditioning_dictionary(cats, tags, compat_overlap=True).collect()}
    assert [c[("tag", t)] for t in ("t1", "t2", "t3")] == [3, 4, 5]
    assert {r.value: r.idx for r in category_dictionary(cats).collect()} == {"a": 1, "b": 2, "root": 3}


def test_lookup_strict_and_lenient(spark):
    import pytest

    d = spark.createDataFrame([("x", 1), ("y", 2)], "value string, idx int")
    df = spark.createDataFrame([(1, ["y", "x", "y"]), (2, ["x", "z"])], "id long, t array<string>")
    ok = {r.id: r.ids for r in lookup(df, "id", "t", d, "ids", strict=False).collect()}
    assert ok == {1: [2, 1, 2], 2: [1]}
    with pytest.raises(Exception):
        lookup(df, "id", "t", d, "ids", strict=True).collect()


def test_conditioning_ids_dropout_bounds(spark):
    df = spark.createDataFrame([(1, 3, [4, 5, 6])], "id long, cat int, tags array<int>")
    none = df.select(conditioning_ids(F.col("cat"), F.col("tags"), F.col("id"), F.lit(9), 1.0, 1.0).alias("c"))
    assert none.first().c == [9]
    full = df.select(conditioning_ids(F.col("cat"), F.col("tags"), F.col("id"), F.lit(9), 0.0, 0.0,
                                      shuffle=False).alias("c"))
    assert full.first().c == [3, 4, 5, 6]
    shuffled = df.select(conditioning_ids(F.col("cat"), F.col("tags"), F.col("id"), F.lit(9)).alias("c")).first().c
    assert sorted(shuffled) == [3, 4, 5, 6]


def test_encode_curated_equals_keep_then_lookup(spark):
    f, cats, tags, kept = curate_x2(spark)
    dic = conditioning_dictionary(cats, tags)
    enc = {r.id: (r.sequence, r.conditioning_tags) for r in
           encode_curated(f, "id", "sequence", "category", "tags", dic, shuffle=False).collect()}
    idx = {(r.kind, r.value): r.idx for r in dic.collect()}
    for r in kept.collect():
        want = [idx[("category", r.category)]] + [idx[("tag", t)] for t in r.tags]
        assert enc[r.id][1] == want
    assert enc[1][0] == [1, 1, 2] and enc[2][0] == [1, 21]
