"""User functions over groups, approximate neighbours, strict encoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.operators.allpairs import knn
from seqframe.operators.encode import encode_corpus
from seqframe.operators.hooks import grouped_aggregate
from seqframe.operators.knn_approx import NeighbourIndex, recall


def test_grouped_aggregate(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 7.0), (None, 1.0), (None, 3.0)], "k int, x double")
    got = {r.k: (r.value, r.n) for r in grouped_aggregate(df, ["k"], "x", lambda s: float(s.max() - s.min()), "double").collect()}
    assert got == {1: (2.0, 2), 2: (0.0, 1), None: (2.0, 2)}
    with pytest.raises(ValueError, match="a group has 2 rows"):
        grouped_aggregate(df, ["k"], "x", lambda s: 0.0, "double", max_rows=1)


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_approximate_neighbours(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "clusters":
        c = rng.normal(size=(30, 16)) * 4
        x = c[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)) * 0.2
    elif kind == "noise":
        x = rng.normal(size=(1500, 16))
    else:
        x = np.repeat(rng.normal(size=(500, 16)), 3, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    queries = df.where("id % 50 = 0")
    found = NeighbourIndex(df, 5).search(queries, exclude_self=True)
    assert found.groupBy("sid").count().where("count <> 5").isEmpty()
    r = recall(found, knn(queries, df, 5, exclude_self=True)).first()
    assert r.queries == 30 and r.pairs == 150 and r.recall >= 0.9
    d = found.where("sid = 50").first()
    assert d.dist == pytest.approx(float(np.sqrt(((x[50] - x[d.rid]) ** 2).sum())))


def test_queries_without_candidates_are_answered_exactly(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    far = spark.createDataFrame([(900, (np.ones(8) * 1000).tolist())], "id long, embedding array<double>")
    found = NeighbourIndex(df, 4).search(far).collect()
    assert [r.rid for r in sorted(found, key=lambda r: r.nn_rank)] == np.argsort(((x - 1000) ** 2).sum(axis=1))[:4].tolist()


def test_a_large_bucket_is_split_and_ids_may_repeat(spark, monkeypatch):
    """All rows fall into one bucket of each table; pairs of them are not rows, and a group holds few of them."""
    from seqframe.operators import knn_approx

    seen = []
    monkeypatch.setattr(knn_approx, "group_rows", lambda *a: seen.append(a) or 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)) * 1e-3
    x[0] = 1e3  # makes buckets so long that the others share them
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = NeighbourIndex(df, 4, spread=1e7)
    found = sorted((r.sid, r.nn_rank, r.rid) for r in index.search(df.where("id % 50 = 0 and id > 0"), exclude_self=True).collect())
    want = []
    for i in (50, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want += [(i, n, int(j)) for n, j in enumerate(np.argsort(d, kind="stable")[:4], 1)]
    assert found == want and seen
    twice = NeighbourIndex(df.union(df), 4, spread=1e7).search(df.where("id = 50"), exclude_self=True).collect()
    assert sorted(r.rid for r in twice) == sorted([want[0][2]] * 2 + [want[1][2]] * 2)


def test_an_unknown_tag_raises(spark):
    dic = spark.createDataFrame([("category", "root", 1), ("tag", "a", 2)], "kind string, value string, idx int")
    rows = spark.createDataFrame([(1, "AC", "root", ["a", "b"])], "id long, s string, c string, t array<string>")
    with pytest.raises(Exception, match="unknown dictionary value: b"):
        encode_corpus(rows, "id", "s", "c", "t", dic).collect()
    known = rows.withColumn("t", F.array(F.lit("a"), F.lit("a")))
    assert encode_corpus(known, "id", "s", "c", "t", dic, shuffle=False).first().conditioning_tags == [1, 2, 2]
