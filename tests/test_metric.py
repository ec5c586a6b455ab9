"""The metric partition: equal to brute force, and pruned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.operators import allpairs as AP
from seqframe.operators import manifold as M
from seqframe.operators import metric
from seqframe.operators.metric import first_visits, lay_out, pruned_reduce, visits_that_matter


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(3)


def clustered(rng, n, d=8, centres=12, spread=0.05):
    c = rng.normal(size=(centres, d)) * 3
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * spread


def brute_topk(s, sid, r, rid, k, exclude=None):
    out = []
    for i, x in enumerate(s):
        d = np.sqrt(((x - r) ** 2).sum(axis=1))
        pairs = sorted((float(d[j]), int(rid[j])) for j in range(len(r)) if exclude is None or exclude[j] != sid[i])
        out += [(int(sid[i]), j, dist, n) for n, (dist, j) in enumerate(pairs[:k], 1)]
    return out


def found_topk(df):
    return sorted((r.sid, r.rid, r.dist, r.nn_rank) for r in df.collect())


def same(a, b):
    a, b = sorted(a), sorted(b)
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("kind,block_rows", [("clusters", 16), ("clusters", 2048), ("noise", 16), ("copies", 8), ("line", 16)])
def test_topk_equals_brute_force(spark, kind, block_rows):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        r, s = clustered(rng, 400), clustered(rng, 120)
    elif kind == "noise":
        r, s = rng.normal(size=(300, 5)), rng.normal(size=(80, 5)) * 2
    elif kind == "copies":  # a third of the rows is one vector, and many distances tie
        r, s = rng.integers(0, 3, size=(300, 3)).astype(float), rng.integers(0, 3, size=(60, 3)).astype(float)
        r[:120] = 1.0
        s[:30] = 1.0
    else:
        r, s = np.outer(rng.normal(size=200), [1.0, 2.0]), np.outer(rng.normal(size=50), [1.0, 2.0])
    sid, rid = np.arange(len(s)) + 5000, np.arange(len(r))
    found = found_topk(AP.knn(frame(spark, s, 5000), frame(spark, r), 4, block_rows=block_rows))
    same(found, brute_topk(s, sid, r, rid, 4))


def test_topk_without_the_own_row(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 150)
    x[:40] = x[0]
    df = frame(spark, x)
    refs = df.select((F.col("id") * 2).alias("nid"), "embedding", F.col("id").alias("own")).union(df.where("id < 60").select(F.col("id") * 2 + 1, "embedding", "id"))
    found = found_topk(AP.knn(df, refs, 3, ref_id_col="nid", ref_vec_col="embedding", exclude_self=True, ref_self_col="own", block_rows=16))
    r = np.concatenate((x, x[:60]))
    rid = np.concatenate((np.arange(150) * 2, np.arange(60) * 2 + 1))
    same(found, sorted(brute_topk(x, np.arange(150), r, rid, 3, exclude=np.concatenate((np.arange(150), np.arange(60))))))


@pytest.mark.parametrize("block_rows", [8, 2048])
def test_cover_and_realism_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    r, s = clustered(rng, 300, spread=0.3), clustered(rng, 150, spread=0.5)
    r[:50] = r[0]
    refs = M.compute_manifold(frame(spark, r), 3, block_rows=block_rows)
    radius = {x.id: x.radius for x in refs.collect()}
    d = np.sqrt(((r[:, None] - r[None]) ** 2).sum(axis=2))
    assert np.allclose([radius[i] for i in range(len(r))], np.sort(d, axis=1)[:, 3])
    ball = np.array([radius[i] for i in range(len(r))])
    d = np.sqrt(((s[:, None] - r[None]) ** 2).sum(axis=2))
    subjects = frame(spark, s, 1000)
    covered = {x.id: x.covered for x in M.covered_rows(refs, subjects, block_rows=block_rows).collect()}
    assert [covered[1000 + i] for i in range(len(s))] == (d < ball).any(axis=1).tolist()
    ratio = {x.id: x.realism for x in M.realism(refs, subjects, block_rows=block_rows).collect()}
    assert np.allclose([ratio[1000 + i] for i in range(len(s))], (ball / (d + 1e-6)).max(axis=1))


def test_clustered_rows_visit_few_blocks(spark):
    rng = np.random.default_rng(6)
    x = clustered(rng, 2000, d=16, centres=20)
    refs = frame(spark, x).select(F.col("id").alias("rid"), F.col("embedding").alias("rvec"), F.col("id").alias("rself"))
    placed, annuli = lay_out(refs, len(x), 32)
    assert annuli.parts.max() == 1 or annuli.rows.max() > 32
    sid = frame(spark, x).select(F.col("id").alias("sid"), F.col("embedding").alias("svec"))
    first = first_visits(sid, annuli)
    assert first.count() == len(x)
    # the bound of an own cluster: its rows are near, those of others far
    rest = first.select("sid", "svec", F.col("block").alias("home"), F.col("part").alias("home_part"), F.lit(0.4).alias("bound"))
    visits = visits_that_matter(rest, annuli, "topk", 4).count()
    blocks = int(annuli.parts.sum())
    assert blocks >= 40 and visits / len(x) < blocks / 8


def test_a_hot_cell_is_split(spark):
    x = np.zeros((600, 4))
    x[:, 0] = np.arange(600) * 1e-4
    x[:5, 0] = 50 + np.arange(5)
    refs = frame(spark, x).select(F.col("id").alias("rid"), F.col("embedding").alias("rvec"), F.col("id").alias("rself"))
    placed, annuli = lay_out(refs, len(x), 20)
    sizes = [r["count"] for r in placed.groupBy("block", "part").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 60


def test_the_sample_of_pivots_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(metric, "SAMPLE_ROWS", 10)
    rng = np.random.default_rng(8)
    r, s = clustered(rng, 200), clustered(rng, 40)
    same(found_topk(AP.knn(frame(spark, s, 900), frame(spark, r), 3, block_rows=16)), brute_topk(s, np.arange(40) + 900, r, np.arange(200), 3))


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = frame(spark, np.ones((3, 2)))
    assert pruned_reduce(none, some, "topk", k=2).count() == 0
    assert pruned_reduce(some, none, "topk", k=2).count() == 0
    assert {r.covered for r in M.covered_rows(none.withColumn("radius", F.lit(1.0)), some).collect()} == {False}


@pytest.mark.parametrize("pay", [True, False])
@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_visits_and_meeting_all_give_the_same(spark, monkeypatch, kind, pay):
    monkeypatch.setattr(metric, "visits_pay", lambda *a: pay)
    monkeypatch.setattr(metric, "ROUTE_ROWS", 50)
    monkeypatch.setattr(AP, "MIN_BLOCK_ROWS", 30)
    rng = np.random.default_rng(11)
    if kind == "clusters":
        r, s = clustered(rng, 300, spread=0.3), clustered(rng, 90, spread=0.5)
    elif kind == "noise":
        r, s = rng.normal(size=(300, 16)), rng.normal(size=(90, 16))
    else:
        r, s = rng.integers(0, 3, size=(300, 3)).astype(float), rng.integers(0, 3, size=(90, 3)).astype(float)
    sid, rid = np.arange(len(s)) + 5000, np.arange(len(r))
    same(found_topk(AP.knn(frame(spark, s, 5000), frame(spark, r), 4, block_rows=16)), brute_topk(s, sid, r, rid, 4))
    refs = M.compute_manifold(frame(spark, r), 3, block_rows=16)
    ball = np.array([x.radius for x in refs.orderBy("id").collect()])
    d = np.sqrt(((s[:, None] - r[None]) ** 2).sum(axis=2))
    covered = {x.id: x.covered for x in M.covered_rows(refs, frame(spark, s, 5000), block_rows=16).collect()}
    assert [covered[i] for i in sid] == (d < ball).any(axis=1).tolist()
    ratio = {x.id: x.realism for x in M.realism(refs, frame(spark, s, 5000), block_rows=16).collect()}
    assert np.allclose([ratio[i] for i in sid], (ball / (d + 1e-6)).max(axis=1))


def test_vectors_without_clusters_are_not_sent_to_every_block(spark, monkeypatch):
    """Noise on a sphere: bounds rule out nothing, so a row is sent once for each large block, not once for each small one."""
    sent, whole = [], metric.meet
    monkeypatch.setattr(metric, "meet", lambda visits, *a: sent.append(visits.count()) or whole(visits, *a))
    rng = np.random.default_rng(12)
    for x, much in ((rng.normal(size=(900, 32)), False), (clustered(rng, 900, d=32, centres=30), True)):
        sent.clear()
        AP.knn(frame(spark, x), frame(spark, x), 4, block_rows=16).count()
        assert (sum(sent) > 900) == much and sum(sent) < 900 * 8


@pytest.mark.parametrize("exclude", [True, False])
def test_tiles_of_a_block(monkeypatch, exclude):
    """What was found in one tile limits what the next ones look at."""
    monkeypatch.setattr(AP, "TILE", 7)
    monkeypatch.setattr(AP, "CHUNK", 5)
    monkeypatch.setattr(AP, "EXACT_PAIRS", 11)
    rng = np.random.default_rng(13)
    for y in (rng.normal(size=(60, 3)), rng.integers(0, 2, size=(60, 3)).astype(float), np.sort(rng.normal(size=(60, 1)), axis=0)[::-1]):
        x, rid, radius = y[::2], np.arange(60), np.where(np.arange(60) < 20, 0.0, rng.uniform(0, 1, 60))
        sid = np.arange(0, 60, 2)
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        d[:, :][(sid[:, None] == rid[None]) & exclude] = np.inf
        top = AP._reduce("topk", 4, exclude, sid, x, rid, rid, y, radius)
        found = sorted(zip(top["sid"].tolist(), top["dist"].tolist(), top["rid"].tolist()))
        want = [(int(sid[i]), float(d[i, j]), int(j)) for i in range(30) for j in np.lexsort((rid, d[i]))[:4]]
        assert [f[::2] for f in found] == [w[::2] for w in want] and np.allclose([f[1] for f in found], [w[1] for w in want])
        assert AP._reduce("cover", 1, exclude, sid, x, rid, rid, y, radius)["covered"].tolist() == (d < radius).any(axis=1).tolist()
        real = AP._reduce("realism", 1, exclude, sid, x, rid, rid, y, radius)
        assert np.allclose(real["ratio"], (radius / (d + 1e-6)).max(axis=1))


def test_blocks_are_large_and_copies_few():
    assert AP.group_rows(64) == 32768 and AP.group_rows(4096) == 512 and AP.group_rows(1 << 30) == 1
    q, r = AP._grid(300_000, 300_000, AP.group_rows(64), 12)
    assert q == r == 10
    q, r = AP._grid(5000, 1_000_000, 32768, 12)  # few subjects: they are copied, not the references
    assert q <= 2 and r <= 48
    assert AP._grid(50, 60, 32768, 12) == (1, 1)


@pytest.mark.parametrize("kind", ["noise", "far", "tight", "huge", "tiny", "copies", "line"])
def test_single_precision_rules_pairs_out_only(monkeypatch, kind):
    """The k nearest are those of the direct formula, whatever single precision can't tell apart."""
    monkeypatch.setattr(AP, "TILE", 100)
    monkeypatch.setattr(AP, "CHUNK", 30)
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=(70, 12)), rng.normal(size=(450, 12))
    if kind == "far":  # far from the origin, near each other
        x, y = x + 1e6, y + 1e6
    elif kind == "tight":  # clusters whose rows lie within the error of single precision
        c = rng.normal(size=(6, 12)) * 100
        x, y = c[rng.integers(0, 6, 70)] + x * 1e-4, c[rng.integers(0, 6, 450)] + y * 1e-4
    elif kind in ("huge", "tiny"):
        x, y = x * (1e60 if kind == "huge" else 1e-60), y * (1e60 if kind == "huge" else 1e-60)
        y[:3] *= 1e-5
    elif kind == "copies":
        y[:300] = y[0]
        x[:20] = y[0]
    elif kind == "line":
        x, y = np.outer(x[:, 0], np.ones(12)), np.outer(np.arange(450) * 1e-9, np.ones(12))
    sid, rid = np.arange(70), rng.permutation(450)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    top = AP._reduce("topk", 5, False, sid, x, rid, rid, y, None)
    order = np.lexsort((top["rid"], top["dist"], top["sid"]))
    near = [np.lexsort((rid, d[i]))[:5] for i in range(70)]
    assert top["sid"][order].tolist() == np.repeat(sid, 5).tolist()
    assert np.allclose(top["dist"][order], np.concatenate([d[i][n] for i, n in enumerate(near)]), rtol=1e-12, atol=0)
    if kind not in ("line", "far"):
        assert top["rid"][order].tolist() == np.concatenate([rid[n] for n in near]).tolist()


def test_most_products_are_of_single_precision(monkeypatch):
    kinds, whole = [], AP._product
    monkeypatch.setattr(AP, "_product", lambda one, wide, room: kinds.append(room.dtype) or whole(one, wide, room))
    rng = np.random.default_rng(15)
    AP._reduce("topk", 5, False, np.arange(600), rng.normal(size=(600, 64)), np.arange(9000), np.arange(9000), rng.normal(size=(9000, 64)), None)
    assert kinds.count(np.dtype("float32")) > 10 * kinds.count(np.dtype("float64"))


def test_visits_worked_out_at_once_are_bounded_by_parts(spark, monkeypatch):
    """An annulus of many parts is as many visits for a row, all of which a batch holds."""
    monkeypatch.setattr(metric, "ROUTE_CELLS", 1000)
    one = np.ones(1)
    annuli = metric.Annuli(np.zeros((1, 2)), np.zeros(1, np.int64), 0 * one, one, np.array([6400]), np.array([50]), 0 * one)

    def choose(batch, x):
        assert len(x) * 50 <= 1000
        return np.repeat(np.arange(len(x)), 50), np.zeros(50 * len(x), np.int64), np.tile(np.arange(50), len(x))

    subjects = frame(spark, np.zeros((200, 2))).select(F.col("id").alias("sid"), F.col("embedding").alias("svec"))
    assert metric._route(subjects, annuli, choose).distinct().count() == 200 * 50
