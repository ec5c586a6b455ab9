"""Blocked all-pairs kernel, manifolds, k-NN, report, AP, pooling
(FIXTURES M1, M2, K1, K2, K3, P1) and brute-force equality."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.operators import allpairs as AP
from seqframe.operators import manifold as M
from seqframe.operators.knn import class_union, neighbour_votes
from seqframe.operators.metrics import average_precision, classification_report
from seqframe.operators.pooling import masked_mean_pool, mean_pool, to_vectors


def vecs(spark, values, start=0):
    rows = [(start + i, [float(v)] if not isinstance(v, list) else [float(x) for x in v])
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_manifold_fixture_m1(spark):
    ref, sub = vecs(spark, [0, 1, 3, 7]), vecs(spark, [1.5, 5, 20, 2])
    mr, ms = M.compute_manifold(ref, 1), M.compute_manifold(sub, 1)
    assert [r.radius for r in mr.orderBy("id").collect()] == [1, 1, 2, 4]
    assert [r.radius for r in ms.orderBy("id").collect()] == [0.5, 3, 15, 0.5]
    pr = M.precision_recall(mr, ms).first()
    assert (pr.precision, pr.recall) == (0.75, 0.5)
    assert [r.covered for r in M.covered_rows(mr, sub).orderBy("id").collect()] == [True, True, False, True]
    rl = [round(r.realism, 6) for r in M.realism(mr, sub).orderBy("id").collect()]
    assert rl == [1.999996, 1.999999, 0.307692, 1.999998]
    al = M.realism_aligned(mr, sub, "id", "id").first().realism
    assert round(al, 6) == 0.8


def test_manifold_duplicates_m2(spark):
    ref = vecs(spark, [0, 0, 0, 5])
    mr = M.compute_manifold(ref, 2)
    assert [r.radius for r in mr.orderBy("id").collect()] == [0, 0, 0, 5]
    assert M.covered_rows(mr, vecs(spark, [0], 10)).first().covered is False
    with pytest.raises(ValueError):
        M.compute_manifold(vecs(spark, [0, 1, 2]), 2)


def test_knn_fixture_k1(spark):
    ref = vecs(spark, [0, 1, 3, 7]).withColumn("y", F.when(F.col("id") < 2, 0).otherwise(1))
    q = vecs(spark, [1.5, 3, 6], 10)
    u = {r.id: r.p1 for r in neighbour_votes(q, ref, k=3).collect()}
    d = {r.id: r.p1 for r in neighbour_votes(q, ref, k=3, weights="distance").collect()}
    assert [round(u[i], 6) for i in (10, 11, 12)] == [0.333333, 0.333333, 0.666667]
    assert [round(d[i], 6) for i in (10, 11, 12)] == [0.2, 1.0, 0.869565]
    nn = AP.knn(q, ref.drop("y"), 3)
    assert [r.rid for r in nn.where("sid = 10").orderBy("nn_rank").collect()] == [1, 0, 2]


def test_class_union_keeps_duplicates(spark):
    a = vecs(spark, [1, 2])
    u = class_union(a, a.where("id = 0"))
    assert sorted((r.id, r.y) for r in u.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_report_fixture_k2(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1], [0, 0, 1, 1, 0])), "y int, pred int")
    r = {x.name: x for x in classification_report(df).collect()}
    assert math.isclose(r["0"].precision, 2 / 3) and math.isclose(r["0"].f1_score, 2 / 3) and r["0"].support == 3
    assert math.isclose(r["1"].recall, 0.5) and r["1"].support == 2
    assert math.isclose(r["accuracy"].f1_score, 0.6)
    assert math.isclose(r["macro avg"].f1_score, 7 / 12) and math.isclose(r["weighted avg"].f1_score, 0.6)


def test_average_precision_fixture_k3(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8)], "y int, s double")
    assert round(average_precision(df, "y", "s").first().avg_prec, 6) == 0.833333


def test_average_precision_matches_step_formula(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)
    order = sorted(set(s), reverse=True)
    tp_tot, ap, ctp, cn = y.sum(), 0.0, 0, 0
    for t in order:
        m = s == t
        ctp += y[m].sum()
        cn += m.sum()
        ap += y[m].sum() / tp_tot * (ctp / cn)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert abs(average_precision(df, "y", "s").first().avg_prec - ap) < 1e-12


def test_pooling_fixture_p1(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], True), (1, [3.0, 4.0], True), (1, [9.0, 9.0], False)],
                               "g int, v array<double>, m boolean")
    mean = to_vectors(mean_pool(df, "g", "v"), "g").first().embedding
    masked = to_vectors(masked_mean_pool(df, "g", "v", "m"), "g").first().embedding
    assert [round(x, 6) for x in mean] == [4.333333, 5.0] and masked == [2.0, 3.0]


@pytest.mark.parametrize("block_rows", [7, 64])
def test_blocked_kernel_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    y = rng.normal(size=(45, 5))
    y[3] = x[7]  # an exact duplicate across the sets
    sub = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    ref = spark.createDataFrame([(100 + i, [float(v) for v in r]) for i, r in enumerate(y)],
                                "id long, embedding array<double>")
    d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1))
    k = 4
    nn = AP.knn(sub, ref, k, block_rows=block_rows).collect()
    got = {}
    for r in nn:
        got.setdefault(r.sid, []).append((r.nn_rank, r.rid))
    for i in range(60):
        want = [100 + j for j in sorted(range(45), key=lambda j: (d[i, j], j))[:k]]
        assert [rid for _, rid in sorted(got[i])] == want
    mr = M.compute_manifold(ref, 3, block_rows=block_rows)
    radii = {r.id: r.radius for r in mr.collect()}
    dy = np.sqrt(((y[:, None, :] - y[None, :, :]) ** 2).sum(-1))
    for j in range(45):
        assert abs(radii[100 + j] - np.sort(dy[j])[3]) < 1e-12
    cov = {r.id: r.covered for r in M.covered_rows(mr, sub, block_rows=block_rows).collect()}
    rv = np.array([radii[100 + j] for j in range(45)])
    for i in range(60):
        assert cov[i] == bool((d[i] < rv).any())
    real = {r.id: r.realism for r in M.realism(mr, sub, block_rows=block_rows).collect()}
    for i in range(60):
        assert abs(real[i] - (rv / (d[i] + 1e-6)).max()) < 1e-6 * max(1.0, real[i])


def test_self_manifold_precision_recall_is_one(spark):
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(40)],
                              "id long, embedding array<double>")
    m = M.compute_manifold(e, 3)
    pr = M.precision_recall(m, m).first()
    assert (pr.precision, pr.recall) == (1.0, 1.0)


def test_average_precision_ovr_matches_single_class(spark):
    from seqframe.operators.metrics import average_precision_ovr

    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    p1 = np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(1 - b), float(b)) for a, b in zip(y, p1)], "y int, s0 double, s1 double")
    got = {r.name: r.avg_prec for r in average_precision_ovr(df, "y", {0: "s0", 1: "s1"}).collect()}
    for c in (0, 1):
        want = average_precision(df.select("y", F.col(f"s{c}").alias("s")), "y", "s", positive=c).first().avg_prec
        assert abs(got[str(c)] - want) < 1e-12
    assert abs(got["macro avg"] - (got["0"] + got["1"]) / 2) < 1e-12


def test_plan_shape_has_no_cross_join_for_knn(spark):
    from seqframe.plans.explain import shape

    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(20)],
                              "id long, embedding array<double>")
    nn = AP.knn(e, e, 2)
    nn.write.format("noop").mode("overwrite").save()
    s = shape(nn)
    assert s["cartesian"] == 0 and s["nested_loop_join"] == 0 and s["python"] >= 1
