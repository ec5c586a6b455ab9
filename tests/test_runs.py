"""Many runs against one reference: equal to scoring each run alone."""
import numpy as np
import pytest

from seqframe.operators import manifold as M
from seqframe.operators.runs import score_runs
from seqframe.sources import files as S


def _frame(spark, rows, runs=None):
    data = [(i, [float(x) for x in v]) if runs is None else (i, [float(x) for x in v], runs[i]) for i, v in rows]
    return spark.createDataFrame(data, "id long, embedding array<float>" + ("" if runs is None else ", run string"))


@pytest.fixture(scope="module")
def reference(spark):
    rng = np.random.default_rng(4)
    return M.compute_manifold(_frame(spark, list(enumerate(rng.normal(size=(40, 3))))), 3)


def test_score_runs_equals_each_run_alone(spark, reference, tmp_path):
    rng = np.random.default_rng(5)
    parts = []
    for name, shift in (("near", 0.0), ("far", 4.0), ("odd name=1", 1.0)):
        # the same ids in every run
        parts.append([(i, [float(x) for x in v], name) for i, v in enumerate(rng.normal(size=(25, 3)) + shift)])
    path = str(tmp_path / "runs")
    S.write_pairs(spark.createDataFrame(sum(parts, []), "id long, embedding array<float>, run string"), path)
    got = {r.run: r for r in score_runs(reference, S.read_runs(spark, path)).collect()}
    assert set(got) == {"near", "far", "odd name=1"}
    for name, r in got.items():
        own = S.read_runs(spark, path, run=name)
        pr = M.precision_recall(reference, M.compute_manifold(own, 3)).first()
        best = max(x.realism for x in M.realism(reference, own).collect())
        assert (r.n, r.precision, r.recall) == (25, pytest.approx(pr.precision), pytest.approx(pr.recall))
        assert r.realism == pytest.approx(best)


def test_score_runs_cases(spark, reference):
    schema = "id long, embedding array<float>, run string"
    assert score_runs(reference, spark.createDataFrame([], schema)).count() == 0
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v], None if i % 2 else "a") for i, v in enumerate(rng.normal(size=(20, 3)))]
    got = {r.run: r.n for r in score_runs(reference, spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: 10, "a": 10}
    with pytest.raises(ValueError):
        score_runs(reference, spark.createDataFrame(rows[:3], schema))
