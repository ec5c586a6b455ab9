"""Input that must raise or be told apart, rather than give a wrong answer."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqframe.operators import allpairs as AP
from seqframe.operators.baseline import cross_entropies
from seqframe.operators.knn import neighbour_votes
from seqframe.operators.manifold import compute_manifold
from seqframe.operators.metrics import average_precision
from seqframe.operators.ranking import range_bucket
from seqframe.sources import files as S


def test_unsound_vectors_raise(spark):
    rows = [(i, [float(i), 1.0]) for i in range(9)]
    for bad in (None, [float("nan"), 1.0], [None, 1.0], [float("inf"), 0.0]):
        df = spark.createDataFrame([*rows, (9, bad)], "id long, embedding array<double>")
        with pytest.raises(ValueError, match="1 of 10 vectors"):
            compute_manifold(df, 3)
    df = spark.createDataFrame([*rows, (9, [1.0])], "id long, embedding array<double>")
    with pytest.raises(ValueError, match="1 to 2 components"):
        compute_manifold(df, 3)


def test_exclude_self_compares_ids(spark):
    rows = [(i, [float(i * i)], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, y int")
    votes = {r.id: r.p1 for r in neighbour_votes(df.select("id", "embedding"), df, k=1, exclude_self=True).collect()}
    want = {}
    for i, v, _ in rows:
        want[i] = float(min((abs(v[0] - w[0]), j, y) for j, w, y in rows if j != i)[2])
    assert votes == want
    with pytest.raises(ValueError, match="class other than 0 or 1"):
        neighbour_votes(df.select("id", "embedding"), df.withColumn("y", F.lit(2)), k=1)


def test_duplicates_are_folded_in_chunks():
    n = 700
    left = pd.DataFrame({"sid": np.arange(n), "svec": [[1.0, 2.0]] * n})
    right = pd.DataFrame({"rid": np.arange(n), "rself": np.arange(n), "rvec": [[1.0, 2.0]] * n, "rradius": [0.0] * n})
    top = AP._kernel("topk", 3, False)(left, right)
    assert len(top) == 3 * n and (top.dist == 0).all() and set(top.rid) == {0, 1, 2}
    assert not AP._kernel("cover", 1, False)(left, right).covered.any()
    assert (AP._kernel("realism", 1, False)(left, right).ratio == 0).all()


def test_unseen_token_costs_infinity(spark):
    probs = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 0.5), (3, 0.0)], "token_id int, p double")
    seen = spark.createDataFrame([(1, 3), (2, 1)], "token_id int, count long")
    loss = {r["mode"]: r.loss for r in cross_entropies(seen, probs).collect()}
    assert loss["nll"] == pytest.approx(np.log(2))
    for token in (3, 9):  # of probability 0, and not in the table
        more = seen.union(spark.createDataFrame([(token, 1)], "token_id int, count long"))
        assert {r["mode"]: r.loss for r in cross_entropies(more, probs).collect()}["nll"] == float("inf")


def test_null_scores_and_bucket_counts_raise(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None), (1, 0.2)], "y int, s double")
    with pytest.raises(Exception, match="null or NaN score"):
        average_precision(df, "y", "s").collect()
    with pytest.raises(ValueError, match="nbuckets"):
        range_bucket(df, "s", 0)


def test_csv_quotes_commas_and_line_breaks(spark, tmp_path):
    name = 'say "hi", x\nand it\'s'
    recs = spark.createDataFrame([("c1", name, 3, "t", ["GO:1", "GO:2"], "AAC", 3)], S.RECORD_SCHEMA)
    # another column order than the schema's
    S.write_records(recs.select("sequence", "sequence_length", "cluster_id", "cluster_name", "cluster_size", "common_taxon", "property_tags"), str(tmp_path / "r"), fmt="csv")
    back = S.read_records(spark, str(tmp_path / "r"), "csv").first()
    assert (back.cluster_id, back.cluster_name, back.cluster_size, back.property_tags, back.sequence, back.sequence_length) == ("c1", name, 3, ["GO:1", "GO:2"], "AAC", 3)
    with open(tmp_path / "curated.csv", "w") as f:
        f.write(',name,n\n7,"a, ""b""",5\n')
    row = S.read_curated(spark, str(tmp_path / "curated.csv"), "n int, name string").first()
    assert (row.id, row.n, row.name) == (7, 5, 'a, "b"')
    with pytest.raises(ValueError, match="lacks the columns other"):
        S.read_curated(spark, str(tmp_path / "curated.csv"), "other string")


def test_pairs_with_and_without_tags(spark, tmp_path):
    with open(tmp_path / "three.csv", "w") as f:
        f.write('orig_protein_string,orig_protein_tags,gen_protein_string\nAAC,"[1, 2]",ACC\n')
    with open(tmp_path / "two.csv", "w") as f:
        f.write("orig_protein_string,gen_protein_string\nAAC,ACC\n")
    three, two = (S.read_pairs(spark, str(tmp_path / f"{n}.csv")).first() for n in ("three", "two"))
    assert (three.orig, three.tags, three.gen) == ("AAC", [1, 2], "ACC") and (two.orig, two.tags, two.gen) == ("AAC", None, "ACC")
