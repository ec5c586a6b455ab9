"""Composite jobs C1-C12 on small fixtures."""
import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F


from seqframe.plans import jobs as J

from .test_curation import X2
from .test_sources_streaming import ENTRY


def records(spark):
    df = spark.createDataFrame(X2, "cluster_id long, common_taxon string, property_tags array<string>, sequence string")
    return df.withColumn("sequence_length", F.length("sequence"))


def test_ingest_and_curate_jobs(spark):
    d = tempfile.mkdtemp(prefix="seqframe-jobs-")
    with open(os.path.join(d, "in.xml"), "w") as f:
        f.write(ENTRY)
    recs = J.ingest_entries(spark, d, os.path.join(d, "records"))
    assert recs.first().property_tags == ["GO:2", "GO:1"]
    out = os.path.join(d, "curated")
    res = J.curate_corpus(records(spark), out, length_col="sequence_length", min_len=2, max_len=5,
                          min_category_count=2, min_tag_count=2, dev_sizes={"train": 1, "val": 1, "test": 1})
    cur = {r.cluster_id: (r.common_taxon, r.tags) for r in res["curated"].collect()}
    assert cur == {1: ("a", ["t1", "t2"]), 2: ("a", ["t1"]), 3: ("b", ["t2", "t3"]), 4: ("root", ["t1", "t3"])}
    assert {"split=train", "split=test"} <= set(os.listdir(os.path.join(out, "splits")))
    tags = spark.read.csv(os.path.join(out, "included_tags")).collect()
    assert [r[0] for r in tags] == ["t1", "t2", "t3"]
    cats = [r[0] for r in spark.read.csv(os.path.join(out, "included_categories")).collect()]
    assert cats == ["a", "b", "root"]


def test_profile_and_encode_jobs(spark):
    recs = records(spark)
    prof = J.profile_corpus(recs, "sequence_length", "common_taxon", "property_tags", "sequence", 2, 5, 2)
    assert {r.value: r["count"] for r in prof["category_counts"].collect()} == {"a": 3, "b": 2}
    assert {r.symbol: r["count"] for r in prof["symbols"].collect()}["A"] == 4
    from seqframe.operators.dictionary import conditioning_dictionary

    cats = spark.createDataFrame([("a", 2), ("b", 2)], "value string, count long")
    tags = spark.createDataFrame([("t1", 3), ("t2", 2), ("t3", 2)], "value string, count long")
    dic = conditioning_dictionary(cats, tags)
    enc = J.encode_corpus_job(recs.where("cluster_id <= 4"), dic, "cluster_id", "sequence", "common_taxon",
                              "property_tags", shuffle=False)
    got = {r.id: r.conditioning_tags for r in enc.collect()}
    assert got[1] == [1, 4, 5] and got[4] == [3, 4, 6]
    batches = J.make_batches(enc, batch_size=2, mode="next_token")
    assert batches.count() == 4 and all(r.x_seq[0] == 22 for r in batches.collect())
    masked = J.mask_corpus(enc, steps=3)
    assert masked.count() == 12


def test_substitution_runs_and_baseline(spark):
    d = tempfile.mkdtemp(prefix="seqframe-runs-")
    seqs = spark.createDataFrame([(1, "ACDEFGHIKL"), (2, "MNPQRSTVWY")], "id long, sequence string")
    runs = J.random_substitution_runs(seqs, os.path.join(d, "runs"), percent=0.5, replicates=2, seed=1)
    assert sorted(r.run for r in runs.select("run").distinct().collect()) == ["rand_50_0", "rand_50_1"]
    res = {r.mode: r.loss for r in J.token_baseline(seqs, seqs, kind="uniform").collect()}
    assert math.isclose(res["nll"], math.log(22))


def test_manifold_and_knn_jobs(spark):
    rng = np.random.default_rng(11)
    ref = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(30)],
                                "id long, embedding array<double>")
    pr = J.manifold_pr(ref, ref, k=3).first()
    assert (pr.precision, pr.recall) == (1.0, 1.0) and pr.realism > 1000
    c0 = spark.createDataFrame([(i,) for i in range(0, 20)], "id long")
    c1 = spark.createDataFrame([(i,) for i in range(15, 30)], "id long")
    out = J.knn_two_class(ref, ref, c0, c1, k=3)
    names = {r.name for r in out["report"].collect()}
    assert {"0", "1", "accuracy", "macro avg", "weighted avg"} <= names
    assert {r.name for r in out["average_precision"].collect()} == {"0", "1", "macro avg"}


def test_pool_and_class_index_jobs(spark):
    tv = spark.createDataFrame([(1, [1.0, 2.0], True), (1, [3.0, 4.0], False)], "g long, v array<double>, m boolean")
    assert J.pool_embeddings(tv, "g", "v", "masked_mean", "m").first().embedding == [1.0, 2.0]
    assert J.pool_embeddings(tv, "g", "v", "mean").first().embedding == [2.0, 3.0]
    pairs = spark.createDataFrame([(1, [0, 5, 7, 5]), (2, [7, 0]), (3, [0, 0])], "id long, tags array<int>")
    got = sorted((r.class_id, r.id) for r in J.class_index(pairs, [5, 7]).collect())
    assert got == [(5, 1), (7, 1), (7, 2)]



def _length_model():
    import numpy as np

    def predict(texts):
        return np.array([[float(len(t)), float(t.count(" "))] for t in texts], dtype=np.float32)

    return predict


def test_embed_pairs_job(spark):
    pairs = spark.createDataFrame([(1, "AAC", "AC"), (2, "MKV", "MKVW"), (3, "G", "GG")],
                                  "id long, orig string, gen string")
    gen = {r.id: r.embedding for r in J.embed_pairs(pairs, _length_model, dim=2).collect()}
    assert gen == {1: [3.0, 1.0], 2: [7.0, 3.0], 3: [3.0, 1.0]}
    orig = {r.id: r.embedding for r in J.embed_pairs(pairs, _length_model, dim=2, use_generated=False,
                                                     spaced_input=False, cap=2).collect()}
    assert orig == {1: [3.0, 0.0], 2: [3.0, 0.0]}
