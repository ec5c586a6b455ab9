"""XML ingest (FIXTURES X1), file round trips, streaming."""
import os
import tempfile


from seqframe.sources import files as S

ENTRY = ('<records><entry id="C_A"><name>Cluster A</name>'
         '<property type="member count" value="3"/><property type="common taxon" value="Bacteria"/>'
         '<property type="common taxon ID" value="2"/><property type="GO Molecular Function" value="GO:1"/>'
         '<property type="GO Molecular Function" value="GO:2"/><property type="GO Biological Process" value="GO:1"/>'
         '<representativeMember><sequence length="5">MKXBO</sequence></representativeMember></entry></records>')


def test_xml_ingest_fixture_x1(spark):
    d = tempfile.mkdtemp(prefix="seqframe-xml-")
    with open(os.path.join(d, "a.xml"), "w") as f:
        f.write(ENTRY)
    e = S.read_entries(spark, d)
    last = S.flatten_entries(e, last_wins=True).first()
    assert (last.cluster_size, last.common_taxon, last.property_tags) == (3, "Bacteria", ["GO:2", "GO:1"])
    assert (last.sequence, last.sequence_length) == ("MKXBO", 5)
    assert last.source_file.endswith("a.xml")
    allv = S.flatten_entries(e, last_wins=False).first()
    assert allv.property_tags == ["GO:1", "GO:2", "GO:1"]


def test_csv_records_round_trip(spark):
    d = tempfile.mkdtemp(prefix="seqframe-csv-")
    recs = spark.createDataFrame(
        [("c1", "n", 3, "t", ["GO:1", "GO:2"], None, "AAC", 3), ("c2", "n", 1, None, [], None, "A", 1)],
        S.CSV_RECORD_SCHEMA.replace("property_tags string", "property_tags array<string>"))
    S.write_records(recs, os.path.join(d, "r"), rows_per_file=1, fmt="csv")
    parts = [os.path.join(d, "r", f) for f in os.listdir(os.path.join(d, "r")) if f.endswith(".csv")]
    data_rows = [sum(1 for _ in open(p)) - 1 for p in parts]
    assert sum(data_rows) == 2 and max(data_rows) == 1
    back = {r.cluster_id: r.property_tags for r in S.read_records(spark, os.path.join(d, "r"), "csv").collect()}
    assert back == {"c1": ["GO:1", "GO:2"], "c2": []}


def test_runs_partition_pruning(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="seqframe-runs-"), "runs")
    df = spark.createDataFrame([(1, "a", "r1"), (2, "b", "r2")], "id long, gen string, run string")
    S.write_pairs(df, d)
    one = S.read_runs(spark, d, "r2")
    assert [r.id for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(run" in one._jdf.queryExecution().executedPlan().toString()


def test_streams_match_batch(spark):
    import __spark_entry__ as E

    q = E.queries()
    a = {(r.tag, r["count"]) for r in q["stream_token_counts"](spark, "/root/testdata/sf0.001").collect() if r["count"] >= 1000}
    b = {(r.tag, r["count"]) for r in q["tag_counts_min1000"](spark, "/root/testdata/sf0.001").collect()}
    assert a == b
    s = q["stream_ingest"](spark, "/root/testdata/sf0.001")
    p = q["property_bag_values"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, p.collect()))


def test_read_curated_keeps_saved_index(spark):
    d = tempfile.mkdtemp(prefix="seqframe-cur-")
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write(",sequence,tags\n0,AAC,t1 t2\n1,AX,t1\n")
    df = S.read_curated(spark, d, "sequence string, tags string")
    assert sorted((r.id, r.sequence, r.tags) for r in df.collect()) == [(0, "AAC", "t1 t2"), (1, "AX", "t1")]


def test_ingest_stream_resumes_exactly_once(spark):
    """Re-running with the same checkpoint appends nothing; a new source file
    appends only its own rows (the file sink's log + source offsets)."""
    from seqframe.streaming.jobs import ingest_stream

    root = tempfile.mkdtemp(prefix="seqframe-stream-")
    src, out, ck = (os.path.join(root, x) for x in ("src", "out", "ck"))
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.where("event_id < 300").coalesce(1).write.parquet(os.path.join(src, "a"))
    schema = ev.schema

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
        q = ingest_stream(s, lambda df: df.select("event_id", "event_type"), out, ck)
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 300
    assert run() == 300
    ev.where("event_id >= 300 AND event_id < 500").coalesce(1).write.parquet(os.path.join(src, "b"))
    assert run() == 500
    assert spark.read.parquet(out).select("event_id").distinct().count() == 500


def test_token_counts_go_on_after_a_restart(spark):
    """Counts of three files in three batches, stopped in between; a batch's folder is whole, and older ones go."""
    from pyspark.sql import functions as F

    from seqframe.streaming.jobs import file_stream, read_token_counts, token_counts_stream

    root = tempfile.mkdtemp(prefix="seqframe-tokens-")
    src, out, ck = (os.path.join(root, x) for x in ("src", "out", "ck"))
    schema = "w string"

    def run(rows):
        spark.createDataFrame([(w,) for w in rows], schema).coalesce(1).write.mode("append").parquet(src)
        token_counts_stream(spark, file_stream(spark, src, schema), lambda d: d.select(F.col("w").alias("token")), out, ck).awaitTermination()
        return {r.token: (r["count"], r.p) for r in read_token_counts(spark, out).collect()}

    assert run(["a", "b", "a"]) == {"a": (2, 2 / 3), "b": (1, 1 / 3)}
    assert run(["a"]) == {"a": (3, 0.75), "b": (1, 0.25)}
    assert run(["c", "c", "c", "c"]) == {"a": (3, 0.375), "b": (1, 0.125), "c": (4, 0.5)}
    assert len([d for d in os.listdir(out) if d.startswith("epoch=")]) == 2
    os.remove(os.path.join(out, "epoch=2", "_SUCCESS"))  # as if its write had failed
    assert {r.token: r["count"] for r in read_token_counts(spark, out).collect()} == {"a": 3, "b": 1}
