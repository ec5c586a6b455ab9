"""Registered source / sink, streaming and UDF queries.  Each one derives its
input from the driver tables with Spark, writes it through the sink under
test into the shared checkpoint folder, reads it back through the matching
source and returns the result (compared with the same SQL as in-memory)."""

from __future__ import annotations

import math
import os

from pyspark.sql import functions as F

from ..functions.text import letters, words
from ..operators import manifold as M
from ..operators.hooks import grouped_aggregate
from ..operators.pooling import embed
from ..operators.runs import score_runs
from ..plans import catalog_corpus as CC
from ..session import read_table, scratch_path
from ..sources import files as S
from ..streaming.jobs import entry_stream, file_stream, ingest_stream, read_token_counts, token_counts_stream
from .registry import query
from .standins import ROUND, SQL_LETTERS, SQL_WORDS, documents, embedding_sets, sql_chars

XML_ROWS_PER_FILE = 2000
#: Runs that the subject vectors are dealt to.
N_RUNS = 3


def _xml_entries(spark, sf_dir):
    """One nested ``entry`` record per document (attributes as ``_`` fields,
    repeated ``property`` elements, text content as ``_VALUE``)."""
    d = documents(spark, sf_dir)
    seq = letters("text")

    def prop(t, v):
        return F.struct(F.lit(t).alias("_type"), v.cast("string").alias("_value"))

    return d.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("_id"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"),
        F.array(prop("member count", F.col("n_chars")), prop("common taxon", F.col("lang")),
                prop("common taxon ID", F.col("doc_id")), prop("source", F.col("source")),
                prop("language", F.col("lang")),
                prop("source", F.concat_ws("-", F.col("lang"), F.col("source")))).alias("property"),
        F.struct(F.struct(seq.alias("_VALUE"), F.length(seq).cast("long").alias("_length")).alias("sequence"))
        .alias("representativeMember"))


@query("ingest_xml", "S1 S5 P1 P2 P3 P4 P14 C1 Q1", """
SELECT 'D' || doc_id AS cluster_id, n_chars AS cluster_size, lang AS common_taxon,
  lang || '-' || source || ' ' || lang AS tags, CAST(length(""" + SQL_LETTERS + """) AS INTEGER) AS sequence_length
FROM documents""")
def ingest_xml(spark, sf_dir):
    """XML entries -> flat records -> chunked part files -> read back."""
    xml_dir = scratch_path(spark, "xml")
    (_xml_entries(spark, sf_dir).write.format("xml").option("rootTag", "records").option("rowTag", "entry")
     .option("maxRecordsPerFile", XML_ROWS_PER_FILE).save(xml_dir))
    recs = S.flatten_entries(S.read_entries(spark, xml_dir), last_wins=True)
    out_dir = scratch_path(spark, "records")
    S.write_records(recs, out_dir, rows_per_file=XML_ROWS_PER_FILE)
    back = spark.read.parquet(out_dir)
    return back.select("cluster_id", "cluster_size", "common_taxon",
                       F.array_join("property_tags", " ").alias("tags"), "sequence_length")


@query("io_roundtrip", "S2 S5 F1 F3", f"""
SELECT CAST(doc_id AS VARCHAR) AS cluster_id, lang AS common_taxon, CAST(len({SQL_WORDS}) AS INTEGER) AS n_tags,
  CAST(n_chars AS BIGINT) AS cluster_size FROM documents""")
def io_roundtrip(spark, sf_dir):
    """Records -> CSV part files with list-repr tags -> parallel CSV scan ->
    tags parsed back by the quoted-token regex (F1)."""
    d = documents(spark, sf_dir)
    recs = d.select(F.col("doc_id").cast("string").alias("cluster_id"), F.col("source").alias("cluster_name"),
                    F.col("n_chars").alias("cluster_size"), F.col("lang").alias("common_taxon"),
                    words("text").alias("property_tags"), F.lit(None).cast("long").alias("last_line_num"),
                    letters("text").alias("sequence"), F.length(letters("text")).alias("sequence_length"))
    path = scratch_path(spark, "records-csv")
    S.write_records(recs, path, rows_per_file=2000, fmt="csv")
    back = S.read_records(spark, path, fmt="csv")
    return back.select("cluster_id", "common_taxon", F.size("property_tags").alias("n_tags"), "cluster_size")


@query("curated_split_sizes", "S6 S7 S4 W3 C2", f"""
WITH {CC.SQL_FILT}, {CC.SQL_CATS}, {CC.SQL_EX}, {CC.SQL_TAGC},
reg AS (SELECT ex.doc_id FROM ex JOIN tc ON ex.tag = tc.value GROUP BY ex.doc_id),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', {CC.SPLIT_SEED}, doc_id)), doc_id) AS r,
  count(*) OVER () AS n FROM reg),
spl AS (SELECT CASE WHEN r <= floor(n * {CC.TRAIN_FRAC!r}::DOUBLE) THEN 'train'
  WHEN r <= floor(n * {CC.VAL_END!r}::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM rk)
SELECT split, count(*) AS count FROM spl GROUP BY split""")
def curated_split_sizes(spark, sf_dir):
    """C2 end to end: curated rows split by seeded hash, written one folder
    per split with the dictionaries, read back by split-partition discovery."""
    from .jobs import curate_corpus

    out = scratch_path(spark, "curated")
    f = CC._filtered(spark, sf_dir)
    curate_corpus(f, out, id_col="id", category_col="category", tags_col="tags", min_category_count=CC.MIN_CAT,
                  min_tag_count=CC.MIN_TAG, seed=CC.SPLIT_SEED, val_frac=CC.VAL_FRAC, test_frac=CC.TEST_FRAC)
    back = spark.read.parquet(os.path.join(out, "splits"))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("count"))


@query("dictionary_files", "S7 S4 W4", f"""
WITH {CC.SQL_TAGGED}, {CC.SQL_EX}, {CC.SQL_TAGC} SELECT value, CAST(count AS BIGINT) AS count FROM tc""")
def dictionary_files(spark, sf_dir):
    """Tag dictionary written headerless in index order and read back."""
    return _reloaded_tags(spark, sf_dir).select("value", "count")


def _reloaded_tags(spark, sf_dir):
    _, dic = CC.conditioning_dictionary_of(spark, sf_dir)
    path = scratch_path(spark, "tags-dict")
    S.write_dictionary(dic.where(F.col("kind") == "tag"), path, with_counts=True)
    return S.read_dictionary(spark, path)


@query("dictionary_reload_ids", "S4 S7 W4 T1", f"""
WITH {CC.SQL_TAGGED}, {CC.SQL_EX}, {CC.SQL_TAGC}
SELECT value, CAST(row_number() OVER (ORDER BY count DESC, value) AS INTEGER) AS idx FROM tc""")
def dictionary_reload_ids(spark, sf_dir):
    """The order of the lines of a dictionary file gives its ids."""
    return _reloaded_tags(spark, sf_dir).select("value", "idx")


@query("manifold_roundtrip", "S10 S11", f"""
WITH e AS (SELECT vec_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 'ref' ELSE 'subject' END AS set FROM embeddings),
d AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
  lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS dist FROM e a JOIN e b ON a.set = 'ref' AND b.set = 'ref'),
rk AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM d)
SELECT vec_id, round(max(dist), {ROUND}) AS radius FROM rk WHERE rn <= 4 GROUP BY vec_id""")
def manifold_roundtrip(spark, sf_dir):
    """Embedding set and its manifold saved as Parquet and reloaded (the
    reference's precomputed-reference reuse)."""
    e = embedding_sets(spark, sf_dir).where(F.col("set") == "ref")
    emb_path, man_path = scratch_path(spark, "emb"), scratch_path(spark, "manifold")
    S.write_embeddings(e, emb_path)
    m = M.compute_manifold(S.read_embeddings(spark, emb_path), 3)
    S.write_manifold(m, man_path)
    back = S.read_manifold(spark, man_path)
    return back.select(F.col("id").alias("vec_id"), F.round("radius", ROUND).alias("radius"))


@query("run_partitions", "S9 S13 S8 U4", f"""
WITH {CC.SQL_SUB} SELECT item_id, array_to_string(gc, '') AS gen, CAST(len(c) AS INTEGER) AS tag0
FROM g WHERE replicate = 1""")
def run_partitions(spark, sf_dir):
    """Substitution replicates stored as named runs (``run=rand_25_<r>``), one
    run read back by partition pruning; the CSV pair format with an int-list
    tag literal is written and parsed as well."""
    subs = CC._substituted(spark, sf_dir)
    pairs = subs.select(F.col("id").alias("item_id"), "orig", "gen",
                        F.array(F.length("orig"), F.col("replicate")).alias("tags"),
                        F.concat(F.lit(f"rand_{int(CC.SUB_PERCENT * 100)}_"), F.col("replicate").cast("string"))
                        .alias("run"))
    root = scratch_path(spark, "runs")
    S.write_pairs(pairs, root)
    one = S.read_runs(spark, root, run=f"rand_{int(CC.SUB_PERCENT * 100)}_1")
    csv_path = scratch_path(spark, "pairs-csv")
    (one.select(F.col("orig").alias("orig_protein_string"), F.to_json("tags").alias("orig_protein_tags"),
                F.col("gen").alias("gen_protein_string"), "item_id")
     .write.option("header", True).csv(csv_path))
    back = spark.read.schema("orig_protein_string string, orig_protein_tags string, gen_protein_string string, "
                             "item_id long").option("header", True).csv(csv_path)
    return back.select("item_id", F.col("gen_protein_string").alias("gen"),
                       F.element_at(F.from_json("orig_protein_tags", "array<int>"), 1).alias("tag0"))


def _metrics_sql() -> str:
    from .catalog_vectors import SQL_CROSS, SQL_E, SQL_RAD

    return f"""
WITH {SQL_E}, {SQL_RAD}, {SQL_CROSS},
cov AS (SELECT sid, sset, bool_or(dist < rrad) AS covered FROM cr GROUP BY sid, sset)
SELECT 'embeddings' AS emb, 'none' AS pooling, 3 AS k, 'subject' AS run,
  round(avg(CASE WHEN sset = 'subject' THEN covered::INT END), {ROUND}) AS precision,
  round(avg(CASE WHEN sset = 'ref' THEN covered::INT END), {ROUND}) AS recall FROM cov"""


@query("metrics_sink", "S12 C8", _metrics_sql())
def metrics_sink(spark, sf_dir):
    """Manifold metrics written as JSON under (emb, pooling, k, run) folders."""
    from .catalog_vectors import manifold_precision_recall

    pr = manifold_precision_recall(spark, sf_dir)
    rows = pr.select(F.lit("embeddings").alias("emb"), F.lit("none").alias("pooling"), F.lit(3).alias("k"),
                     F.lit("subject").alias("run"), "precision", "recall")
    path = scratch_path(spark, "metrics")
    S.write_metrics(rows, path)
    return spark.read.json(path)


def _run_metrics_sql() -> str:
    from .catalog_vectors import SQL_RAD, sql_dist

    return f"""
WITH e AS (SELECT vec_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 'ref' ELSE 'run_' || (vec_id // 2 % {N_RUNS}) END AS set
  FROM embeddings), {SQL_RAD},
cr AS (SELECT s.vec_id, s.set AS sset, r.set AS rset, r.radius AS rrad, {sql_dist('s.embedding', 'r.embedding')} AS dist
  FROM rad s JOIN rad r ON (s.set = 'ref') <> (r.set = 'ref')),
cov AS (SELECT vec_id, sset, rset, bool_or(dist < rrad) AS covered, max(rrad / (dist + 1e-6)) AS realism
  FROM cr GROUP BY vec_id, sset, rset),
p AS (SELECT sset AS run, count(*) AS n, avg(covered::INT) AS precision, max(realism) AS realism FROM cov WHERE rset = 'ref' GROUP BY sset),
q AS (SELECT rset AS run, avg(covered::INT) AS recall FROM cov WHERE sset = 'ref' GROUP BY rset)
SELECT run, CAST(n AS BIGINT) AS n, round(precision, {ROUND}) AS precision, round(recall, {ROUND}) AS recall,
  round(realism, {ROUND}) AS realism FROM p JOIN q USING (run)"""


@query("run_metrics", "C8 S11 S12 S13 A10 A11", _run_metrics_sql())
def run_metrics(spark, sf_dir):
    """Three runs stored under ``run=`` folders, scored against one saved
    reference manifold; a metric row for each run goes to the JSON sink."""
    e = embedding_sets(spark, sf_dir)
    man_path, root, out = (scratch_path(spark, n) for n in ("run-reference", "run-embeddings", "run-metrics"))
    S.write_manifold(M.compute_manifold(e.where(F.col("set") == "ref"), 3), man_path)
    named = F.concat(F.lit("run_"), F.pmod(F.floor(F.col("id") / 2), F.lit(N_RUNS)).cast("string"))
    S.write_pairs(e.where(F.col("set") == "subject").select("id", "embedding", named.alias("run")), root)
    S.write_metrics(score_runs(S.read_manifold(spark, man_path), S.read_runs(spark, root)), out)
    back = spark.read.schema("n long, precision double, recall double, realism double, run string").json(out)
    return back.select("run", "n", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "realism")])


# -------------------------------------------------------------- streaming
@query("stream_token_counts", "R1 A7", f"""
SELECT tag, count(*) AS count FROM (SELECT unnest({SQL_WORDS}) AS tag FROM documents)
GROUP BY tag""")
def stream_token_counts(spark, sf_dir):
    """The documents arrive in several files, half of them after the
    stream was stopped; it goes on from its checkpoint with the counts so far."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    files = scratch_path(spark, "stream-documents")
    out, ck = scratch_path(spark, "stream-counts"), scratch_path(spark, "stream-counts-ck")

    def tokens(df):
        return (df.select(F.explode_outer(words("text")).alias("token")).where(F.col("token").isNotNull()))

    later = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1, F.lit(False))
    # a file for each core, two micro-batches for each half: no file is one task's work while others idle
    many = 2 * math.ceil(spark.sparkContext.defaultParallelism / 2)
    for part in (~later, later):
        d.where(part).repartition(many).write.mode("append").parquet(files)
        token_counts_stream(spark, file_stream(spark, files, d.schema, files_per_trigger=many // 2), tokens, out, ck).awaitTermination()
    return read_token_counts(spark, out).select(F.col("token").alias("tag"), "count")


@query("stream_ingest_xml", "R2 S1 P1 P2 P3 P4 Q1", """
SELECT 'D' || doc_id AS cluster_id, n_chars AS cluster_size, lang AS common_taxon,
  lang || '-' || source || ' ' || lang AS tags, CAST(length(""" + SQL_LETTERS + """) AS INTEGER) AS sequence_length
FROM documents""")
def stream_ingest_xml(spark, sf_dir):
    """R2: XML files consumed as a stream; records flattened like in the batch job."""
    xml_dir, out, ck = (scratch_path(spark, n) for n in ("stream-xml", "stream-records", "stream-records-ck"))
    (_xml_entries(spark, sf_dir).repartition(4).write.format("xml").option("rootTag", "records").option("rowTag", "entry")
     .option("maxRecordsPerFile", XML_ROWS_PER_FILE).save(xml_dir))
    ingest_stream(entry_stream(spark, xml_dir), S.flatten_entries, out, ck).awaitTermination()
    return spark.read.parquet(out).select("cluster_id", "cluster_size", "common_taxon", F.array_join("property_tags", " ").alias("tags"), "sequence_length")


@query("grouped_hook", "X2", "SELECT user_id, round(median(value), 6) AS median, CAST(count(*) AS BIGINT) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id")
def grouped_hook(spark, sf_dir):
    """A function of the user's own over the values of each group."""
    e = read_table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    found = grouped_aggregate(e, ["user_id"], "value", lambda x: float(x.median()), "double", out_col="median")
    return found.select("user_id", F.round("median", 6).alias("median"), "n")


@query("stream_ingest", "R2 P3 P4 F23", """
SELECT event_id, json_extract_string(props, '$.k') AS k,
  CAST(len(list_filter(json_keys(props), lambda x: x <> 'k')) AS INTEGER) AS n_rest FROM events""")
def stream_ingest(spark, sf_dir):
    """R2: events consumed as a stream, property bags flattened per row and
    appended to Parquet part files with a checkpointed file sink."""
    schema = read_table(spark, sf_dir, "events").schema
    src = file_stream(spark, sf_dir, schema, pattern="events.parquet")
    out, ck = scratch_path(spark, "stream-ingest"), scratch_path(spark, "stream-ingest-ck")

    def flatten(df):
        m = F.from_json("props", "map<string,string>")
        return df.select("event_id", m.alias("_m")).select(
            "event_id", F.col("_m")["k"].alias("k"),
            F.size(F.map_values(F.map_filter("_m", lambda k, v: k != F.lit("k")))).alias("n_rest"))

    q = ingest_stream(src, flatten, out, ck)
    q.awaitTermination()
    return spark.read.parquet(out)


# -------------------------------------------------------------------- UDF
def letter_frequency_model():
    """A stand-in 'model' for X4: letter frequencies (26-d) of each string."""
    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), 26), dtype=np.float64)
        for r, t in enumerate(texts):
            if t:
                codes = np.frombuffer(t.encode("ascii", "ignore"), dtype=np.uint8).astype(np.int64) - 65
                codes = codes[(codes >= 0) & (codes < 26)]
                if len(codes):
                    out[r] = np.bincount(codes, minlength=26) / len(t)
        return out

    return predict


@query("embed_udf", "X4 X1 C11", f"""
WITH c AS (SELECT item_id, {SQL_LETTERS} AS s FROM benchmark)
SELECT item_id, CAST(dim AS INTEGER) AS dim,
  round(CASE WHEN length(s) = 0 THEN 0 ELSE (length(s) - length(replace(s, chr(CAST(65 + dim AS INTEGER)), ''))) / length(s) END, {ROUND}) AS value
FROM c, (SELECT unnest(range(26)) AS dim)""")
def embed_udf(spark, sf_dir):
    """Batched model inference over a string column on the executors,
    then the vectors exploded to (dim, value)."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", letters("text").alias("s"))
    e = embed(b, "s", letter_frequency_model, dim=26, batch_size=32, element_type="double")
    long = e.select("item_id", F.posexplode("embedding").alias("dim", "v"))
    return long.select("item_id", "dim", F.round(F.col("v").cast("double"), ROUND).alias("value"))
