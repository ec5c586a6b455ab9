"""Registered embedding-set queries: distances, manifolds, coverage,
realism, k-NN classification, report, average precision, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allpairs as AP
from ..operators import manifold as M
from ..operators.knn import class_union, neighbour_votes, predict
from ..operators.metrics import average_precision, classification_report
from ..operators.pooling import masked_mean_pool, mean_pool
from .registry import query
from .standins import ROUND, SQL_EMB_SETS, embedding_sets, sql_dist

K_MANIFOLD = 3
K_NN = 5
#: Rows of a block where a query is to lay out the references by space on the given tables too; the default is larger.
SMALL_BLOCKS = 32

SQL_E = f"e AS ({SQL_EMB_SETS})"
SQL_RAD = f"""d AS (SELECT a.vec_id, a.set, {sql_dist('a.embedding', 'b.embedding')} AS dist
  FROM e a JOIN e b ON a.set = b.set),
rk AS (SELECT vec_id, set, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM d),
rad0 AS (SELECT vec_id, set, max(dist) AS radius FROM rk WHERE rn <= {K_MANIFOLD + 1} GROUP BY vec_id, set),
rad AS (SELECT rad0.*, e.embedding FROM rad0 JOIN e USING (vec_id, set))"""
SQL_CROSS = f"""cr AS (SELECT s.vec_id AS sid, s.set AS sset, r.radius AS rrad, {sql_dist('s.embedding', 'r.embedding')} AS dist
  FROM rad s JOIN rad r ON s.set <> r.set)"""


def _sets(spark, sf_dir):
    e = embedding_sets(spark, sf_dir)
    return e.where(F.col("set") == "ref"), e.where(F.col("set") == "subject")


def _manifolds(spark, sf_dir, **options):
    ref, sub = _sets(spark, sf_dir)
    return M.compute_manifold(ref, K_MANIFOLD, **options), M.compute_manifold(sub, K_MANIFOLD, **options)


@query("kth_radius", "J5 W1 T3 F22 S11", f"""
WITH {SQL_E}, {SQL_RAD} SELECT CAST(vec_id AS BIGINT) AS vec_id, set, round(radius, {ROUND}) AS radius FROM rad""")
def kth_radius(spark, sf_dir):
    mr, ms = _manifolds(spark, sf_dir, block_rows=SMALL_BLOCKS)
    out = mr.withColumn("set", F.lit("ref")).unionByName(ms.withColumn("set", F.lit("subject")))
    return out.select(F.col("id").alias("vec_id"), "set", F.round("radius", ROUND).alias("radius"))


@query("pairwise_l2_nearest", "J5 F22 W2", f"""
WITH {SQL_E},
d AS (SELECT s.vec_id, r.vec_id AS nn_id, {sql_dist('s.embedding', 'r.embedding')} AS dist
  FROM e s JOIN e r ON s.set = 'subject' AND r.set = 'ref'),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nn_id) AS rn FROM d)
SELECT vec_id, nn_id, round(dist, {ROUND}) AS dist FROM rk WHERE rn = 1""")
def pairwise_l2_nearest(spark, sf_dir):
    ref, sub = _sets(spark, sf_dir)
    nn = AP.knn(sub, ref, 1)
    return nn.select(F.col("sid").alias("vec_id"), F.col("rid").alias("nn_id"), F.round("dist", ROUND).alias("dist"))


@query("manifold_precision_recall", "J6 A10 C8", f"""
WITH {SQL_E}, {SQL_RAD}, {SQL_CROSS},
cov AS (SELECT sid, sset, bool_or(dist < rrad) AS covered FROM cr GROUP BY sid, sset)
SELECT round(avg(CASE WHEN sset = 'subject' THEN covered::INT END), {ROUND}) AS precision,
  round(avg(CASE WHEN sset = 'ref' THEN covered::INT END), {ROUND}) AS recall FROM cov""")
def manifold_precision_recall(spark, sf_dir):
    mr, ms = _manifolds(spark, sf_dir)
    pr = M.precision_recall(mr, ms)
    return pr.select(F.round("precision", ROUND).alias("precision"), F.round("recall", ROUND).alias("recall"))


@query("covered_rows", "J6 J9", f"""
WITH {SQL_E}, {SQL_RAD}, {SQL_CROSS}
SELECT sid AS vec_id, sset AS set, bool_or(dist < rrad) AS covered FROM cr GROUP BY sid, sset""")
def covered_rows(spark, sf_dir):
    mr, ms = _manifolds(spark, sf_dir)
    a = M.covered_rows(mr, ms, block_rows=SMALL_BLOCKS).withColumn("set", F.lit("subject"))
    b = M.covered_rows(ms, mr, block_rows=SMALL_BLOCKS).withColumn("set", F.lit("ref"))
    return a.unionByName(b).select(F.col("id").alias("vec_id"), "set", "covered")


@query("realism_per_vector", "A11", f"""
WITH {SQL_E}, {SQL_RAD}, {SQL_CROSS}
SELECT sid AS vec_id, round(max(rrad / (dist + 1e-6)), {ROUND}) AS realism FROM cr WHERE sset = 'subject'
GROUP BY sid""")
def realism_per_vector(spark, sf_dir):
    ref, sub = _sets(spark, sf_dir)
    mr = M.compute_manifold(ref, K_MANIFOLD)
    r = M.realism(mr, sub, block_rows=SMALL_BLOCKS)
    return r.select(F.col("id").alias("vec_id"), F.round("realism", ROUND).alias("realism"))


@query("realism_aligned", "A12 J7 Q7", f"""
WITH {SQL_E}, {SQL_RAD}
SELECT round(max(r.radius / ({sql_dist('r.embedding', 's.embedding')} + 1e-6)), {ROUND}) AS realism
FROM rad r JOIN e s ON r.set = 'ref' AND s.set = 'subject' AND r.vec_id // 2 = s.vec_id // 2""")
def realism_aligned(spark, sf_dir):
    ref, sub = _sets(spark, sf_dir)
    mr = M.compute_manifold(ref, K_MANIFOLD).withColumn("pos", F.floor(F.col("id") / 2))
    s = sub.withColumn("pos", F.floor(F.col("id") / 2))
    r = M.realism_aligned(mr, s, "pos", "pos")
    return r.select(F.round("realism", ROUND).alias("realism"))


@query("distance_guard", "A13")
def distance_guard(spark, sf_dir):
    ref, sub = _sets(spark, sf_dir)
    return AP.distance_guard(sub, ref)


# ------------------------------------------------------------------- k-NN
SQL_LAB = f"""lab AS (SELECT vec_id, embedding, 0 AS y FROM e WHERE set = 'ref' AND label <= 5
  UNION ALL SELECT vec_id, embedding, 1 AS y FROM e WHERE set = 'ref' AND label >= 4),
q AS (SELECT vec_id, embedding FROM e WHERE set = 'subject'),
nd AS (SELECT q.vec_id, l.vec_id AS rid, l.y, {sql_dist('q.embedding', 'l.embedding')} AS dist FROM q JOIN lab l ON TRUE),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid, y) AS rn FROM nd)
  WHERE rn <= {K_NN})"""
SQL_VOTES_UNIFORM = """vt AS (SELECT vec_id, sum(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) / count(*) AS p0,
  sum(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) / count(*) AS p1 FROM nn GROUP BY vec_id)"""
SQL_VOTES_DISTANCE = """vz AS (SELECT vec_id, bool_or(dist = 0) AS hz,
  sum(CASE WHEN dist = 0 AND y = 0 THEN 1.0 ELSE 0.0 END) AS z0, sum(CASE WHEN dist = 0 AND y = 1 THEN 1.0 ELSE 0.0 END) AS z1,
  sum(CASE WHEN dist <> 0 AND y = 0 THEN 1.0 / dist ELSE 0.0 END) AS d0,
  sum(CASE WHEN dist <> 0 AND y = 1 THEN 1.0 / dist ELSE 0.0 END) AS d1 FROM nn GROUP BY vec_id),
vw AS (SELECT vec_id, CASE WHEN hz THEN z0 ELSE d0 END AS w0, CASE WHEN hz THEN z1 ELSE d1 END AS w1 FROM vz),
vt AS (SELECT vec_id, w0 / (w0 + w1) AS p0, w1 / (w0 + w1) AS p1 FROM vw)"""
SQL_EVAL = """ev AS (SELECT e.vec_id, 0 AS y FROM e WHERE set = 'subject' AND label <= 5
  UNION ALL SELECT e.vec_id, 1 AS y FROM e WHERE set = 'subject' AND label >= 4),
pr AS (SELECT ev.vec_id, ev.y, vt.p0, vt.p1, CASE WHEN vt.p1 > vt.p0 THEN 1 ELSE 0 END AS pred
  FROM ev JOIN vt USING (vec_id))"""


def _labelled(e):
    return class_union(e.where(F.col("label") <= 5), e.where(F.col("label") >= 4))


def _votes(spark, sf_dir, weights, **options):
    ref, sub = _sets(spark, sf_dir)
    return predict(neighbour_votes(sub.select("id", "embedding"), _labelled(ref), k=K_NN, weights=weights, **options))


def _predict_sql(votes: str) -> str:
    return f"""
WITH {SQL_E}, {SQL_LAB}, {votes}
SELECT vec_id, round(p1, {ROUND}) AS p1, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS pred FROM vt"""


@query("knn_predict_uniform", "J4 J8 W2 F20 F21 U1", _predict_sql(SQL_VOTES_UNIFORM))
def knn_predict_uniform(spark, sf_dir):
    v = _votes(spark, sf_dir, "uniform", block_rows=SMALL_BLOCKS)
    return v.select(F.col("id").alias("vec_id"), F.round("p1", ROUND).alias("p1"), "pred")


@query("knn_predict_distance", "J8 W2 F20 F21", _predict_sql(SQL_VOTES_DISTANCE))
def knn_predict_distance(spark, sf_dir):
    v = _votes(spark, sf_dir, "distance", block_rows=SMALL_BLOCKS)
    return v.select(F.col("id").alias("vec_id"), F.round("p1", ROUND).alias("p1"), "pred")


@query("knn_approx_recall", "J8", f"""
SELECT CAST(count(*) AS BIGINT) AS queries, CAST(count(*) * {K_NN} AS BIGINT) AS pairs, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0""")
def knn_approx_recall(spark, sf_dir):
    """Ids divisible by 50 against all rows, by the index and exactly."""
    from ..operators.knn_approx import NeighbourIndex, recall

    e = embedding_sets(spark, sf_dir).select("id", "embedding")
    queries = e.where(F.col("id") % 50 == 0)
    found = NeighbourIndex(e, K_NN).search(queries, exclude_self=True)
    r = recall(found, AP.knn(queries, e, K_NN, exclude_self=True))
    return r.select("queries", "pairs", (F.col("recall") >= 0.9).alias("enough"))


def _eval_rows(spark, sf_dir):
    """Labelled subject rows with their votes, checkpointed (read per class)."""
    from ..session import materialize

    _, sub = _sets(spark, sf_dir)
    ev = _labelled(sub).select("id", "y")
    return materialize(ev.join(_votes(spark, sf_dir, "uniform"), "id"))


def _report_sql(prefix: str) -> str:
    """Report rows from a ``pr(vec_id, y, p0, p1, pred)`` CTE defined in ``prefix``."""
    return f"""
WITH {prefix},
cc AS (SELECT c, sum(t) AS support, sum(h) AS tp, sum(p) AS predicted FROM (
    SELECT CAST(y AS VARCHAR) AS c, 1 AS t, CASE WHEN y = pred THEN 1 ELSE 0 END AS h, 0 AS p FROM pr
    UNION ALL SELECT CAST(pred AS VARCHAR), 0, 0, 1 FROM pr) GROUP BY c),
per AS (SELECT c AS name, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support, tp FROM cc),
per2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END
  AS f1_score FROM per)
SELECT name, round(precision, {ROUND}) AS precision, round(recall, {ROUND}) AS recall,
  round(f1_score, {ROUND}) AS f1_score, CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'macro avg', round(avg(precision), {ROUND}), round(avg(recall), {ROUND}), round(avg(f1_score), {ROUND}),
  CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), {ROUND}),
  round(sum(recall * support) / sum(support), {ROUND}), round(sum(f1_score * support) / sum(support), {ROUND}),
  CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), {ROUND}), CAST(sum(support) AS BIGINT) FROM per2"""


@query("classification_report", "A14 C10", _report_sql(f"{SQL_E}, {SQL_LAB}, {SQL_VOTES_UNIFORM}, {SQL_EVAL}"))
def classification_report_query(spark, sf_dir):
    r = classification_report(_eval_rows(spark, sf_dir), "y", "pred")
    return r.select("name", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "f1_score")],
                    F.col("support").cast("long"))


def _ap_sql(cls: int) -> str:
    return f"""s{cls} AS (SELECT round(p{cls}, 9) AS score, sum(CASE WHEN y = {cls} THEN 1 ELSE 0 END) AS tp, count(*) AS n
  FROM pr GROUP BY 1),
c{cls} AS (SELECT tp, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn FROM s{cls}),
a{cls} AS (SELECT CASE WHEN sum(tp) = 0 THEN 0.0 ELSE sum(tp * ctp / cn) / sum(tp) END AS ap FROM c{cls})"""


def _ap_query_sql(prefix: str) -> str:
    return f"""
WITH {prefix}, {_ap_sql(0)}, {_ap_sql(1)}
SELECT '0' AS name, round(ap, {ROUND}) AS avg_prec FROM a0 UNION ALL SELECT '1', round(ap, {ROUND}) FROM a1
UNION ALL SELECT 'macro avg', round(((SELECT ap FROM a0) + (SELECT ap FROM a1)) / 2, {ROUND})"""


def _ap_rows(ev):
    from ..operators.metrics import average_precision_ovr

    sc = ev.select("y", F.round("p0", 9).alias("s0"), F.round("p1", 9).alias("s1"))
    ap = average_precision_ovr(sc, "y", {0: "s0", 1: "s1"})
    return ap.select("name", F.round("avg_prec", ROUND).alias("avg_prec"))


@query("average_precision", "A15 W5", _ap_query_sql(f"{SQL_E}, {SQL_LAB}, {SQL_VOTES_UNIFORM}, {SQL_EVAL}"))
def average_precision_query(spark, sf_dir):
    return _ap_rows(_eval_rows(spark, sf_dir))


# ---------------------------------------------------------------- pooling
@query("mean_pool", "A16", f"""
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), {ROUND}) AS value FROM (
  SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
GROUP BY label, dim""")
def mean_pool_query(spark, sf_dir):
    e = embedding_sets(spark, sf_dir)
    return mean_pool(e, "label", "embedding").select("label", "dim", F.round("value", ROUND).alias("value"))


@query("masked_mean_pool", "A17 Q14", f"""
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), {ROUND}) AS value FROM (
  SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings
  WHERE embedding[1] >= 0)
GROUP BY label, dim""")
def masked_mean_pool_query(spark, sf_dir):
    e = embedding_sets(spark, sf_dir).withColumn("mask", F.element_at("embedding", 1) >= 0)
    return masked_mean_pool(e, "label", "embedding", "mask").select("label", "dim",
                                                                      F.round("value", ROUND).alias("value"))


# ------------------------------------------- labels joined to documents
def _doc_vectors(spark, sf_dir):
    """Letter-frequency vectors (26-d, native expressions) of every document."""
    import string

    from ..functions.text import letters
    from .standins import documents

    d = documents(spark, sf_dir).select("doc_id", letters("text").alias("s"))
    n = F.length("s")
    comps = [F.when(n > 0, (n - F.length(F.replace("s", F.lit(ch), F.lit("")))) / n).otherwise(F.lit(0.0))
             for ch in string.ascii_uppercase]
    return d.select(F.col("doc_id").alias("id"), F.array(*comps).alias("embedding"))


def _quality_rows(spark, sf_dir):
    """Labelled documents gathered by id; train split = reference set,
    the other splits are scored by a 5-NN vote on ``quality``."""
    from ..operators import curate as C
    from ..session import materialize, read_table
    from .catalog_corpus import SPLIT_SEED, TEST_FRAC, VAL_FRAC

    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    split = C.hash_split(docs, "doc_id", SPLIT_SEED, VAL_FRAC, TEST_FRAC).select(F.col("doc_id").alias("id"), "split")
    # labelled rows are read by both k-NN sides and their counts: compute once
    rows = materialize(_doc_vectors(spark, sf_dir).join(lab, "id").join(split, "id"))
    ref = rows.where(F.col("split") == "train")
    qs = rows.where(F.col("split") != "train")
    votes = predict(neighbour_votes(qs.select("id", "embedding"), ref.select("id", "embedding", "y"), k=K_NN))
    return materialize(qs.select("id", "y").join(votes, "id"))


_LETTER_VEC_SQL = ("list_transform(range(26), lambda i: CASE WHEN length(s) > 0 THEN "
                   "(length(s) - length(replace(s, chr(65 + i::INTEGER), '')))::DOUBLE / length(s) ELSE 0.0 END)")


def _quality_sql() -> str:
    from .catalog_corpus import SQL_SPLIT
    from .standins import SQL_LETTERS

    return f"""{SQL_SPLIT},
dv AS (SELECT doc_id, {SQL_LETTERS} AS s FROM documents),
vec AS (SELECT doc_id, {_LETTER_VEC_SQL} AS embedding FROM dv),
lab AS (SELECT v.doc_id AS vec_id, v.embedding, l.quality AS y, spl.split FROM vec v JOIN labels l USING (doc_id)
  JOIN spl USING (doc_id)),
refs AS (SELECT * FROM lab WHERE split = 'train'),
qs AS (SELECT * FROM lab WHERE split <> 'train'),
nd AS (SELECT q.vec_id, r.vec_id AS rid, r.y, {sql_dist('q.embedding', 'r.embedding')} AS dist FROM qs q JOIN refs r ON TRUE),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid) AS rn FROM nd)
  WHERE rn <= {K_NN}),
{SQL_VOTES_UNIFORM},
pr AS (SELECT q.vec_id, q.y, vt.p0, vt.p1, CASE WHEN vt.p1 > vt.p0 THEN 1 ELSE 0 END AS pred
  FROM qs q JOIN vt USING (vec_id))"""


@query("quality_report", "J4 J8 A14 W2 F20 C10", _report_sql(_quality_sql()))
def quality_report(spark, sf_dir):
    """Classification report of a 5-NN quality vote (labels joined to documents)."""
    r = classification_report(_quality_rows(spark, sf_dir), "y", "pred")
    return r.select("name", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "f1_score")],
                    F.col("support").cast("long"))


@query("quality_average_precision", "A15 W5", _ap_query_sql(_quality_sql()))
def quality_average_precision(spark, sf_dir):
    """Per-class and macro average precision of the quality vote."""
    return _ap_rows(_quality_rows(spark, sf_dir))


# ----------------------------------------- labelled set scored on itself (Q18)
SQL_SELF = f"""{SQL_E},
lab AS (SELECT vec_id, embedding, 0 AS y FROM e WHERE label <= 5
  UNION ALL SELECT vec_id, embedding, 1 AS y FROM e WHERE label >= 4),
q AS (SELECT vec_id, embedding FROM e),
nd AS (SELECT q.vec_id, l.vec_id AS rid, l.y, {sql_dist('q.embedding', 'l.embedding')} AS dist FROM q JOIN lab l ON TRUE),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, rid, y) AS rn FROM nd)
  WHERE rn <= {K_NN}),
{SQL_VOTES_UNIFORM},
pr AS (SELECT l.vec_id, l.y, vt.p0, vt.p1, CASE WHEN vt.p1 > vt.p0 THEN 1 ELSE 0 END AS pred
  FROM lab l JOIN vt USING (vec_id))"""


@query("knn_self_report", "J8 W2 A14 Q17 Q18", _report_sql(SQL_SELF))
def knn_self_report(spark, sf_dir):
    """The labelled set (both classes, overlapping) fitted and scored on
    itself: every point is among its own neighbours, as in the reference's
    ground-truth runs (``exclude_self=False``)."""
    from ..session import materialize

    e = embedding_sets(spark, sf_dir)
    lab = materialize(_labelled(e).select("id", "embedding", "y"))
    votes = predict(neighbour_votes(e.select("id", "embedding"), lab, k=K_NN))
    rows = lab.select("id", "y").join(votes, "id")
    r = classification_report(rows, "y", "pred")
    return r.select("name", *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "f1_score")],
                    F.col("support").cast("long"))
