"""Registered corpus queries: curation, dictionaries, encoding, batches,
perturbation, baselines, sampling - each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import id_set
from ..functions.text import join_tags, words
from ..functions.vocab import (STOP, decode_after_start, decode_drop_pads, decode_drop_specials, encode,
                               spaced)
from ..operators import baseline as B
from ..operators import curate as C
from ..operators.batches import assign_batches, collate
from ..operators.dictionary import conditioning_dictionary, has_unique_ids
from ..operators.encode import encode_corpus, encode_curated
from ..operators.perturb import changed_positions, mask_schedule, random_mask, random_substitution
from ..operators.ranking import exact_quantiles
from ..operators.sampling import topk_sample
from ..session import materialize, read_table
from .registry import query
from .standins import (ROUND, SQL_LETTERS, SQL_WORDS, documents, records, sequences, sql_chars,
                       sql_decode_char, sql_encode_char, sql_md5, sql_u)

# Curation parameters for the documents stand-in (the reference's are
# 50..256 / 1000 / 1000 on 11.8 M protein clusters).
MIN_LEN, MAX_LEN, MIN_CAT, MIN_TAG = 50, 5000, 100, 1000
SPLIT_SEED, VAL_FRAC, TEST_FRAC = 147, 0.1, 0.1
TRAIN_FRAC = 1 - VAL_FRAC - TEST_FRAC
VAL_END = 1 - TEST_FRAC
DEV_SIZES = {"train": 400, "val": 50, "test": 50}

SQL_FILT = f"""filt AS (
  SELECT doc_id, lang, n_chars, text, {SQL_WORDS} AS toks FROM documents
  WHERE n_chars BETWEEN {MIN_LEN} AND {MAX_LEN} AND len({SQL_WORDS}) > 0)"""
#: All documents that have tags; the length filter is for the curated rows alone.
SQL_TAGGED = f"""filt AS (
  SELECT doc_id, lang, n_chars, text, {SQL_WORDS} AS toks FROM documents WHERE len({SQL_WORDS}) > 0)"""
SQL_EX = "ex AS (SELECT doc_id, unnest(toks) AS tag, unnest(range(len(toks))) AS pos FROM filt)"
SQL_CATS = f"""cats AS (SELECT lang AS value, count(*) AS count FROM filt WHERE lang IS NOT NULL
  GROUP BY lang HAVING count(*) >= {MIN_CAT})"""
SQL_TAGC = f"tc AS (SELECT tag AS value, count(*) AS count FROM ex GROUP BY tag HAVING count(*) >= {MIN_TAG})"
SQL_CI = """catsr AS (SELECT value, count FROM cats UNION ALL
  SELECT 'root', NULL WHERE NOT EXISTS (SELECT 1 FROM cats WHERE value = 'root')),
ci AS (SELECT value, count, row_number() OVER (ORDER BY count DESC NULLS LAST, value) AS idx FROM catsr)"""
SQL_TI = "ti AS (SELECT value, count, (SELECT count(*) FROM ci) + row_number() OVER (ORDER BY count DESC, value) AS idx FROM tc)"
SQL_ROWS = """dt AS (SELECT ex.doc_id, list(ti.idx ORDER BY ex.pos) AS tag_ids FROM ex JOIN ti ON ex.tag = ti.value
  GROUP BY ex.doc_id),
rws AS (SELECT f.doc_id, ci.idx AS cat_id, dt.tag_ids FROM filt f JOIN dt USING (doc_id)
  JOIN ci ON ci.value = CASE WHEN f.lang IN (SELECT value FROM cats) THEN f.lang ELSE 'root' END)"""
SQL_SPLIT = f"""rk AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_md5(str(SPLIT_SEED), 'doc_id')}, doc_id) AS r,
  count(*) OVER () AS n FROM documents),
sp AS (SELECT doc_id, r, floor(n * {TRAIN_FRAC!r}::DOUBLE) AS e1, floor(n * {VAL_END!r}::DOUBLE) AS e2 FROM rk),
spl AS (SELECT doc_id, CASE WHEN r <= e1 THEN 'train' WHEN r <= e2 THEN 'val' ELSE 'test' END AS split,
  CAST(CASE WHEN r <= e1 THEN r WHEN r <= e2 THEN r - e1 ELSE r - e2 END AS BIGINT) AS split_rank FROM sp)"""


def _tagged(spark, sf_dir):
    return C.drop_untagged(records(spark, sf_dir), "tags", has_tags=F.col("has_tags")).drop("has_tags")


def _filtered(spark, sf_dir):
    return C.length_filter(_tagged(spark, sf_dir), "length", MIN_LEN, MAX_LEN)


def kept_dictionaries(f):
    """Both thresholded dictionaries from one counting pass, checkpointed:
    they are small (bounded by total / min_count) and read several times."""
    counts = C.dictionary_counts(f, "category", "tags")
    kept = materialize(counts.where(((F.col("kind") == "category") & (F.col("count") >= MIN_CAT))
                                    | ((F.col("kind") == "tag") & (F.col("count") >= MIN_TAG))))
    cats = kept.where(F.col("kind") == "category").select("value", "count")
    tags = kept.where(F.col("kind") == "tag").select("value", "count")
    return cats, tags


def curated(spark, sf_dir):
    """C2 core on the stand-in: filtered, folded rows with kept tags, plus
    the two kept dictionaries."""
    f = _filtered(spark, sf_dir)
    cats, tags = kept_dictionaries(f)
    kept = C.keep_tags(C.fold_rare(f, "category", cats), "id", "tags", tags,
                       drop_empty=True, unique_ids=has_unique_ids(documents(spark, sf_dir), "doc_id"))
    return kept, cats, tags


def conditioning_dictionary_of(spark, sf_dir, compat=False):
    f = _tagged(spark, sf_dir)
    cats, tags = kept_dictionaries(f)
    return f, materialize(conditioning_dictionary(cats, tags, compat_overlap=compat))


# ------------------------------------------------------------------ curation
@query("tag_counts_min1000", "F1 A2 A3 T1", f"""
SELECT tag, count(*) AS count FROM (SELECT unnest({SQL_WORDS}) AS tag FROM documents)
GROUP BY tag HAVING count(*) >= 1000""")
def tag_counts_min1000(spark, sf_dir):
    d = documents(spark, sf_dir).select(words("text").alias("tags"))
    return C.threshold(C.occurrence_counts(d, "tags"), 1000).select(F.col("value").alias("tag"), "count")


@query("category_counts", "A1 T1", """
SELECT lang AS category, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def category_counts(spark, sf_dir):
    return C.value_counts(documents(spark, sf_dir), "lang").select(F.col("value").alias("category"), "count")


@query("category_fold_root", "A1 A3 P7 J2", """
WITH kept AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 110)
SELECT d.doc_id, CASE WHEN k.lang IS NULL THEN 'root' ELSE d.lang END AS category
FROM documents d LEFT JOIN kept k ON d.lang = k.lang""")
def category_fold_root(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang")
    kept = C.threshold(C.value_counts(d, "lang"), 110)
    return C.fold_rare(d, "lang", kept).select("doc_id", F.col("lang").alias("category"))


@query("length_filter", "P5", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 50 AND 256")
def length_filter(spark, sf_dir):
    return C.length_filter(documents(spark, sf_dir), "n_chars", 50, 256).select("doc_id", "n_chars")


@query("length_histogram", "A19", """
SELECT CAST((n_chars // 1000) * 1000 AS BIGINT) AS bin_start, count(*) AS count FROM documents GROUP BY 1""")
def length_histogram(spark, sf_dir):
    d = documents(spark, sf_dir)
    return (d.groupBy((F.floor(F.col("n_chars") / 1000) * 1000).cast("long").alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("count")))


@query("length_histogram_short", "A19 P5", """
SELECT CAST((n_chars // 50) * 50 AS BIGINT) AS bin_start, count(*) AS count FROM documents
WHERE n_chars <= 1000 GROUP BY 1""")
def length_histogram_short(spark, sf_dir):
    d = documents(spark, sf_dir).where(F.col("n_chars") <= 1000)
    return (d.groupBy((F.floor(F.col("n_chars") / 50) * 50).cast("long").alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("count")))


_QS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("length_quantiles", "A19", " UNION ALL ".join(
    f"SELECT {p!r}::DOUBLE AS p, round(quantile_cont(n_chars, {p!r}::DOUBLE), {ROUND}) AS value FROM documents"
    for p in _QS))
def length_quantiles(spark, sf_dir):
    q = exact_quantiles(documents(spark, sf_dir), "n_chars", _QS)
    return q.select("p", F.round("value", ROUND).alias("value"))


@query("curated_rows", "P5 P6 P7 P8 P9 A1 A2 A3 A4 J1 J2 F3", f"""
WITH {SQL_FILT}, {SQL_CATS}, {SQL_EX}, {SQL_TAGC},
reg AS (SELECT ex.doc_id, string_agg(ex.tag, ' ' ORDER BY ex.pos) AS tags FROM ex JOIN tc ON ex.tag = tc.value
  GROUP BY ex.doc_id)
SELECT f.doc_id, CASE WHEN c.value IS NULL THEN 'root' ELSE f.lang END AS category, r.tags
FROM filt f JOIN reg r USING (doc_id) LEFT JOIN cats c ON f.lang = c.value""")
def curated_rows(spark, sf_dir):
    kept, _, _ = curated(spark, sf_dir)
    return kept.select(F.col("id").alias("doc_id"), "category", join_tags("tags").alias("tags"))


@query("hash_split_rows", "W3 T4 A18", f"WITH {SQL_SPLIT} SELECT doc_id, split, split_rank FROM spl")
def hash_split_rows(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id")
    return C.hash_split(d, "doc_id", SPLIT_SEED, VAL_FRAC, TEST_FRAC).select("doc_id", "split", "split_rank")


@query("hash_split_sizes", "W3 A18", f"WITH {SQL_SPLIT} SELECT split, count(*) AS count FROM spl GROUP BY split")
def hash_split_sizes(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id")
    return C.split_by_keys(d, "doc_id", SPLIT_SEED, VAL_FRAC, TEST_FRAC).groupBy("split").agg(F.count(F.lit(1)).alias("count"))


@query("dev_subset", "P10 W3", f"""
WITH {SQL_SPLIT} SELECT doc_id, split FROM spl WHERE
 (split = 'train' AND split_rank <= {DEV_SIZES['train']}) OR (split = 'val' AND split_rank <= {DEV_SIZES['val']})
 OR (split = 'test' AND split_rank <= {DEV_SIZES['test']})""")
def dev_subset(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id")
    return C.split_by_keys(d, "doc_id", SPLIT_SEED, VAL_FRAC, TEST_FRAC, DEV_SIZES).where("dev").select("doc_id", "split")


@query("property_bag_values", "P3 P4 F23", """
SELECT event_id, json_extract_string(props, '$.k') AS k,
  CAST(len(list_filter(json_keys(props), lambda x: x <> 'k')) AS INTEGER) AS n_rest FROM events""")
def property_bag_values(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", m.alias("_m")).select(
        "event_id", F.col("_m")["k"].alias("k"),
        F.size(F.map_values(F.map_filter("_m", lambda k, v: k != F.lit("k")))).alias("n_rest"))


@query("property_last_wins", "P2 Q1", """
WITH e AS (SELECT user_id, event_type, value, ts, event_id,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rl,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rf FROM events),
lastv AS (SELECT user_id, event_type, value AS last_value FROM e WHERE rl = 1),
firsts AS (SELECT user_id, event_type, ts, event_id FROM e WHERE rf = 1)
SELECT f.user_id, f.event_type AS key, l.last_value,
  row_number() OVER (PARTITION BY f.user_id ORDER BY f.ts, f.event_id) AS key_pos
FROM firsts f JOIN lastv l USING (user_id, event_type)""")
def property_last_wins(spark, sf_dir):
    """A user's events as a (type, value) property list in time order: last
    value per key wins, keys keep first-seen order.  Aggregated per (user,
    key) first, so a heavy user never lands in one group as raw events."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    g = e.groupBy("user_id", "event_type").agg(F.max_by("value", order).alias("last_value"),
                                               F.min(order).alias("_first"))
    w = Window.partitionBy("user_id").orderBy("_first")
    return g.select("user_id", F.col("event_type").alias("key"), "last_value",
                    F.row_number().over(w).cast("long").alias("key_pos"))


# --------------------------------------------------------- symbols, vocab
@query("symbol_histogram", "A5 F5", f"""
WITH s AS (SELECT unnest({sql_chars(SQL_LETTERS)}) AS symbol FROM documents)
SELECT symbol, {sql_encode_char('symbol')} AS token_id, count(*) AS count FROM s GROUP BY symbol""")
def symbol_histogram(spark, sf_dir):
    h = B.symbol_histogram(records(spark, sf_dir), "sequence")
    return B._symbol_ids(h).select("symbol", F.col("token_id").cast("int"), "count")


def _dictionary_sql(compat: bool) -> str:
    shift = " - 1" if compat else ""
    return f"""
WITH {SQL_TAGGED}, {SQL_CATS}, {SQL_EX}, {SQL_TAGC}, {SQL_CI}, {SQL_TI}
SELECT 'category' AS kind, value, CAST(coalesce(count, 0) AS BIGINT) AS count, CAST(idx AS BIGINT) AS idx FROM ci
UNION ALL SELECT 'tag', value, CAST(count AS BIGINT), CAST(idx{shift} AS BIGINT) FROM ti"""


def _dictionary(spark, sf_dir, compat):
    _, d = conditioning_dictionary_of(spark, sf_dir, compat)
    return d.select("kind", "value", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    F.col("idx").cast("long"))


@query("dictionary_index", "W4 T1 S7", _dictionary_sql(False))
def dictionary_index(spark, sf_dir):
    return _dictionary(spark, sf_dir, False)


@query("dictionary_index_compat", "W4 Q3", _dictionary_sql(True))
def dictionary_index_compat(spark, sf_dir):
    return _dictionary(spark, sf_dir, True)


SQL_BENCH_IDS = f"""b AS (SELECT item_id, {sql_chars(SQL_LETTERS)} AS c FROM benchmark),
bi AS (SELECT item_id, c, list_transform(c, lambda ch: {sql_encode_char('ch')}) AS ids FROM b)"""


@query("encode_decode_roundtrip", "F5 F6 F7 F8", f"""
WITH {SQL_BENCH_IDS}
SELECT item_id, array_to_string(ids, ' ') AS token_ids,
  array_to_string(list_transform(c, lambda ch: {sql_decode_char('ch')}), '') AS decoded_f6,
  array_to_string(list_transform(c, lambda ch: {sql_decode_char('ch')}), '') AS decoded_f7,
  array_to_string(list_transform(c, lambda ch: {sql_decode_char('ch')}), '') AS decoded_f8 FROM bi""")
def encode_decode_roundtrip(spark, sf_dir):
    s = sequences(spark, sf_dir, "benchmark").withColumn("ids", encode("sequence"))
    stop, pad = F.array(F.lit(STOP)), F.array(F.lit(0))
    # generated-style arrays: content after the first stop token must be ignored
    f6 = F.concat(stop, F.col("ids"), stop, F.col("ids"))
    f7 = F.concat(F.col("ids"), pad, stop, F.col("ids"))
    f8 = F.concat(stop, F.col("ids"), pad, stop, pad)
    return s.select(F.col("id").alias("item_id"), F.array_join("ids", " ").alias("token_ids"),
                    decode_after_start(f6).alias("decoded_f6"), decode_drop_pads(f7).alias("decoded_f7"),
                    decode_drop_specials(f8).alias("decoded_f8"))


REVERSE_SEED = 17


@query("reversed_sequences", "F9", f"""
WITH {SQL_BENCH_IDS}
SELECT item_id, {sql_u(str(REVERSE_SEED), 'item_id', "'r'")} > 0.5 AS reversed,
  array_to_string(CASE WHEN {sql_u(str(REVERSE_SEED), 'item_id', "'r'")} > 0.5 THEN list_reverse(ids) ELSE ids END, ' ')
  AS token_ids FROM bi""")
def reversed_sequences(spark, sf_dir):
    """token ids reversed with probability 1/2 by a per-row hash draw (the
    reference reverses training sequences at random)."""
    from ..functions.arrays import maybe_reverse
    from ..functions.random import hash_uniform

    s = sequences(spark, sf_dir, "benchmark").withColumn("ids", encode("sequence"))
    key = (F.lit(REVERSE_SEED), F.col("id"), F.lit("r"))
    return s.select(F.col("id").alias("item_id"), (hash_uniform(*key) > 0.5).alias("reversed"),
                    F.array_join(maybe_reverse(F.col("ids"), *key), " ").alias("token_ids"))


@query("spaced_string", "F4 P12", f"""
SELECT item_id, array_to_string({sql_chars(SQL_LETTERS)}, ' ') AS spaced FROM benchmark""")
def spaced_string(spark, sf_dir):
    s = sequences(spark, sf_dir, "benchmark")
    return s.select(F.col("id").alias("item_id"), spaced("sequence").alias("spaced"))


@query("sample_cap", "P11 T2 P15", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def sample_cap(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "n_chars").orderBy("doc_id").limit(100)


# ---------------------------------------------------------- conditioning ids
COND_SEED, TAXON_DROP, ATTR_DROP = 7, 0.1, 0.1


@query("conditioning_ids", "F2 F10 F11 J3 C4", f"""
WITH {SQL_TAGGED}, {SQL_CATS}, {SQL_EX}, {SQL_TAGC}, {SQL_CI}, {SQL_TI}, {SQL_ROWS},
kept AS (SELECT doc_id, list_concat(
    CASE WHEN {sql_u(str(COND_SEED), 'doc_id', "'c'", '0')} > {TAXON_DROP} THEN [cat_id] ELSE [] END,
    list_filter(tag_ids, lambda x, i: {sql_u(str(COND_SEED), 'doc_id', "'t'", 'i - 1')} > {ATTR_DROP})) AS ids
  FROM rws),
fb AS (SELECT doc_id, CASE WHEN len(ids) = 0 THEN [(SELECT idx FROM ci WHERE value = 'root')] ELSE ids END AS ids
  FROM kept),
sh AS (SELECT doc_id, list_transform(list_sort(list_transform(ids,
    lambda x, i: {sql_md5(str(COND_SEED), 'doc_id', "'o'", 'i - 1')} || ':' || CAST(x AS VARCHAR))),
    lambda s: CAST(split_part(s, ':', 2) AS BIGINT)) AS ids FROM fb)
SELECT doc_id, array_to_string(ids, ' ') AS cond_ids FROM sh""")
def conditioning_ids(spark, sf_dir):
    """C2 then C4: rows of kept tags go through the strict lookup, which raises on a tag or category without an id."""
    f = _tagged(spark, sf_dir)
    cats, tags = kept_dictionaries(f)
    dic = materialize(conditioning_dictionary(cats, tags))
    unique = has_unique_ids(documents(spark, sf_dir), "doc_id")
    kept = C.keep_tags(C.fold_rare(f, "category", cats), "id", "tags", tags, drop_empty=True, unique_ids=unique)
    enc = encode_corpus(kept, "id", "sequence", "category", "tags", dic, taxon_dropout=TAXON_DROP,
                        attribute_dropout=ATTR_DROP, seed=COND_SEED, unique_ids=unique)
    return enc.select(F.col("id").alias("doc_id"), F.array_join("conditioning_tags", " ").alias("cond_ids"))


def _encoded_plain(spark, sf_dir):
    f, dic = conditioning_dictionary_of(spark, sf_dir)
    enc = encode_curated(f, "id", "sequence", "category", "tags", dic, shuffle=False,
                         unique_ids=has_unique_ids(documents(spark, sf_dir), "doc_id"))
    return enc, dic.where(F.col("kind") == "tag").select(F.col("idx").alias("class_id"))


# the two classes of the k-NN task: documents with any of the frequent half of the tags, and with any of the others
SQL_TWO = """cls AS (SELECT idx, CASE WHEN 2 * row_number() OVER (ORDER BY idx) <= count(*) OVER () THEN 0 ELSE 1 END AS y FROM ti),
mem AS (SELECT DISTINCT x.doc_id, cls.y FROM (SELECT doc_id, unnest(tag_ids) AS idx FROM rws) x JOIN cls ON x.idx = cls.idx)"""


@query("conditioning_id_counts", "A6 U3", f"""
WITH {SQL_TAGGED}, {SQL_CATS}, {SQL_EX}, {SQL_TAGC}, {SQL_CI}, {SQL_TI}, {SQL_ROWS},
fl AS (SELECT unnest(list_concat([cat_id], tag_ids)) AS cond_id FROM rws)
SELECT CAST(cond_id AS BIGINT) AS cond_id, count(*) AS count FROM fl GROUP BY cond_id""")
def conditioning_id_counts(spark, sf_dir):
    enc, _ = _encoded_plain(spark, sf_dir)
    return (B.array_token_counts(enc, "conditioning_tags")
            .select(F.col("token_id").cast("long").alias("cond_id"), "count"))


@query("class_membership", "P13 U2 C9", f"""
WITH {SQL_TAGGED}, {SQL_CATS}, {SQL_EX}, {SQL_TAGC}, {SQL_CI}, {SQL_TI}, {SQL_ROWS}
SELECT DISTINCT CAST(unnest(tag_ids) AS BIGINT) AS class_id, doc_id FROM rws""")
def class_membership(spark, sf_dir):
    """C9 for every tag id of the dictionary."""
    from .jobs import class_index

    enc, classes = _encoded_plain(spark, sf_dir)
    return class_index(enc, classes, tags_col="conditioning_tags").select(F.col("class_id").cast("long"), F.col("id").alias("doc_id"))


@query("class_union", "U1 Q17", f"""
WITH {SQL_TAGGED}, {SQL_CATS}, {SQL_EX}, {SQL_TAGC}, {SQL_CI}, {SQL_TI}, {SQL_ROWS}, {SQL_TWO}
SELECT doc_id, y FROM mem""")
def class_union_query(spark, sf_dir):
    """Two classes that overlap, of all tags: the frequent half and the others."""
    from ..operators.knn import class_union
    from .jobs import class_index

    enc, classes = _encoded_plain(spark, sf_dir)
    first, n = classes.agg(F.min("class_id"), F.count(F.lit(1))).first()
    # membership is read once per class: the encoding runs once
    mem = materialize(class_index(enc, classes, tags_col="conditioning_tags")
                      .select(F.col("id").alias("doc_id"), (2 * (F.col("class_id") - F.lit(first or 0) + 1) > n).alias("rare")).distinct())
    return class_union(mem.where("not rare").select("doc_id"), mem.where("rare").select("doc_id")).select("doc_id", "y")


@query("class_sizes", "A20", f"""
WITH {SQL_TAGGED}, {SQL_CATS}, {SQL_EX}, {SQL_TAGC}, {SQL_CI}, {SQL_TI}, {SQL_ROWS}, {SQL_TWO}
SELECT y, count(*) AS support FROM mem GROUP BY y""")
def class_sizes(spark, sf_dir):
    u = class_union_query(spark, sf_dir)
    return u.groupBy("y").agg(F.count(F.lit(1)).alias("support"))


# ----------------------------------------------------------------- batches
BATCH_SEED, BATCH_SIZE = 3, 8
SQL_BATCHES = f"""bb AS (SELECT item_id, ids, len(ids) AS n,
  row_number() OVER (ORDER BY {sql_md5(str(BATCH_SEED), '0', 'item_id')}, item_id) AS r FROM bi),
bt AS (SELECT item_id, ids, n, CAST((r - 1) // {BATCH_SIZE} AS BIGINT) AS batch_id FROM bb),
bm AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS m FROM bt)"""


def _bench_batches(spark, sf_dir):
    s = sequences(spark, sf_dir, "benchmark").withColumn("sequence", encode("sequence"))
    s = s.withColumn("conditioning_tags", F.array().cast("array<int>"))
    return assign_batches(s, "id", BATCH_SIZE, BATCH_SEED, 0)


@query("next_token_pairs", "F13 W7 X3 T4", f"""
WITH {SQL_BENCH_IDS}, {SQL_BATCHES}
SELECT item_id, batch_id, array_to_string(list_resize(list_concat([22], ids), m + 1, 0), ' ') AS x_seq,
  array_to_string(list_resize(list_concat(ids, [22]), m + 1, 0), ' ') AS y_seq,
  CAST(n + 1 AS INTEGER) AS n_mask_true FROM bm""")
def next_token_pairs(spark, sf_dir):
    c = collate(_bench_batches(spark, sf_dir), "batch_id", mode="next_token")
    return c.select(F.col("id").alias("item_id"), "batch_id", F.array_join("x_seq", " ").alias("x_seq"),
                    F.array_join("y_seq", " ").alias("y_seq"),
                    F.size(F.filter("seq_mask", lambda b: b)).alias("n_mask_true"))


@query("stop_appended", "F14 W7 X3", f"""
WITH {SQL_BENCH_IDS}, {SQL_BATCHES}
SELECT item_id, batch_id, array_to_string(list_resize(list_concat(ids, [22]), m + 1, 0), ' ') AS sequence,
  CAST(n AS INTEGER) AS sequence_lengths FROM bm""")
def stop_appended(spark, sf_dir):
    c = collate(_bench_batches(spark, sf_dir), "batch_id", mode="stop_appended")
    return c.select(F.col("id").alias("item_id"), "batch_id", F.array_join("sequence", " ").alias("sequence"),
                    "sequence_lengths")


@query("padded_batches", "F12 W7 X3", f"""
WITH cv AS (SELECT conv_id, turn, list_transform({sql_chars(SQL_LETTERS)}, lambda ch: {sql_encode_char('ch')}) AS ids,
  list_transform({sql_chars('upper(role)')}, lambda ch: {sql_encode_char('ch')}) AS tags FROM conversations),
cm AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m, max(len(tags)) OVER (PARTITION BY conv_id) AS tm FROM cv)
SELECT conv_id, turn, array_to_string(list_resize(ids, m, 0), ' ') AS sequence,
  array_to_string(list_resize(tags, tm, 0), ' ') AS conditioning_tags,
  CAST(len(list_filter(list_resize(tags, tm, 0), lambda x: x <> 0)) AS INTEGER) AS n_tag_mask FROM cm""")
def padded_batches(spark, sf_dir):
    from ..functions.text import letters

    cv = read_table(spark, sf_dir, "conversations")
    d = cv.select("conv_id", "turn", encode(letters("text")).alias("sequence"),
                  encode(F.upper("role")).alias("conditioning_tags"))
    c = collate(d, "conv_id", mode="separate")
    return c.select("conv_id", "turn", F.array_join("sequence", " ").alias("sequence"),
                    F.array_join("conditioning_tags", " ").alias("conditioning_tags"),
                    F.size(F.filter("tag_mask", lambda b: b)).alias("n_tag_mask"))


# ------------------------------------------------------------- perturbation
SUB_SEED, SUB_PERCENT, SUB_REPS = 11, 0.25, 3
_VALID_SQL = "[" + ", ".join(f"'{s}'" for s in "ACDEFGHIKLMNPQRSTVWYX") + "]"
SQL_SUB = f"""b AS (SELECT item_id, {sql_chars(SQL_LETTERS)} AS c FROM benchmark),
r AS (SELECT item_id, c, unnest(range({SUB_REPS})) AS replicate FROM b),
k AS (SELECT item_id, replicate, c, CAST(floor(len(c) * {SUB_PERCENT}) AS INTEGER) AS n,
  list_transform(c, lambda x, i: {sql_md5(str(SUB_SEED), 'item_id', 'replicate', 'i - 1')}
    || lpad(CAST(i - 1 AS VARCHAR), 10, '0')) AS keys FROM r),
g AS (SELECT item_id, replicate, c, list_transform(c, lambda x, i: CASE WHEN n > 0 AND keys[i] <= list_sort(keys)[n]
    THEN list_filter({_VALID_SQL}, lambda v: v <> x)[CAST(floor({sql_u(str(SUB_SEED), 'item_id', 'replicate', 'i - 1', "'s'")}
      * len(list_filter({_VALID_SQL}, lambda v: v <> x))) AS INTEGER) + 1]
    ELSE x END) AS gc FROM k)"""


def _substituted(spark, sf_dir):
    s = sequences(spark, sf_dir, "benchmark")
    return random_substitution(s, "id", "sequence", SUB_PERCENT, SUB_REPS, SUB_SEED)


@query("random_substitution_rows", "W6 F18 F19 U4 C6", f"""
WITH {SQL_SUB} SELECT item_id, CAST(replicate AS INTEGER) AS replicate, array_to_string(gc, '') AS gen FROM g""")
def random_substitution_rows(spark, sf_dir):
    return _substituted(spark, sf_dir).select(F.col("id").alias("item_id"), "replicate", "gen")


@query("random_substitution_rate", "W6 F18", f"""
WITH {SQL_SUB} SELECT CAST(replicate AS INTEGER) AS replicate,
  CAST(sum(len(list_filter(list_zip(c, gc), lambda z: z[1] <> z[2]))) AS BIGINT) AS n_changed,
  CAST(sum(len(c)) AS BIGINT) AS n_total FROM g GROUP BY replicate""")
def random_substitution_rate(spark, sf_dir):
    s = _substituted(spark, sf_dir)
    return s.groupBy("replicate").agg(F.sum(changed_positions(F.col("orig"), F.col("gen"))).cast("long")
                                      .alias("n_changed"), F.sum(F.length("orig")).cast("long").alias("n_total"))


MASK_SEED, MASK_FLOOR = 5, 0.05


@query("mask_counts", "F15 Q9", f"""
WITH {SQL_BENCH_IDS},
p AS (SELECT item_id, ids, least(greatest({sql_u(str(MASK_SEED), 'item_id', "'p'")} + {MASK_FLOOR}, 0.0), 1.0) AS mp FROM bi)
SELECT item_id, round(mp, {ROUND}) AS mask_p,
  CAST(len(list_filter(ids, lambda x, i: {sql_u(str(MASK_SEED), 'item_id', '0', 'i - 1')} < mp)) AS INTEGER) AS n_masked,
  CAST(len(ids) AS INTEGER) AS n_tokens FROM p""")
def mask_counts(spark, sf_dir):
    s = sequences(spark, sf_dir, "benchmark").withColumn("ids", encode("sequence"))
    m = random_mask(s, "id", "ids", seed=MASK_SEED, floor=MASK_FLOOR)
    return m.select(F.col("id").alias("item_id"), F.round("mask_p", ROUND).alias("mask_p"),
                    F.size(F.filter("masked", lambda x: x == 23)).alias("n_masked"),
                    F.size("ids").alias("n_tokens"))


MASK_STEPS, MASK_MIN = 5, 0.0


@query("mask_schedule", "F16 F17", f"""
WITH {SQL_BENCH_IDS},
st AS (SELECT item_id, ids, unnest(range({MASK_STEPS})) AS step FROM bi),
p AS (SELECT *, 1.0 + step * ({MASK_MIN} - 1.0) / {MASK_STEPS - 1}.0 AS mp FROM st)
SELECT CAST(step AS INTEGER) AS step, round(min(mp), {ROUND}) AS mask_p,
  CAST(sum(len(list_filter(ids, lambda x, i: {sql_u(str(MASK_SEED), 'item_id', 'step', 'i - 1')} < mp))) AS BIGINT) AS n_masked,
  CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM p GROUP BY step""")
def mask_schedule_query(spark, sf_dir):
    s = sequences(spark, sf_dir, "benchmark").withColumn("ids", encode("sequence"))
    m = mask_schedule(s, "id", "ids", steps=MASK_STEPS, min_p=MASK_MIN, seed=MASK_SEED)
    return m.groupBy("step").agg(F.round(F.min("mask_p"), ROUND).alias("mask_p"),
                                 F.sum(F.size(F.filter("masked", lambda x: x == 23))).cast("long").alias("n_masked"),
                                 F.sum(F.size("ids")).cast("long").alias("n_tokens"))


# ---------------------------------------------------------------- baselines
def _split_counts_sql(split: str) -> str:
    return f"""{split}_s AS (SELECT unnest({sql_chars(SQL_LETTERS)}) AS ch FROM documents JOIN spl USING (doc_id)
  WHERE split = '{split}'),
{split}_c AS (SELECT token_id, sum(cnt) AS cnt FROM (
    SELECT {sql_encode_char('ch')} AS token_id, count(*) AS cnt FROM {split}_s GROUP BY ch
    UNION ALL SELECT 22, count(*) FROM spl WHERE split = '{split}') GROUP BY token_id)"""


SQL_PROBS = """vocab AS (SELECT CAST(range AS INTEGER) AS token_id FROM range(23)),
uc AS (SELECT v.token_id, CASE WHEN v.token_id = 0 THEN 0 ELSE coalesce(c.cnt, 0) END::DOUBLE AS c
  FROM vocab v LEFT JOIN train_c c USING (token_id)),
up AS (SELECT token_id, c / sum(c) OVER () AS p FROM uc),
unif AS (SELECT token_id, CASE WHEN token_id = 0 THEN 0.0 ELSE 1.0 / 22 END AS p FROM vocab)"""


def _loss_sql(probs: str) -> str:
    return f"""
SELECT 'nll' AS mode, round(-sum(t.cnt * ln(p.p)) / sum(t.cnt), {ROUND}) AS loss,
  round(exp(-sum(t.cnt * ln(p.p)) / sum(t.cnt)), {ROUND}) AS perplexity
FROM test_c t JOIN {probs} p USING (token_id) WHERE t.token_id <> 0
UNION ALL
SELECT 'as_logits', round(sum(t.cnt * ((SELECT ln(sum(exp(p))) FROM {probs}) - p.p)) / sum(t.cnt), {ROUND}),
  round(exp(sum(t.cnt * ((SELECT ln(sum(exp(p))) FROM {probs}) - p.p)) / sum(t.cnt)), {ROUND})
FROM test_c t JOIN {probs} p USING (token_id) WHERE t.token_id <> 0"""


def _split_docs(spark, sf_dir, split):
    from ..functions.text import letters

    s = C.split_by_keys(documents(spark, sf_dir), "doc_id", SPLIT_SEED, VAL_FRAC, TEST_FRAC)
    return s.where(F.col("split") == split).select(letters("text").alias("sequence"))


def _losses(spark, sf_dir, probs):
    test = materialize(B.target_token_counts(_split_docs(spark, sf_dir, "test"), "sequence"))
    out = B.cross_entropies(test, probs, ("nll", "as_logits"))
    return out.select("mode", F.round("loss", ROUND).alias("loss"), F.round("perplexity", ROUND).alias("perplexity"))


@query("unigram_probs", "A7 C7", f"""
WITH {SQL_SPLIT}, {_split_counts_sql('train')}, {SQL_PROBS}
SELECT token_id, round(p, 9) AS p FROM up""")
def unigram_probs(spark, sf_dir):
    train = B.target_token_counts(_split_docs(spark, sf_dir, "train"), "sequence")
    return B.unigram_probs(train).select("token_id", F.round("p", 9).alias("p"))


@query("unigram_loss", "A7 A9 F24 Q5", f"""
WITH {SQL_SPLIT}, {_split_counts_sql('train')}, {_split_counts_sql('test')}, {SQL_PROBS}
{_loss_sql('up')}""")
def unigram_loss(spark, sf_dir):
    train = materialize(B.target_token_counts(_split_docs(spark, sf_dir, "train"), "sequence"))
    return _losses(spark, sf_dir, B.unigram_probs(train))


@query("uniform_loss", "A8 A9 F24 Q5", f"""
WITH {SQL_SPLIT}, {_split_counts_sql('train')}, {_split_counts_sql('test')}, {SQL_PROBS}
{_loss_sql('unif')}""")
def uniform_loss(spark, sf_dir):
    return _losses(spark, sf_dir, B.uniform_probs(spark))


# ----------------------------------------------------------------- sampling
SAMPLE_SEED, SAMPLE_K, SAMPLE_T = 13, 5, 1.0


@query("topk_sample", "T5 Q8", f"""
WITH wc AS (SELECT lang, tag, ln(count(*)) AS logit FROM (SELECT lang, unnest({SQL_WORDS}) AS tag FROM documents)
  GROUP BY lang, tag),
tk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY logit DESC, tag) AS r FROM wc),
sc AS (SELECT lang, tag, logit / {SAMPLE_T} - ln(-ln(least(greatest({sql_u(str(SAMPLE_SEED), '0', 'lang', 'tag')},
  1.0 / 4294967296.0), 1.0 - 1.0 / 4294967296.0))) AS s FROM tk WHERE r <= {SAMPLE_K})
SELECT lang, arg_max(tag, s) AS tag FROM sc GROUP BY lang""")
def topk_sample_query(spark, sf_dir):
    d = (documents(spark, sf_dir).select("lang", F.explode_outer(words("text")).alias("tag"))
         .where(F.col("tag").isNotNull()))
    cand = d.groupBy("lang", "tag").agg(F.log(F.count(F.lit(1)).cast("double")).alias("logit"))
    return topk_sample(cand, "lang", "tag", "logit", k=SAMPLE_K, temperature=SAMPLE_T, seed=SAMPLE_SEED)
