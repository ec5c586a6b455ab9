"""Registered queries of the training-data operators and the pipeline, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqframe.llm.common import shared_path, table
from seqframe.llm.jaccard import jaccard_components
from seqframe.llm.license_scan import scan_licenses
from seqframe.llm.mixing import mix_sources
from seqframe.llm.piece_encoding import encode_pieces
from seqframe.llm.quality_classifier import quality_scores
from seqframe.llm.quality_rules import quality_rules
from seqframe.llm.simhash import simhash_components
from seqframe.llm.source_audit import source_audit
from seqframe.llm.substring_dedup import remove_repeats
from seqframe.llm.token_alignment import align_tokens
from seqframe.llm.token_files import digests, encode_documents, write_tokens
from seqframe.llm.topk_search import top_k
from seqframe.llm.toxicity import toxicity_scores


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(table(spark, sf_dir, "documents"), _tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "lossless")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(encode_documents(table(spark, sf_dir, "documents"), _tokenizer_path("byte_bpe_50k.json")), path)
    return digests(spark, path)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), n=20).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base, own = F.col("places.label"), F.col("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"), "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64).select("query_id", "rank", "vec_id", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.col(f"verdict.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), _tokenizer_path("byte_bpe_50k.json"), _tokenizer_path("piece_bpe_32k.model"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_piece_encoding, op3_quality_classifier, op4_token_files, op5_substring_dedup, op6_license_scan, op7_topk_search, op8_quality_rules, op9_toxicity, op10_ngram_jaccard,
           op11_source_audit, op12_token_alignment, op13_simhash)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP1 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('mix:' || doc_id::varchar) as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as s_rank from d group by source),
w as (select *, (s_rank - 1) % 3 + 1 as weight, 3 * source_size as stop from s),
f as (select *, ((sum(source_size) over () - coalesce(sum(stop) over (order by stop / weight, s_rank rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over (order by stop / weight, s_rank rows between unbounded preceding and 1 preceding), 0))::double) as level from w),
l as (select arg_min(level, (stop / weight, s_rank)) as level from f where level * weight <= stop),
t as (select source, source_size, s_rank, least(stop::double, l.level * weight) as target from f, l),
r as (select d.*, t.source_size, t.s_rank, t.target,
      coalesce(sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as c0
      from d join t on d.source is not distinct from t.source),
c as (select r.*, k.i as rep, (k.i * source_size + c0 + size)::double / target as v from r, (select unnest(range(3)) as i) k where size > 0),
a as (select doc_id, sum(size) over (order by v, s_rank, rep, c0 rows unbounded preceding) <= (select sum(source_size) from t) as ok from c),
n as (select doc_id, count(*) filter (ok) as n from a group by doc_id)
select r.doc_id, size, source_size, target, (size * coalesce(n.n, 0))::bigint as taken from r left join n on r.doc_id = n.doc_id
"""


OP5 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as p, w from d),
g as (select doc_id, p, array_to_string(w[p:p+19], ' ') as k from s),
r as (select doc_id, p, row_number() over (partition by k order by doc_id, p) as r from g),
c as (select distinct doc_id, unnest(range(p, p + 20)) as p from r where r > 1),
x as (select doc_id, list(p) as gone from c group by doc_id),
k as (select d.doc_id, w, coalesce(gone, []) as gone from d left join x on d.doc_id = x.doc_id),
u as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from k),
v as (select u.doc_id, string_agg(word, ' ' order by u.p) as kept from u anti join c on u.doc_id = c.doc_id and u.p = c.p group by u.doc_id)
select k.doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from k left join v on k.doc_id = v.doc_id
"""
OP7 = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
OP10 = r"""
with recursive d as (select doc_id, regexp_extract_all(lower_az, '[^\x20\x09-\x0D]+') as w
       from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_az from documents)),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
             else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end as s from d),
n as (select doc_id, len(s)::bigint as n from s),
t as (select doc_id, unnest(s) as t from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from n union select e.b, r.c from r join e on e.a = r.doc_id)
select n.doc_id, n.n as n_shingles, (select min(c) from r where r.doc_id = n.doc_id)::bigint as component_id from n
"""
OP8 = r"""
with d as (select row_number() over () as row, doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select row, p, array_to_string(w[p:p+4], ' ') as k from (select row, w, unnest(range(1, len(w) - 3)) as p from d where len(w) > 4)),
r as (select row, p from (select row, p, count(*) over (partition by row, k) as c from g) where c > 1),
x as (select row, count(distinct q) as n from (select row, unnest(range(p, p + 5)) as q from r) group by row),
b as (select d.row, doc_id, lang, w, len(w) as n_words, length(t) as n_chars, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
             list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as ls, coalesce(x.n, 0) as n_repeat_words,
             list_transform(['[^a-z]', '[^\x20\x09-\x0D]', '[\x00-\x7F]', '[^A-Z]', '[^.,;:!?''"()-]', '[^0-9]', '[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()-]|[^\x00-\x7F]'],
                            lambda y: length(regexp_replace(t, y, '', 'g'))) as k
      from d left join x on d.row = x.row),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b),
kc as (select row, lang, n_chars, unnest(k) as n, unnest(range(7)) as i from f where lang is not null),
kl as (select lang, i, sum(n) as n, sum(sum(n)) over (partition by lang) as whole from kc group by lang, i),
tl as (select lang, sum(n_words) as total from f where lang is not null group by lang),
wc as (select row, lang, lower(word) as word, count(*) as n from (select row, lang, unnest(w) as word from f where lang is not null) group by all),
cw as (select * from (select wc.lang, word, sum(n) as n, any_value(total) as total, row_number() over (partition by wc.lang order by sum(n) desc, word) as r
       from wc join tl on wc.lang = tl.lang group by wc.lang, word) where r <= 24 and n >= 0.004 * total and total >= 1000),
jc as (select kc.row, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) as s
       from (select kc.row, kc.n / kc.n_chars as p, kl.n / kl.whole as q from kc join kl on kc.lang = kl.lang and kc.i = kl.i where kl.whole >= 5000 and kc.n_chars >= 200) kc group by kc.row),
pq as (select f.row, coalesce(wc.n, 0) / f.n_words as p, cw.n / cw.total as q from f join cw on f.lang = cw.lang left join wc on wc.row = f.row and wc.word = cw.word where f.n_words >= 40),
pr as (select row, p, q from pq union all
       select f.row, greatest(0, 1 - coalesce(sum(p), 0)), 1 - coalesce(sum(q), 0) from f join tl on f.lang = tl.lang left join pq on f.row = pq.row where f.n_words >= 40 and tl.total >= 1000 group by f.row),
jw as (select row, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) as s from pr group by row)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       base_failed, not base_failed and not coalesce(sqrt(greatest(0, jc.s / 2)) > 0.30, false) and not coalesce(sqrt(greatest(0, jw.s / 2)) > 0.52, false) as kept
from f left join jc on f.row = jc.row left join jw on f.row = jw.row
"""
OP11 = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from d),
t as (select lang, source, row, unnest(w) as term from d),
k as (select lang, term, count(*) as total from t group by lang, term having count(distinct row) >= 10),
c as (select t.lang, t.source, t.term, count(*) as n from t join k on t.lang = k.lang and t.term = k.term group by all),
v as (select lang, count(*) as v, sum(total) as whole from k group by lang),
s as (select g.lang, g.source, coalesce(sum(n), 0) as whole from g left join c on g.lang = c.lang and g.source = c.source group by all),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::hugeint) // (s.whole + 2 * v.v)::hugeint as p,
             1 + (1000000000 * (k.total + 2)::hugeint) // (v.whole + 2 * v.v)::hugeint as q
      from s join v on s.lang = v.lang join k on s.lang = k.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
m as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(m.value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join m on m.lang = a.lang and m.source = a.source and m.item = b.source
      union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from r)
select * from o where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op5_substring_dedup": OP5, "op7_topk_search": OP7, "op8_quality_rules": OP8, "op10_ngram_jaccard": OP10, "op11_source_audit": OP11}
