"""Source audit, token alignment and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.llm.simhash import agreement_keys, fingerprints, simhash_components, survivors, pivot_table, pivots, fingerprint_links, tie
from seqframe.llm.source_audit import shares, sort_pointers, source_audit, spelt, term_pointers
from seqframe.llm.token_alignment import Aligner, align_tokens, byte_alphabet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# ---- source audit


def brute_audit(rows, least_docs, best):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall(lower_az(text or ""))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        names = [s for g, s in groups if g == lang]
        p, whole = {}, Counter()
        for s in names:
            n = sum(count[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
            for t in kept:
                whole[t] += count[lang, s][t]
        n = sum(whole.values())
        q = {t: 1 + 10**9 * (whole[t] + 2) // (n + 2 * len(kept)) for t in kept}
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, best)):
                for r, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, r))
    return out


@pytest.mark.parametrize("least_docs,block", [(2, 20_000), (2, 7), (10, 3), (10_000, 5)])
def test_source_audit_equals_brute_force(spark, odd, least_docs, block):
    rows = [(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()]
    found = source_audit(odd, least_docs, 10, block).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute_audit(rows, least_docs, 10)


def test_source_audit_of_an_empty_table(spark, empty):
    assert source_audit(empty).collect() == []


def test_pointers_are_sorted_by_term():
    rng = random.Random(3)
    long = "x" * 700
    texts = ["", None, "Straße Ab-ab_AB", "a\x00b", "日本語。語 z", long + "a " + long + "b " + long, long + "a"] + [
        " ".join("".join(rng.choice("abAéЖ") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 300]))) for _ in range(30)) for _ in range(20)]
    data, starts, sizes, doc = term_pointers(pa.array(texts).slice(1))
    terms = [(t, i) for i, x in enumerate(texts[1:]) for t in TERM.findall(lower_az(x or ""))]
    assert list(zip(spelt(data, starts, sizes).to_pylist(), doc.tolist())) == terms
    order, begins = sort_pointers(data, starts, sizes)
    ordered = [terms[i][0].encode() for i in order]
    assert ordered == sorted(t.encode() for t, _ in terms)
    assert begins.tolist() == [True] + [a != b for a, b in zip(ordered, ordered[1:])]


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 1, 10**12, 10**15 - 1])
    for whole in (7 * 10**15, 3 * 10**17):
        assert shares(n, whole).tolist() == [1 + 10**9 * (int(x) + 2) // whole for x in n]


def test_a_long_term_is_one_term(spark):
    rows = [(i, "q" * 300_000 + ("a" if i % 2 else "b"), "en", "s", 1) for i in range(4)]
    found = source_audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), 2, 10)
    assert {(r.part, len(r.item)) for r in found.collect()} <= {("term", 300_001)}


# ---- token alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts, paths):
    """Library calls on whole texts, and all pairs of tokens that end together."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    bytes_of = byte_alphabet()
    linked, out = Counter(), []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        said_a = [bytes(bytes_of[c] for c in a.id_to_token(i)) for i in ids_a]
        said_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(said_a) != whole or b"".join(said_b) != whole:
            out.append((0, 0, [], []))
            continue
        ends = []
        for said in (said_a, said_b):
            at = 0
            ends.append([at := at + len(x) for x in said])
        links = [(x, y) for x, e in zip(ids_a, ends[0]) for y, f in zip(ids_b, ends[1]) if e == f] if len(ids_a) < 500 else [
            (x, dict(zip(ends[1], ids_b))[e]) for x, e in zip(ids_a, ends[0]) if e in set(ends[1])]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ni, nj = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, ids_a[i:ni])) + "|" + ",".join(map(str, ids_b[j:nj])))
            i, j = ni, nj
        linked.update(links)
        out.append((len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, y), n in linked.items():
        most[y] = max(most[y], n)
    return [(n, m, len(g), len(ls), sum(linked[x] == most[x[1]] for x in ls), sum(linked[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for n, m, g, ls in out]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("shard_mb", [6, 0])
def test_alignment_equals_brute_force(spark, paths, shard_mb):
    rng = random.Random(7)
    bits = [" ", "  ", "\n", "\t", "the", "The", " of", "<|endoftext|>", "<s>", "<0x41>", "▁", "é", "日本", "🙂", "n't", "123", "\x00", " ", "ing", ".", "indivisible", " a"]
    texts = [None, "", " ", "a", " a ", "x  y", "the cat sat on the mat", "<|endoftext|> <s> <unk>", "a▁b", "▁", "q" * 3000]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(120)] + ["the cat sat on the mat"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).withColumn("links", F.lit(1))
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align_tokens(rows, *paths, shard_mb=shard_mb).collect()}
    expected = brute_alignment(texts, paths)
    assert len(found) == len(texts)
    for i, row in enumerate(expected):
        assert found[i] == row, (i, texts[i])


def test_alignment_of_odd_rows(spark, odd, empty, paths):
    assert align_tokens(empty, *paths).collect() == []
    rows = odd.select("doc_id", "text").where("length(text) < 5000 or text is null").collect()
    expected = brute_alignment([r.text for r in rows], paths)
    found = align_tokens(odd.where("length(text) < 5000 or text is null"), *paths).collect()
    assert sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in found) == sorted((str(r.doc_id), *x) for r, x in zip(rows, expected))


def test_windows_with_equal_keys_are_told_apart(paths, monkeypatch):
    import seqframe.llm.token_alignment as T

    texts = pa.array(["the cat sat on it", "a dog", "strange indivisible things", "", "the cat"])
    aligner = Aligner(*paths)
    right = aligner.align(texts)
    monkeypatch.setattr(T, "mix64", lambda x: x * np.uint64(0))
    wrong_hash = aligner.align(texts)
    assert right["groups_sha256"] == wrong_hash["groups_sha256"] and right["n_groups"].tolist() == wrong_hash["n_groups"].tolist()


def test_a_long_text_without_spaces_is_aligned(paths):
    found = Aligner(*paths).align(pa.array(["ab" * 200_000, "abc"]))
    assert found["n_a"][0] > 0 and found["n_groups"].tolist()[1] > 0


# ---- fingerprints


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall(lower_az(text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps, bits=3):
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits)
    label = tie(len(fps), a, b)
    least = {}
    for i, c in zip(ids, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in label]


def test_fingerprints_equal_brute_force(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    expected = sorted((str(r.doc_id), brute_fingerprint(r.text)) for r in rows)
    found = sorted((str(r.doc_id), r.fp % 2**64) for r in fingerprints(odd).collect())
    assert found == expected


def test_simhash_components_equal_brute_force(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    expected = sorted((str(r.doc_id), f"{fp:016x}", str(c)) for r, fp, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps)))
    found = simhash_components(odd).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected
    assert simhash_components(empty).collect() == []


@pytest.mark.parametrize("chunk", [4096, 50])
def test_links_of_near_fingerprints(spark, chunk):
    """Clusters of fingerprints around centres, large ones too, so that long groups and chunks of groups are met."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fps = {int(c) for c in centres} | {int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)}
    for c in centres.tolist():
        for _ in range(120):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long").repartition(4)
    edges = [(r.a % 2**64, r.b % 2**64) for r in fingerprint_links(df, chunk=chunk).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)
    number = {f: i for i, f in enumerate(fps)}
    label = tie(len(fps), np.array([number[a] for a, _ in edges]), np.array([number[b] for _, b in edges]))
    x = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    assert (label == tie(len(fps), a, b)).all()


def test_pivots_discard_no_link():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    table = pivot_table(np.concatenate((x, y)), pivots(32))
    a = np.arange(len(x))
    assert len(survivors(table, a, a + len(x), 3)) == len(x)
    others = survivors(table, a, np.roll(a, 1) + len(x), 3)
    assert len(others) < len(x) // 1000


def test_near_fingerprints_share_a_key(spark):
    rng = np.random.default_rng(4)
    rows = []
    for x in rng.integers(0, 2**64, 200, dtype=np.uint64).tolist():
        y = x ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        rows.append(tuple(v - 2**64 if v >= 2**63 else v for v in (x, y)))
    df = spark.createDataFrame(rows, "x long, y long")
    shared = df.select(F.arrays_overlap(F.array(*agreement_keys(F.col("x"))), F.array(*agreement_keys(F.col("y")))).alias("s"))
    assert shared.where("s").count() == len(rows)


# ---- quality rules, whole result


def test_quality_rules_equal_sql_on_odd_rows(spark, odd):
    """kept and the base columns against the SQL of the query, with a language of enough text for references and documents far from them."""
    import duckdb

    from seqframe.llm.catalog import OP8
    from seqframe.llm.quality_rules import quality_rules

    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as"]
    rows = [(1000 + i, " ".join(rng.choice(common) if rng.random() < 0.5 else "w" + str(rng.randrange(500)) for _ in range(80)), "en", "s", 1) for i in range(60)]
    rows += [(2000 + i, " ".join("Q%dZ;#" % rng.randrange(10**6) for _ in range(60)), "en", "s", 1) for i in range(5)]
    rows += [(3000, " ".join(["das", "die", "the the the"] * 30), "en", "s", 1), (3001, "the " * 60, "en", "s", 1)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    documents = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(f"select {', '.join(names)} from ({OP8})").fetchall()
    got = quality_rules(docs).select("doc_id", *[f"verdict.{c}" for c in names[1:]]).collect()
    key = lambda r: tuple("" if x is None or x != x else int(x) for x in r)
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)
    assert not all(r.kept for r in got if (r.doc_id or 0) >= 2000 and not r.base_failed)


# ---- toxicity: disguises and long words


def test_disguised_insults_and_long_words():
    import time

    from seqframe.llm.toxicity import Machine, Scorer, Words, forms, sentences, train

    rng = random.Random(3)
    words = ["the", "river", "market", "paper", "window", "teacher", "garden", "letter", "summer", "number"]
    say = lambda *put: " ".join(rng.choice(words) for _ in range(20)) + "".join(" " + p for p in put) + " and so on."
    insults = ["idiot", "moron", "stupid", "pathetic", "scum"]
    texts = [say(insults[i % 5]) for i in range(100)] + [say() for _ in range(200)]
    scorer = Scorer(train(pa.array(texts), np.array([1] * 100 + [0] * 200), Machine(landmarks=16)), Machine(landmarks=16))
    found = lambda *t: (scorer.log_odds(pa.array(t)) >= 0).tolist()
    assert found(say(), say("idiot"), say("id*iot"), say("stu.pid"), say("i.d.i.o.t"), say("i d i o t"), say("m-o-r-o-n"), say("patheetic")) == [False] + [True] * 7
    start = time.time()
    assert found("x" * 100_000 + " fine", say() + "ab" * 50_000, "ab" * 50_000 + "idiot" + "ba" * 50_000)[:2] == [False, False]
    assert time.time() - start < 20
    word = "".join(rng.choice("abcdefgh") for _ in range(1000))
    windows = forms(word)
    assert max(map(len, windows)) <= 32 and all(any(word[i : i + 16] in w for w in windows) for i in range(985))
    assert Words(["idiot"], Machine()).kernels(["a" * 40 + "idiot" + "b" * 40])[0, 0] > 0
    assert sentences(pa.array(["i d i o t you. s.t.u.p.i.d", None, "a b"]))[0] == ["idiot", "you", "stupid", "a", "b"]
