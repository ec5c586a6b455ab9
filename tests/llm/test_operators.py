"""Each operator against a brute-force version, and on odd and empty tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.llm import quality_rules as QR
from seqframe.llm.common import grams, hashes, mix64
from seqframe.llm.components import connected_components
from seqframe.llm.jaccard import jaccard_components, linked_sets, one_of_each
from seqframe.llm.license_scan import PHRASES, TEMPLATES, Scanner, compile_template, scan_licenses
from seqframe.llm.mixing import mix_sources, mixed_documents
from seqframe.llm.piece_encoding import PieceModel, _salt, decode_pieces, encode_pieces, numbered_copies
from seqframe.llm.quality_classifier import Subwords, quality_scores
from seqframe.llm.substring_dedup import grouped_suffixes, remove_repeats
from seqframe.llm.token_files import Encoder, digests, encode_documents, read_metadata, read_tokens, write_tokens
from seqframe.llm.topk_search import top_k
from seqframe.llm.toxicity import Machine, Words, _codes, _kernel, toxicity_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


# ------------------------------------------------------------------ quality rules
def repeated(w, n=5):
    count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})


def test_quality_rules_base(odd):
    rows = QR.quality_rules(odd, verdict="found").select("text", "found.*")
    rows = rows.collect()
    assert len(rows) == odd.count()
    for r in rows:
        w = words(r.text)
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeated(w))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert r.base_failed == (len(w) < 10 or 100 * repeated(w) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rules_divergence(spark):
    good = [f"the of and to a in is {x} that it was for on are as with his they at be" for x in map(str, range(40))]
    bad = ["THE!! OF!! AND!! TO!! A!! IN!! IS!! THAT!! IT!! WAS!! FOR!! ON!! ARE!! AS!! WITH!! HIS!! THEY!! AT!! BE!! THIS!! " * 1 + " ".join(f"X{i}$$$ Y{i}%%%" for i in range(40))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([" ".join(x.split() + [f"w{i}q{j}" for j in range(30)]) for i, x in enumerate(good)] + bad)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.verdict.kept for r in QR.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(40)) and not kept[40]
    assert QR.keep_good(docs).columns == docs.columns and QR.keep_good(docs).count() == 40


def test_quality_rules_rare_languages(spark):
    """Clean texts of rare languages and of none stay; a language's odd one out goes, however rare the language."""
    rng = np.random.default_rng(4)
    alphabet = {"ru": "абвгдежзиклмнопрст", "cs": "abcdeěščřžýáíkl", "fi": "aeiouäöklmnpst"}
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    common = {k: [word(v) for _ in range(30)] for k, v in alphabet.items()}
    text = lambda k, n: " ".join(rng.choice(common[k], n))
    main = [(i, " ".join(rng.choice(["the", "of", "and", "to", "cat", "dog", "sun", "sea"], 40_000)), "en") for i in range(40)]
    rare = [(100 + 100 * j + i, text(k, 80), k) for j, k in enumerate(alphabet) for i in range(30)]
    none = [(500 + 10 * j + i, text(k, 80), None) for j, k in enumerate(alphabet) for i in range(4)]
    few = [(600 + i, text(k, 80), "xx") for i, k in enumerate(alphabet)]
    odd = [(700, " ".join(f"X{i}$$$ Y{i}%%%" for i in range(50)), "ru")]
    docs = spark.createDataFrame(main + rare + none + few + odd, "doc_id long, text string, lang string")
    rows = {r.doc_id: r.verdict for r in QR.quality_rules(docs, rules=QR.Rules(repeat_percent=100)).collect()}
    assert all(rows[i].kept for i, _, _ in rare + none + few) and not rows[700].kept
    assert all(rows[i].js_chars == rows[i].js_words == 0 for i, _, _ in none + few) and rows[100].js_chars < 0.2


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = spark.range(1).select(QR.js_distance([F.lit(x) for x in p], [F.lit(x) for x in q]).alias("d")).first().d
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b) if x)
    assert got == pytest.approx(np.sqrt((kl(p, m) + kl(q, m)) / 2))


# ------------------------------------------------------------------ mix
def test_mix_sources(odd):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in rows)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    order = sorted([s for s in by if s is not None]) + ([None] if None in by else [])
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    for s, own in by.items():
        assert own[0].source_size == sum(r["size"] for r in own) and own[0].target <= 3 * own[0].source_size + 1e-6
        largest = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(largest, max(r["size"] for r in rows))
    free = [s for s in order if by[s][0].target < 3 * by[s][0].source_size - 1e-6]
    shares = {round(by[s][0].target / weights[s], 6) for s in free}
    assert len(shares) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(odd.repartition(3)).collect()))


def test_mixed_documents(odd):
    taken = Counter()
    for r in mix_sources(odd).collect():
        taken[r.doc_id] += r.repeats
    out = mixed_documents(odd)
    assert out.columns == odd.columns
    assert {k: v for k, v in taken.items() if v} == dict(Counter(r.doc_id for r in out.collect()))


# ------------------------------------------------------------------ pieces
@pytest.fixture(scope="module")
def model_path():
    return public_tokenizers.path("piece_bpe_32k.model")


ODD_TEXTS = ["", " ", "  two  spaces ", "▁x ▁", "a\n\tb\r\n", "ｆｕｌｌ ﬁ é é", "😀 中文 \x00 ﻿", "word " * 50, "x" * 500]


def test_pieces_without_dropout_are_the_librarys(model_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    model = PieceModel(model_path, 1, 0.0)
    # the library also merges runs of spaces, which are cut here
    texts = [t for t in ODD_TEXTS if "▁" not in t and "  " not in t and not t.startswith(" ") and not t.endswith(" ")] + ["The quick brown fox, 1234!", "unchanged andereaing ñandú"]
    flat, at = model.encode(pa.array(texts), np.zeros(len(texts), np.uint64))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) for t in texts]


def naive_merge(model, word, key):
    """One candidate after the other, as the agenda brings them up."""
    ids, _ = model.characters([word])
    pieces = [(int(i), n) for n, i in enumerate(ids)]
    skipped = set()
    while True:
        best = None
        for k in range(len(pieces) - 1):
            (a, at), (b, middle) = pieces[k], pieces[k + 1]
            piece = int(model.union(np.array([a]), np.array([b]))[0])
            if piece < 0 or (at, middle, piece) in skipped:
                continue
            with np.errstate(over="ignore"):
                draw = mix64(key + _salt(np.array([at]), np.array([middle]), np.array([piece])))[0]
            if draw < model.limit:
                skipped.add((at, middle, piece))
                continue
            if best is None or model.rank[piece] < best[0]:
                best = (model.rank[piece], k, piece, at)
        if best is None:
            return [i for i, _ in pieces]
        _, k, piece, at = best
        pieces[k : k + 2] = [(piece, at)]


def test_piece_dropout(model_path):
    model = PieceModel(model_path, 3, 0.3)
    some = ["internationalisation", "the", "ñandú", "unbelievable", "a", "x▁y", "reorganised", "unbelievable" * 20]
    text = " ".join(some * 5)
    for document in range(3):
        flat, at = model.encode(pa.array([text]), np.array([document], np.uint64))
        with np.errstate(over="ignore"):
            keys = mix64(mix64(np.array([document], np.uint64) + np.uint64(3)) + np.arange(40, dtype=np.uint64))
        assert flat.tolist() == [i for w, k in zip(some * 5, keys) for i in naive_merge(model, " " + w, k)]
    texts = pa.array(ODD_TEXTS)
    for document in range(4):
        flat, at = model.encode(texts, np.full(len(ODD_TEXTS), document, np.uint64))
        assert [x.decode() for x in model.decode(flat, at)] == ODD_TEXTS


def test_each_place_has_draws_of_its_own(model_path):
    model = PieceModel(model_path, 1, 0.1)
    texts = pa.array(["internationalisation of unbelievable reorganisation"] * 1000)
    flat, at = model.encode(texts, np.arange(1000, dtype=np.uint64))
    cuts = Counter(tuple(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
    assert len(cuts) > 100
    # a place keeps the run without skips if none of its merges is drawn
    root = model._runs(["unbelievable"])[0]
    run, _ = model._drawn(np.full(20_000, root), mix64(np.arange(20_000, dtype=np.uint64)))
    assert abs((run == root).mean() - 0.9 ** int(model.steps[root])) < 0.015
    flat, _ = model.encode(pa.array([" ".join(["unbelievable"] * 300)]), np.array([5], np.uint64))
    assert len(set(flat.tolist())) > 10
    again, _ = PieceModel(model_path, 1, 0.1).encode(pa.array([" ".join(["unbelievable"] * 300)]), np.array([5], np.uint64))
    assert flat.tolist() == again.tolist()


def test_long_word_without_spaces(model_path):
    model = PieceModel(model_path, 1, 0.1)
    text = "unbelievable中文" * 20_000
    began = time.time()
    flat, at = model.encode(pa.array([text]), np.array([1], np.uint64))
    assert model.decode(flat, at) == [text.encode()] and time.time() - began < 60
    # table and heap give the same ids
    for word in ("unbelievable" * 8, "x" * 100, "reorganised中文"):
        whole = PieceModel(model_path, 1, 0.0)
        ids, *_ = whole.segment([" " + word], np.zeros(1, np.uint64))
        assert ids.tolist() == whole.segment_long(" " + word, 0)


def test_copies_are_numbered(spark, odd, empty):
    rows = numbered_copies(odd.union(odd), "copy").collect()
    assert len(rows) == 2 * odd.count() and len({(r.doc_id, r.text, r.copy, *map(str, r)) for r in rows}) == len(rows)
    assert numbered_copies(empty).count() == 0


def test_encode_pieces_frame(spark, odd, empty, model_path):
    out = encode_pieces(odd, model_path, ids="piece_ids", keep=["doc_id", "text", "ids"])
    rows = decode_pieces(out.select("text", "piece_ids", "lossless", "ids_crc32"), model_path, ids="piece_ids").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.lossless and r.decoded == (r.text or "")
        assert r.ids_crc32 == zlib.crc32(np.array(r.piece_ids, "<u4").tobytes())
    assert encode_pieces(empty, model_path).count() == 0


# ------------------------------------------------------------------ classifiers
def labelled(spark, n=240):
    rng = np.random.default_rng(2)
    good, bad = ["alpha", "beta", "gamma", "delta", "omega", "sigma"], ["idiot", "moron", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choice(good, 40).tolist()
        toxic, junk = i % 4 == 0, i % 3 == 0
        if toxic:
            w[int(rng.integers(5, 30))] = bad[int(rng.integers(3))]
        if junk:
            w = [x.upper() + "!!" if x not in bad else x for x in w]
        w = [x + ("." if k % 8 == 7 else "") for k, x in enumerate(w)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, odd, empty, no_labels):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_scores(docs, labels, cfg=Subwords(buckets=1 << 12)).collect()
    assert len(rows) == 240
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.95
    assert quality_scores(empty, labels).count() == 0
    rows = quality_scores(odd, no_labels).collect()
    assert len(rows) == odd.count() and all(r.score == 0.5 for r in rows)
    assert quality_scores(odd, labels, cfg=Subwords(buckets=1 << 12)).where("score is null").count() == 0


def test_quality_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(spark)
    cfg = Subwords(buckets=1 << 12)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_scores(docs, labels, cfg=cfg).collect()) == sorted(quality_scores(docs, flipped, cfg=cfg).collect())


def gapped(s, t, p, decay):
    def f(x):
        d = Counter()
        for c in itertools.combinations(range(len(x)), p):
            d["".join(x[i] for i in c)] += decay ** (c[-1] - c[0] + 1)
        return d

    a, b = f(s), f(t)
    return sum(a[k] * b[k] for k in a)


def test_subsequence_kernel():
    for s, t in [("idiot", "idxiot"), ("abab", "bababa"), ("ab", "abc"), ("pathetic", "pthetc"), ("xyz", "abc")]:
        assert _kernel(_codes([s])[0], _codes([t])[0], 3, 0.6)[0] == pytest.approx(gapped(s, t, 3, 0.6), abs=1e-5)
    together = _kernel(_codes(["idxiot", "abc", "idiot"])[0], _codes(["idiot"])[0], 3, 0.6)
    assert together == pytest.approx([gapped(w, "idiot", 3, 0.6) for w in ("idxiot", "abc", "idiot")], abs=1e-5)


def test_toxicity(spark, odd, empty, no_labels):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity_scores(docs, labels, cfg=Machine(landmarks=12)).collect()
    assert len(rows) == 240
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.95
    near = Words(["idiot"], Machine()).kernels(["idiot", "idioot", "idxiot", "alpha", "id", "idi-ot", "i*d*i*o*t"])[:, 0]
    assert near[0] == pytest.approx(1) and near[0] > near[1] > near[2] > near[3] + 0.05 and near[3] == near[4] == 0
    assert near[5] == near[6] == pytest.approx(1)
    assert toxicity_scores(empty, labels).count() == 0
    rows = toxicity_scores(odd, no_labels).collect()
    assert len(rows) == odd.count() and all(r.predicted == 0 for r in rows)
    assert toxicity_scores(odd, labels, cfg=Machine(landmarks=12)).where("score is null").count() == 0


# ------------------------------------------------------------------ token files
def test_encoder_pieces_equal_whole_texts():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\t", " ", "a", "The", "é", "<|endoftext|>", "'s", "12", "...", "\x1c", "中", "😀", " ", " the", " \n", "Des", "Der", "\x0b"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(4000)] + ["Der", "Des", " Der", ""]
    for some in (texts, texts[::-1]):
        flat, at = encoder.encode(pa.array(some))
        whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(some, add_special_tokens=False)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in whole]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, tmp_path, encoding):
    path, tokenizer = str(tmp_path / encoding), public_tokenizers.path("byte_bpe_50k.json")
    write_tokens(encode_documents(odd, tokenizer), path, encoding, page_rows=20)
    rows = digests(spark, path).orderBy("start").collect()
    assert len(rows) == odd.count()
    encoder, want = Tokenizer.from_file(tokenizer), Counter()
    for r in odd.collect():
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.n_tokens for r in rows])))[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert read_tokens(spark, path, 10, 20).count() == 12  # 14 stands twice
    assert "ids" not in read_metadata(spark, path).columns
    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(max(glob.glob(f"{path}/*.parquet"), key=lambda f: pq.ParquetFile(f).metadata.num_rows)).metadata.row_group(0)
    column = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema.startswith("ids"))
    assert column.has_offset_index
    assert ("RLE_DICTIONARY" in column.encodings or "PLAIN_DICTIONARY" in column.encodings) == (encoding == "dictionary")
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


# ------------------------------------------------------------------ substring dedup
def brute_dedup(rows, n):
    first = {}
    for doc_id, text in rows:
        w = words(text)
        key = (doc_id is None, doc_id or 0)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, (key, i)), (key, i))
    out = Counter()
    for doc_id, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < ((doc_id is None, doc_id or 0), i) for j in range(i, i + n)}
        out[(doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("n,piece", [(20, 100_000), (8, 40), (5, 100_000)])
def test_substring_dedup(odd, n, piece):
    own = odd.select("doc_id", "text", F.lit(1).alias("t"), F.lit(2).alias("dedup_spans"))
    out = remove_repeats(own, n=n, piece=piece)
    assert out.columns == [*own.columns, "n_words", "n_removed"]
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    assert got == brute_dedup([(r.doc_id, r.text) for r in own.collect()], n)


def test_substring_dedup_within_a_document_and_hot_passages(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} b{i} {passage} c{i} " + (passage if i % 3 == 0 else "")) for i in range(50)] + [(60, "x y " * 40), (61, "z " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in remove_repeats(docs, piece=16).collect())
    assert got == brute_dedup(rows, 20)


def test_substring_dedup_hot_prefix(spark):
    """One anchor in every text, with other words around it: groups stay within the bound, and repeats that hold it are found."""
    rng = random.Random(8)
    phrases = [[f"hot{i}", "beta", "gamma", "delta", "epsilon"] for i in range(300)]
    hot = " ".join(min(phrases, key=lambda p: grams(hashes(p), 5)[0]))
    mixed = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(18))
    around = [(mixed(), mixed()) for _ in range(40)]
    texts = [f"{a} {hot} {b}" for a, b in around] * 3 + [f"{mixed()} {hot} {b}" for _, b in around] + [f"{mixed()} {hot} {mixed()}" for _ in range(400)]
    rng.shuffle(texts)
    rows = [(i, f"{t} end{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in remove_repeats(docs, piece=50).collect())
    assert got == brute_dedup(rows, 20)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    first = keyed.groupBy("t").agg(F.min("doc_id").alias("first")).withColumnRenamed("t", "t2")
    most = lambda piece: grouped_suffixes(keyed, first, 20, piece).where("off >= 0").groupBy("key").count().agg(F.max("count")).first()[0]
    assert most(50) <= 50 < 400 < most(100_000)


# ------------------------------------------------------------------ licences
def test_templates():
    scanner = Scanner(TEMPLATES, PHRASES)
    found = lambda t: {x for _, _, x in scanner.scan(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower().encode()))[1]}
    assert found("Released under the MIT License.") == {"mit"}
    assert "apache-2.0" in found("Licensed under the Apache License, Version 2.0.") and "apache-2.0" in found("under the apache license 2.0")
    assert not found("under the apache software license 2.0")
    assert "gpl-notice" in found("licensed under the GNU General Public License, version 3.")
    assert "cc-by" in found("Licensed under CC BY-NC 4.0.")
    assert "copyright" in found("Copyright (c) 2020 Some Body. All rights reserved")
    one = Scanner({"x": "aa [[bb [[cc]] ]]dd {{1-2}} ee"}, {})
    spans = lambda t: one.scan(t.encode().split())[1]
    assert spans("aa dd q ee") and spans("aa bb dd q r ee") and spans("aa bb cc dd q ee")
    assert not spans("aa cc dd q ee") and not spans("aa dd ee") and not spans("aa dd q r s ee")
    for bad in ("[[only]]", "", "aa [[bb", "{{0-2}}"):
        with pytest.raises(ValueError):
            compile_template(bad)


MIT = """Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

WHOLE = {"mit-text": MIT, "bsd-2-clause": BSD_HEAD + BSD_TAIL, "bsd-3-clause": BSD_HEAD + BSD_NAMES + BSD_TAIL, "isc": ISC}


@pytest.mark.parametrize("label", WHOLE)
def test_whole_licenses(label):
    scanner = Scanner(TEMPLATES, PHRASES)
    tokens = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower().encode())
    own = tokens(WHOLE[label])
    _, spans, score = scanner.scan([b"some", b"code", *own, b"more", b"code"])
    assert score == 1.0 and {x for _, _, x in spans} & set(WHOLE) == {label}
    start, end, _ = next(s for s in spans if s[2] == label)
    assert end == len(own) + 2 and start >= 2
    # other holders and other numbers of conditions are the same licence
    other = re.sub(r"(?m)^\d\.", "*", WHOLE[label]).replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "ACME INC").replace("THE AUTHOR DISCLAIMS", "J DOE DISCLAIMS").replace("AUTHORS OR COPYRIGHT HOLDERS BE", "ACME INC BE")
    assert label in {x for _, _, x in scanner.scan(tokens(other))[1]}
    # a word changed or left out anywhere but in a holder's name or a number makes it another text
    holders = {"mit-text": "the authors or copyright holders", "bsd-2-clause": "the copyright holders and contributors", "bsd-3-clause": "the copyright holders and contributors", "isc": "the author"}[label].encode().split()
    name = "the copyright holder or contributors the copyright holder its".split()
    loose = {w for w in (*holders, *(x.encode() for x in name), b"or", b"above", b"1", b"2", b"3")}
    for i in range(start - 2, len(own)):
        for altered in ([*own[:i], b"zzz", *own[i + 1 :]], [*own[:i], *own[i + 1 :]]):
            if label in {x for _, _, x in scanner.scan(altered)[1]}:
                assert own[i] in loose


def test_altered_licenses_are_openings_only():
    scanner = Scanner(TEMPLATES, PHRASES)
    tokens = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower().encode())
    for text, opening in ((MIT.replace("without restriction, including", "without restriction except that the software shall not be sold, including"), "mit-opening"),
                          (BSD_HEAD.replace("are permitted", "are permitted only to members of the club") + BSD_TAIL, "bsd-opening")):
        _, spans, score = scanner.scan(tokens(text))
        assert {x for _, _, x in spans} == {opening} and score < 0.7


def test_license_scan(spark, odd, empty):
    texts = ["MIT-license Mit\nLICENSE", "the GNU General   Public License, version 3", None, "", "no licence here", "apache license x General Public License", "xmit license", "émit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        want = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(w) and sorted((p.start, p.label) for p in r.places) == sorted(want) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.places or r.spans)
    assert scan_licenses(odd).count() == odd.count() and scan_licenses(empty).count() == 0


# ------------------------------------------------------------------ top k
def brute_top_k(rows, k, query):
    ok = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: (i, v) for i, v in ok if query(i)}.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_rows", [(4096, 2048), (50, 7)])
def test_top_k(spark, shard_rows, query_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 420)]
    rows += [(420, None), (440, [1.0, None] + [0.0] * 4), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (520, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank: string".replace(", rank: string", "")).withColumn("shard", F.lit("x"))
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=shard_rows, query_rows=query_rows).collect())
    assert got == brute_top_k(plain, 5, lambda i: i % 20 == 0)


def test_top_k_large_components_and_empty(spark):
    rows = [(i, [1e6 * (i + 1), -3e5 * i, 7.5]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in top_k(df, F.col("vec_id") == 3, k=4).collect())
    assert got == [x[:3] for x in brute_top_k(rows, 4, lambda i: i == 3)]
    assert top_k(df.where("false"), F.col("vec_id") == 3).count() == 0


# ------------------------------------------------------------------ Jaccard
def brute_components(rows, n, percent):
    def shingles(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[(doc_id, len(sets[i]), min(members) if members else None)] += 1
    return out


@pytest.mark.parametrize("n,percent,block", [(4, 85, 150_000), (4, 85, 300), (5, 80, 500), (2, 50, 150_000)])
def test_jaccard_components(spark, odd, n, percent, block):
    from seqframe.llm import jaccard

    rng = np.random.default_rng(n * percent)
    base = [f"w{i}" for i in range(60)]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for i in range(40):  # a family of copies with more and more words changed
        w = list(base)
        for j in rng.integers(0, 60, i % 6):
            w[j] = f"x{i}_{j}"
        rows.append((200 + i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(0)).repartition(6)
    old = jaccard.jaccard_classes.__defaults__
    jaccard.jaccard_classes.__defaults__ = (*old[:-1], block)
    try:
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, n, percent).collect())
    finally:
        jaccard.jaccard_classes.__defaults__ = old
    assert got == brute_components(rows, n, percent)


def test_linked_sets_against_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(50)]
    label = linked_sets(sets, 60, columns=7)
    root = list(range(50))
    for _ in range(50):
        for i, j in itertools.combinations(range(50), 2):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 60 * len(a | b):
                root[i] = root[j] = min(root[i], root[j])
    assert label.tolist() == root


@pytest.mark.parametrize("percent,cells", [(60, 64), (85, 500), (30, 4_000_000)])
def test_linked_sets_in_blocks(percent, cells):
    rng = np.random.default_rng(percent)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = []
    for i in range(90):
        s = base[(i % 6) * 50 : (i % 6) * 50 + 40].copy()
        s[rng.integers(0, 40, i % 9)] = rng.integers(0, 1 << 60, i % 9)
        sets.append(np.unique(s if i % 5 else s[: i % 7 + 1]))
    root = list(range(90))
    for _ in range(90):
        old = list(root)
        for i, j in itertools.combinations(range(90), 2):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= percent * len(a | b):
                root[i] = root[j] = min(root[i], root[j])
        if root == old:
            break
    assert linked_sets(sets, percent, cells=cells).tolist() == root


def test_linked_sets_of_many_small_sets():
    """One token in common and three of their own: memory must not grow with the square of the sets."""
    import tracemalloc

    rng = np.random.default_rng(6)
    sets = [np.unique(np.append(x, 7).astype(np.uint64)) for x in rng.integers(10, 1 << 60, (6000, 3))]
    sets[5000] = sets[40]
    tracemalloc.start()
    label = linked_sets(sets, 85, cells=400_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.arange(6000)
    want[5000] = 40
    assert (label == want).all() and peak < 40e6


def test_one_of_each(odd, empty):
    out = one_of_each(odd, 4, 85)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 14 in ids and 101 not in ids and 102 not in ids and 100 not in ids
    assert one_of_each(empty).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}


# ------------------------------------------------------------------ empty tables and the pipeline
def test_empty_tables(spark, empty, tmp_path):
    assert QR.quality_rules(empty).count() == 0 and QR.keep_good(empty).columns == empty.columns
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0
    assert remove_repeats(empty).count() == 0 and jaccard_components(empty).count() == 0
    write_tokens(encode_documents(empty, public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "none"))
    assert digests(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns, name
        docs = spark.createDataFrame(out.collect(), odd.schema)
        assert docs.count() > 0, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)


def test_pipeline_run(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.lossless and r.n_ids == len(r.ids) for r in rows)
    kept = {r.doc_id for r in QR.keep_good(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {r.doc_id for r in rows} <= kept
