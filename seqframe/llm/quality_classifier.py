"""Quality classifier by supervised subword embeddings.

A document's features are its words and their character n-grams, hashed into a
table of learned vectors; also, to tell repetition, one mark for a word that
stands among the few before it.  The vectors are averaged, a softmax over the
average gives the label's probabilities, and vectors and output weights are
learned together by stochastic gradient descent in numpy, in one task, on a
bounded sample of labelled rows.

With two labels, a document's log odds are an average of one number for each
feature, so scoring needs only that number for each table entry, and sums it up
once for each distinct word of a slice.

Cases: null and empty texts have no features and get the prior's score; with
no labelled rows every score is 0.5; a null doc_id is scored like others;
repeated rows get equal scores; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import from_columns, hashes, mix64, slices, word_lists
from seqframe.llm.labelled import held_out, sample


#: A repeated word counts as so many features, as a word with its n-grams does.
REPEAT_WEIGHT = 10


@dataclass(frozen=True)
class Subwords:
    """``max_rows`` and ``max_chars`` bound the rows that are learned from."""

    buckets: int = 1 << 18
    shortest: int = 3
    longest: int = 5
    back: int = 3
    dims: int = 16
    epochs: int = 5
    rate: float = 20.0
    max_rows: int = 3000
    max_chars: int = 20_000
    seed: int = 7


def word_features(words: list[str], cfg: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of all words (each word, then its n-grams between < and >) and the offsets of the words."""
    n = len(words)
    marked = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    start = np.cumsum(size) - size
    end = np.repeat(start + size, size)
    entries, owner = [hashes(words, cfg.seed)], [np.arange(n)]
    at = np.arange(len(code))
    owner_of = np.repeat(np.arange(n), size)
    h = mix64(code + np.uint64(cfg.seed))
    for k in range(2, cfg.longest + 1):
        inside = at + k <= end[at]
        at, h = at[inside], h[inside]
        with np.errstate(over="ignore"):
            h = mix64(h * np.uint64(31) + code[at + k - 1])
        if k >= cfg.shortest:
            entries.append(h)
            owner.append(owner_of[at])
    entry, own = np.concatenate(entries), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return (entry[order] % np.uint64(cfg.buckets)).astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n))))


def repeats(code: np.ndarray, offsets: np.ndarray, back: int) -> np.ndarray:
    """Whether each word is among the ``back`` words before it in its text."""
    out = np.zeros(len(code), bool)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k in range(1, back + 1):
        out[k:] |= (code[k:] == code[:-k]) & (text[k:] == text[:-k])
    return out


def train(texts: pa.Array, y: np.ndarray, cfg: Subwords) -> tuple[np.ndarray, float]:
    """What each table entry adds to the log odds of label 1, and what all documents have."""
    rng = np.random.default_rng(cfg.seed)
    table = ((rng.random((cfg.buckets + 1, cfg.dims)) - 0.5) / cfg.dims).astype(np.float32)
    weight, bias = np.zeros((2, cfg.dims), np.float32), np.zeros(2, np.float32)
    if len(y):
        flat, offsets = word_lists(texts)
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        entry, at = word_features(coded.dictionary.to_pylist(), cfg)
        again = repeats(code, offsets, cfg.back)
        docs = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            used, many = np.unique(code[a:b], return_counts=True)
            size = at[used + 1] - at[used]
            total = np.cumsum(size)
            entries = entry[np.repeat(at[used] - (total - size), size) + np.arange(total[-1])] if len(used) else np.zeros(0, np.int64)
            share = np.repeat(many, size)
            extra = int(again[a:b].sum())
            entries, share = np.append(entries, cfg.buckets), np.append(share, extra * REPEAT_WEIGHT)
            docs.append((entries, (share / max(1, share.sum())).astype(np.float32)))
        steps, step = cfg.epochs * len(y), 0
        for _ in range(cfg.epochs):
            for i in rng.permutation(len(y)):
                entries, share = docs[i]
                rate = cfg.rate * (1 - step / steps)
                step += 1
                mean = share @ table[entries]
                z = weight @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = p @ weight
                # no step changes a document's own odds by more than the error asks for
                for_table = min(rate, 1 / max(1e-9, float(share @ share) * float((weight**2).sum())))
                for_weight = min(0.05 * rate, 1 / max(1e-9, float(mean @ mean)))
                weight -= for_weight * np.outer(p, mean)
                bias -= 0.0005 * rate * p
                np.subtract.at(table, entries, for_table * share[:, None] * back[None, :])
    return table @ (weight[1] - weight[0]), float(bias[1] - bias[0])


def log_odds(texts: pa.Array, adds: np.ndarray, prior: float, cfg: Subwords) -> np.ndarray:
    flat, offsets = word_lists(texts)
    if not len(flat):
        return np.full(len(texts), prior)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy()
    entry, at = word_features(coded.dictionary.to_pylist(), cfg)
    by_word = np.add.reduceat(adds[entry].astype(np.float64), at[:-1])
    size = np.diff(at).astype(np.float64)
    again = repeats(code, offsets, cfg.back) * REPEAT_WEIGHT
    value = np.concatenate(([0.0], np.cumsum(by_word[code] + again * float(adds[-1]))))[offsets]
    many = np.concatenate(([0.0], np.cumsum(size[code] + again)))[offsets]
    return prior + np.diff(value) / np.maximum(1, np.diff(many))


def _trained(cfg: Subwords) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "y"], kind="stable")  # whatever order they come in
        adds, prior = train(pa.array(rows["text"], pa.string()), rows["y"].to_numpy(np.int64), cfg)
        return pd.DataFrame({"adds": [adds.astype("<f4").tobytes()], "prior": [prior]})

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, cfg: Subwords = Subwords(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, held_out (its crc32 modulo ``folds`` is ``fold``; never learned from), score (probability of label 1), predicted."""
    rows = sample(docs, labels, label, folds, fold, cfg.max_rows, cfg.max_chars, doc_id, text)
    model = rows.groupBy().applyInPandas(_trained(cfg), "adds binary, prior double").first()
    adds, prior = (np.frombuffer(model["adds"], "<f4"), model["prior"]) if model else (np.zeros(cfg.buckets + 1, np.float32), 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                odds = log_odds(part.column("text"), adds, prior, cfg)
                p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
                yield from_columns(doc_id=part.column("doc_id"), held_out=part.column("held_out"), score=p, predicted=pa.array((p >= 0.5).astype(np.int32)))

    own = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), folds, fold).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
