"""Toxicity by a support vector machine on a gapped subsequence kernel, with Nystroem landmarks.

Two strings share a subsequence of ``order`` characters even where other
characters stand between them; each costs a factor ``decay`` for every
character it spans, in both strings.  The kernel of two words, normalised and
raised to a power, is close to 1 only for words that are alike but for a few
inserted or missing characters; that of two sentences sums it over their words.
Letters set apart one by one are read as a word, signs between letters may be
left out, and long words are taken window by window (``forms``).

Landmarks are words of the training sentences; the kernel to them, times the
inverse root of the kernel among them, gives features in which a linear machine
is trained (hinge loss, subgradient steps, in numpy, in one task).  Labels are
known for documents only: a sentence of a toxic document is labelled toxic if it
holds a word that marks toxic documents, sentences of other documents are not.
A document's score comes from its worst sentence.  Since the decision of a
sentence is a sum over its words, scoring needs one number for each distinct
word, which a Python worker keeps for its next tasks.

Cases: null and empty texts get the lowest score; with no labelled rows of both
kinds every score is 0; a null doc_id is scored like others; repeated rows get
equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import from_columns, hashes, slices, word_lists
from seqframe.llm.labelled import held_out, sample

#: What ends a sentence, what is put into words that are learned from, and what is cut off the ends of a word.
SENTENCE_END = r"[.!?]+\s+|[.!?]+$|\n+"
DISGUISE = "x0aeiou"
#: Longer words are taken window by window, every window: this many characters each, one starting every half.
LONG = 32
#: Letters set apart one by one, to be read as a word; the first pattern finds the texts that have any.
SPELT_TEXT = r"(^|[^\pL\pN])\pL([ .*_\-]\pL){2,}([^\pL\pN]|$)"
SPELT = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_\-][^\W\d_]){2,}(?![^\W_])")
TRIM = "\"'.,;:!?()[]{}&%$#*|<>"


@dataclass(frozen=True)
class Machine:
    """``max_rows``, ``max_chars`` and ``max_sentences`` bound what is learned from."""

    order: int = 3
    decay: float = 0.85
    power: int = 4
    landmarks: int = 64
    disguises: int = 1
    max_rows: int = 3000
    max_chars: int = 20_000
    max_sentences: int = 20_000
    #: landmarks are chosen from this many words that mark toxic documents and this many usual ones, the most frequent first
    max_marking: int = 400
    max_usual: int = 3000
    epochs: int = 30
    ridge: float = 1e-5
    seed: int = 11


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the words as rows of a table, and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros((len(words), max(1, int(size.max(initial=0)))), np.uint32)
    table[np.repeat(np.arange(len(words)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return table, size


def _kernel(a: np.ndarray, b: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The gapped subsequence kernel of each row of ``a`` with the same row of ``b``, or with the one row that ``b`` has; 0 is no character."""
    rows, width = a.shape
    a = np.ascontiguousarray(a.T)  # words side by side, as all of them take each step together
    same = [(a == b[:, j]) & (a != 0) for j in range(b.shape[1])]
    ending = [np.where(s, np.float32(decay * decay), np.float32(0)) for s in same]  # of one character, by its place in b
    for _ in range(order - 1):
        # gaps: sums over all earlier places in a and b, each step further costs a factor
        carried, further = np.zeros((width + 1, rows), np.float32), []
        for j in range(b.shape[1]):
            further.append(np.where(same[j], np.float32(decay * decay) * carried[:-1], np.float32(0)))
            step = np.zeros(rows, np.float32)
            carried *= np.float32(decay)
            for i in range(width):
                step = decay * step + ending[j][i]
                carried[i + 1] += step
        ending = further
    return sum(np.ascontiguousarray(e.T).sum(axis=1) for e in ending)


def forms(word: str) -> list[str]:
    """What a word is compared as: itself, itself without signs between its letters, what stands between the signs, and, of what is long,
    all windows."""
    out = [word]
    if not word.isalnum():
        parts = re.findall(r"[^\W_]+", word)
        out += [p for p in ("".join(parts), *parts) if p and p != word]
    if max(map(len, out)) <= LONG:
        return out
    return [w[i : i + LONG] for w in out for i in range(0, max(1, len(w) - LONG // 2), LONG // 2)]


class Words:
    """Kernels of words to landmarks; a word's kernel is the highest of its forms."""

    def __init__(self, landmarks: list[str], cfg: Machine):
        self.landmarks, self.cfg = landmarks, cfg
        self.table = [_codes([w])[0] for w in landmarks]
        self.own = np.array([self._self(_codes([w])[0])[0] for w in landmarks], np.float32)
        self.letters = [frozenset(w) for w in landmarks]

    def _self(self, table: np.ndarray) -> np.ndarray:
        return _kernel(table, table, self.cfg.order, self.cfg.decay)

    def kernels(self, words: list[str]) -> np.ndarray:
        """A row for each word: its kernel with every landmark."""
        other = [i for i, w in enumerate(words) if len(w) > LONG or not w.isalnum()]
        if not other:
            return self._kernels(words)
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        plain = np.ones(len(words), bool)
        plain[other] = False
        out[plain] = self._kernels([words[i] for i in np.flatnonzero(plain)])
        lists = [forms(words[i]) for i in other]
        flat = sorted({f for x in lists for f in x})
        number = {f: i for i, f in enumerate(flat)}
        values = self._kernels(flat)
        for i, x in zip(other, lists, strict=True):
            out[i] = values[[number[f] for f in x]].max(axis=0)
        return out

    def _kernels(self, words: list[str]) -> np.ndarray:
        """Of words that are not long; those of like length are worked out together."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        order = order[size[order] >= self.cfg.order]
        start = 0
        while start < len(order):
            width = int(size[order[start]])
            stop = min(int(np.searchsorted(size[order], width + width // 4, side="right")), start + max(1, 60_000 // width))
            rows = order[start:stop]
            table, _ = _codes([words[i] for i in rows])
            own = None
            for m, landmark in enumerate(self.table):
                # a subsequence needs characters in common; without them the kernel is 0
                common = sum((table == c).sum(axis=1) for c in np.unique(landmark[0])) >= self.cfg.order
                if not common.any():
                    continue
                if own is None:
                    own = self._self(table)
                some = np.flatnonzero(common)
                k = _kernel(table[some], landmark, self.cfg.order, self.cfg.decay) / np.sqrt(np.maximum(own[some] * self.own[m], np.float32(1e-20)))
                out[rows[some], m] = np.minimum(k, 1) ** self.cfg.power
            start = stop
        return out


def clean(words: list[str]) -> list[str]:
    return [w.strip(TRIM).lower() for w in words]


def sentences(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as they stand, the number of each word, and the offsets of sentences in words and of texts in sentences."""
    texts = pc.fill_null(texts, "")
    spelt = pc.match_substring_regex(texts, SPELT_TEXT).to_numpy(zero_copy_only=False)
    if spelt.any():
        joined = [SPELT.sub(lambda m: m[0][::2], t) for t in texts.filter(pa.array(spelt)).to_pylist()]
        texts = pc.replace_with_mask(texts, pa.array(spelt), pa.array(joined, texts.type))
    parts = pc.split_pattern_regex(texts, SENTENCE_END)
    of_text = parts.offsets.to_numpy().astype(np.int64)
    flat, of_sentence = word_lists(parts.values.slice(of_text[0], of_text[-1] - of_text[0]))
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), of_sentence, of_text - of_text[0]


def choose_landmarks(marking: list[str], common: list[str], cfg: Machine) -> list[str]:
    """Three quarters of words that mark toxic documents, the farthest from those chosen before first, and ordinary words most like them."""
    marking = marking[: cfg.max_marking]
    if not marking:
        return []
    many = cfg.landmarks * 3 // 4
    k = Words(marking, cfg).kernels(marking)
    chosen, near = [0], k[:, 0].copy()
    while len(chosen) < min(many, len(marking)):
        i = int(np.argmin(near))
        if i in chosen:
            break
        chosen.append(i)
        near = np.maximum(near, k[:, i])
    toxic = [marking[i] for i in chosen]
    alike = Words(toxic, cfg).kernels(common).max(axis=1) if common else np.zeros(0)
    plain = [common[i] for i in np.argsort(-alike, kind="stable")[: cfg.landmarks - len(toxic)]]
    return toxic + plain


def train(texts: pa.Array, y: np.ndarray, cfg: Machine) -> tuple[list[str], np.ndarray, float, float, float]:
    """Landmarks, what each adds, the machine's bias, and slope and shift of the log odds of a document's worst sentence."""
    nothing = ([], np.zeros(0, np.float32), 0.0, 0.0, -50.0)
    if len(set(y.tolist())) < 2:
        return nothing
    rng = np.random.default_rng(cfg.seed)
    raw, code, of_sentence, of_text = sentences(texts)
    names = clean(raw)
    words = sorted(set(names))
    number = {w: i for i, w in enumerate(words)}
    code = np.array([number[w] for w in names], np.int64)[code]
    sentence = np.repeat(np.arange(len(of_sentence) - 1), np.diff(of_sentence))
    text = np.repeat(np.arange(len(y)), np.diff(of_text))[sentence]
    # places of a word, each pair of neighbours counted once, so that copied passages count once
    label = y[text]
    follows = np.concatenate((sentence[1:] == sentence[:-1], [False]))
    after, before = np.where(follows, np.roll(code, -1), -1), np.where(np.roll(follows, 1), np.roll(code, 1), -1)
    places = np.unique(np.stack((code, before, after, label), axis=1), axis=0)
    toxic, other = (np.bincount(places[places[:, 3] == v, 0], minlength=len(words)) for v in (1, 0))
    # a word marks toxic documents if chance would not give any word such a share in them
    share, usual_share = toxic / np.maximum(1, toxic + other), max(1e-9, toxic.sum() / max(1, len(places)))
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = (toxic + other) * (np.nan_to_num(share * np.log(share / usual_share)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - usual_share))))
    order = sorted(np.flatnonzero((surprise > np.log(len(words))) & (share > 0.9) & (toxic >= 3)).tolist(), key=lambda i: (-toxic[i], words[i]))
    marking = [words[i] for i in order if cfg.order <= len(words[i]) <= LONG]
    usual = [words[i] for i in np.argsort(-other, kind="stable")[: cfg.max_usual] if cfg.order <= len(words[i]) <= LONG]
    landmarks = choose_landmarks(marking, usual, cfg)
    if not landmarks:
        return nothing
    marks = np.zeros(len(words), bool)
    marks[[number[w] for w in marking]] = True
    held = np.bincount(sentence, weights=marks[code], minlength=len(of_sentence) - 1) > 0
    label = np.repeat(y, np.diff(of_text))
    marked_word = np.full(len(of_sentence) - 1, -1)
    marked_word[sentence[marks[code]]] = code[marks[code]]
    positive, negative = np.flatnonzero(held & (label == 1)), np.flatnonzero((label == 0) & (np.diff(of_sentence) > 0))
    half = cfg.max_sentences // 2
    used = np.concatenate([rng.permutation(x)[:half] for x in (positive, negative)])
    target = np.where(label[used] == 1, 1.0, -1.0)

    among = Words(landmarks, cfg)
    kernel = among.kernels(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    by_word = among.kernels(words).astype(np.float64) @ root
    place = np.full(len(of_sentence) - 1, -1)
    place[used] = np.arange(len(used))
    inside = place[sentence] >= 0
    x = np.zeros((len(used), len(landmarks)))
    np.add.at(x, place[sentence[inside]], by_word[code[inside]])
    # toxic sentences stand again, their word with a letter put in
    again = np.tile(np.flatnonzero(target > 0), cfg.disguises)
    old = marked_word[used[again]]
    new = [_disguised(words[i], rng) for i in old]
    x = np.concatenate((x, x[again] - by_word[old] + among.kernels(new).astype(np.float64) @ root))
    target = np.concatenate((target, target[again]))

    weight, bias, average, average_bias, n = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    balance = {1.0: 0.5 / max(1, (target > 0).sum()) * len(target), -1.0: 0.5 / max(1, (target < 0).sum()) * len(target)}
    step = 0
    for epoch in range(cfg.epochs):
        for i in rng.permutation(len(target)):
            step += 1
            rate = 1 / (cfg.ridge * (step + 1 / cfg.ridge))
            weight *= 1 - rate * cfg.ridge
            if target[i] * (x[i] @ weight + bias) < 1:
                weight += rate * target[i] * balance[target[i]] * x[i]
                bias += 0.1 * rate * target[i] * balance[target[i]]
            if epoch >= cfg.epochs // 2:
                average += weight
                average_bias += bias
                n += 1
    weight, bias = average / n, average_bias / n
    adds = root @ weight
    worst = document_scores(by_word @ weight, code, of_sentence, of_text, bias)
    slope, shift = _logistic(worst, y)
    return landmarks, adds.astype(np.float32), float(bias), slope, shift


def _disguised(word: str, rng: np.random.Generator) -> str:
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + DISGUISE[int(rng.integers(len(DISGUISE)))] + word[at:]


def document_scores(by_word: np.ndarray, code: np.ndarray, of_sentence: np.ndarray, of_text: np.ndarray, bias: float) -> np.ndarray:
    """The highest decision among each text's sentences; the bias alone for a text without words."""
    total = np.concatenate(([0.0], np.cumsum(by_word[code])))[of_sentence]
    decision = np.append(np.diff(total) + bias, bias)
    out = np.full(len(of_text) - 1, bias)
    full = np.flatnonzero(np.diff(of_text) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(decision[:-1], of_text[:-1][full])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds of y, both labels weighing the same, by Newton steps on a penalised likelihood."""
    centre, scale = x.mean(), x.std() + 1e-9
    z = np.stack(((x - centre) / scale, np.ones(len(x))), axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - 0.05 * beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


class Scorer:
    def __init__(self, model: tuple, cfg: Machine, memory: int = 1_500_000):
        self.landmarks, self.adds, self.bias, self.slope, self.shift = model
        self.words, self.memory = Words(self.landmarks, cfg), memory
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    @classmethod
    def of(cls, model: tuple, cfg: Machine) -> Scorer:
        kept = sys.modules.setdefault("seqframe_kept", types.ModuleType("seqframe_kept")).__dict__
        name = f"toxicity {zlib.crc32(repr((model[0], model[1].tobytes(), model[2:], cfg)).encode())}"
        if name not in kept:
            for old in [k for k in kept if k.startswith("toxicity ")]:
                del kept[old]
            kept[name] = cls(model, cfg)
        return kept[name]

    def _values(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence."""
        names = clean(words)
        keys, first, number = np.unique(hashes(names), return_index=True, return_inverse=True)
        if len(self.keys) > self.memory:
            self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            value = self.words.kernels([names[i] for i in first[new]]) @ self.adds
            self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], value)
            at = np.searchsorted(self.keys, keys)
        return self.values[at][number]

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        raw, code, of_sentence, of_text = sentences(texts)
        by_word = self._values(raw).astype(np.float64) if raw and self.landmarks else np.zeros(len(raw))
        return self.slope * document_scores(by_word, code, of_sentence, of_text, self.bias) + self.shift


def _trained(cfg: Machine) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "y"], kind="stable")  # whatever order they come in
        landmarks, adds, *rest = train(pa.array(rows["text"], pa.string()), rows["y"].to_numpy(np.int64), cfg)
        return pd.DataFrame({"landmarks": [landmarks], "adds": [adds.astype("<f4").tobytes()], "rest": [list(map(float, rest))]})

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, cfg: Machine = Machine(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, held_out (its crc32 modulo ``folds`` is ``fold``; never learned from), score (probability of label 1), predicted."""
    rows = sample(docs, labels, label, folds, fold, cfg.max_rows, cfg.max_chars, doc_id, text)
    found = rows.groupBy().applyInPandas(_trained(cfg), "landmarks array<string>, adds binary, rest array<double>").first()
    model = (list(found["landmarks"]), np.frombuffer(found["adds"], "<f4"), *found["rest"]) if found else ([], np.zeros(0, np.float32), 0.0, 0.0, -50.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(model, cfg)
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                p = 1 / (1 + np.exp(-np.clip(scorer.log_odds(part.column("text")), -50, 50)))
                yield from_columns(doc_id=part.column("doc_id"), held_out=part.column("held_out"), score=p, predicted=pa.array((p >= 0.5).astype(np.int32)))

    own = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), folds, fold).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
