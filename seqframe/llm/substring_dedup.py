"""Substring dedup by prefix-partitioned suffix trees.

A window is ``n`` words in a row; each word is removed that some window covers
whose words also start earlier (in a document of smaller doc_id, or earlier in
the same one).

Every window start is a suffix.  Its prefix is cut behind its anchor, the
smallest 5-gram hash of the window, so prefixes are 5 to ``n`` words long and
windows of equal words have equal prefixes.  Suffixes of one prefix are a group;
an anchor of more than ``piece`` suffixes is too large for one, so its prefixes
are lengthened by all the other words of the window:

1. Anchors that occur in one text only, once, can't start a repeat; they are
   found by a shuffle of (anchor, place).
   The same shuffle counts the places of each anchor.
2. The suffixes of the other anchors are sent to the task of their prefix, with
   the words around the anchor that their windows hold.  An anchor within the
   bound sends all its windows in one row; a larger one sends each window by
   itself, to the task of the window's own words.  So a group has at most
   ``piece`` rows, or all its windows are equal.
3. A task builds each group's subtree: it sorts the suffixes by their words and
   compares neighbours.  Neighbours that agree in all ``n`` words share an
   internal node of that depth, whose leaves are all places of the repeat; all
   but the earliest are marked.  Neighbouring marks make up maximal repeats.

Before 1 and 2, what a slice of a task's texts holds several times is sent once,
so a passage in a third of all documents is a row a slice.  A group's suffixes
come in order of doc_id and are taken piece by piece; of equal windows only the
first places are kept between pieces.  Exact copies of a text are not compared at all: all of
their words are covered.

Cases: null and empty texts have no words; a null doc_id counts as the largest;
rows with equal doc_id and text are treated alike (neither is earlier); a text
of fewer than ``n`` words keeps all; an empty table gives an empty result;
other columns are kept.  64-bit hashes stand for 5-grams and, within a slice,
for windows; 40-bit ones for the single words beside an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqframe.llm.common import cut, fresh, from_columns, grams, mix64, schema_with, slices, text_key, tidy, word_hashes, word_lists
from seqframe.session import sized

K = 5
WORD_BITS = np.uint64((1 << 40) - 1)
LAST = (1 << 63) - 1
PIECE = 100_000


class Windows:
    """The windows of some texts, by anchor: positions count the words of all texts; window ``start[i] .. + count[i] - 1`` have the anchor ``at[i]``."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, n: int):
        self.words, self.offsets, self.n = words, offsets, n
        self.text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.grams = grams(words, K)
        empty = np.zeros(0, np.int64)
        self.at = self.start = self.count = empty
        size = len(words) - n + 1
        if size <= 0:
            return
        wide = n - K + 1
        least, span = self.grams, 1
        while span < wide:
            shift = min(span, wide - span)
            least = np.minimum(least[:-shift], least[shift:])
            span += shift
        offset = np.zeros(size, np.int64)
        for o in range(wide - 1, -1, -1):
            offset[self.grams[o : o + size] == least] = o
        starts = np.flatnonzero(self.text_of[:size] == self.text_of[n - 1 :])
        if not len(starts):
            return
        at = starts + offset[starts]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
        first = np.flatnonzero(new)
        self.at, self.start, self.count = at[first], starts[first], np.diff(np.append(first, len(starts)))

    def names(self, starts: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each whole window."""
        out = self.grams[starts]
        with np.errstate(over="ignore"):
            for step in [*range(K, self.n - K, K), self.n - K]:
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + self.grams[starts + step])
        return out


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("doc_id").to_numpy(), part.column("t").to_numpy()


def _scatter(*parts: np.ndarray) -> np.ndarray:
    """Keys for rows that belong to no group, spread evenly."""
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def _anchors(n: int) -> Callable:
    """(key, t, place) of anchors; place is twice the position in the text, plus one if the anchor is known to repeat (which it says
    to others of its key), and above 32 bits the number of the anchor's places in the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Windows(*word_hashes(part.column("text")), n)
                if not len(w.at):
                    continue
                t = part.column("t").to_numpy()
                # a copy of a text of this slice adds nothing
                _, first = np.unique(t, return_index=True)
                own = np.zeros(len(t), bool)
                own[first] = True
                at = w.at[own[w.text_of[w.at]]]
                text = w.text_of[at]
                h = w.grams[at]
                order = np.argsort(h, kind="stable")
                at, text, h = at[order], text[order], h[order]
                new = np.concatenate(([True], h[1:] != h[:-1]))
                run_of = np.cumsum(new) - 1
                size = np.diff(np.append(np.flatnonzero(new), len(h)))[run_of]
                pos = at - w.offsets[text]
                key = np.where(new, h.view(np.int64), _scatter(t[text], pos))
                yield from_columns(key=key, t=t[text], place=(np.where(new, size, 0) << 32) + 2 * pos + (size > 1))

    return run


def _suffixes(n: int) -> Callable:
    """Per anchor to be looked at: key, doc_id, t, s0 (its first window), mask (bit i: window s0 + i), off (anchor - s0) and the words
    around it; and, with off -1 and packed pairs of s0 and mask as the context, windows of a text that are marked already."""
    side = n - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Windows(*word_hashes(part.column("text")), n)
                doc_id, t = _ids(part)
                places = part.column("places")
                where = places.offsets.to_numpy().astype(np.int64)
                values = places.values.to_numpy()[where[0] : where[-1]]
                # absolute positions of the anchors to look at
                wanted = values + np.repeat(w.offsets[:-1], np.diff(where))
                take = np.isin(w.at, wanted)
                at, start, count = w.at[take], w.start[take], w.count[take]
                if not len(at):
                    continue
                row = np.repeat(np.arange(len(at)), count)
                bit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                starts = start[row] + bit
                text = w.text_of[at]
                local = starts - w.offsets[text[row]]
                name = w.names(starts)
                order = np.lexsort((local, doc_id[text[row]], name))
                new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
                lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
                later = np.zeros(len(row), bool)
                later[order] = (doc_id[text[row[order]]] != doc_id[text[row[lead]]]) | (local[order] != local[lead])
                # equal places stay, with the earliest; all else of a name is marked here
                mask = np.zeros(len(at), np.int64)
                marked = np.zeros(len(at), np.int64)
                np.bitwise_or.at(mask, row[~later], np.int64(1) << bit[~later])
                np.bitwise_or.at(marked, row[later], np.int64(1) << bit[later])
                off = at - start
                s0 = start - w.offsets[text]
                sent = np.flatnonzero(mask)
                around = at[sent, None] + np.concatenate((np.arange(-side, 0), np.arange(K, K + side)))[None, :]
                context = w.words[np.clip(around, 0, len(w.words) - 1)] & WORD_BITS
                low, high = _lowest(mask[sent]), _highest(mask[sent])
                # words that no window of the row holds are left out
                context[(around < (start[sent] + low)[:, None]) | (around >= (start[sent] + high + n)[:, None])] = 0
                packed = np.ascontiguousarray(context.view(np.uint8).reshape(len(sent), 2 * side, 8)[:, :, :5])
                width = 2 * side * 5
                binary = pa.Array.from_buffers(pa.binary(), len(sent), [None, pa.py_buffer(np.arange(len(sent) + 1, dtype=np.int32) * width), pa.py_buffer(packed)])
                yield _rows(w.grams[at[sent]].view(np.int64), doc_id[text[sent]], t[text[sent]], s0[sent], mask[sent], off[sent], binary)
                done = np.flatnonzero(marked)
                if len(done):
                    ids, ts, pairs = _packed(doc_id[text[done]], t[text[done]], s0[done], marked[done])
                    none = np.zeros(len(ids), np.int64)
                    yield _rows(_scatter(ts), ids, ts, none, none, none - 1, pairs)

    return run


def _packed(doc_id: np.ndarray, t: np.ndarray, s0: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One row a text: its pairs of s0 and mask as 32-bit numbers."""
    order = np.lexsort((t, doc_id))
    doc_id, t = doc_id[order], t[order]
    first = np.flatnonzero(np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (t[1:] != t[:-1]))))
    data = np.stack((s0[order], mask[order]), axis=1).astype("<i4")
    ends = (np.append(first, len(order)) * 8).astype(np.int32)
    return doc_id[first], t[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _rows(key, doc_id, t, s0, mask, off, context) -> pa.RecordBatch:
    return from_columns(key=key, doc_id=doc_id, t=t, s0=pa.array(s0, pa.int32()), mask=pa.array(mask, pa.int32()), off=pa.array(off, pa.int32()), context=context)


def _lowest(mask: np.ndarray) -> np.ndarray:
    return np.log2((mask & -mask).astype(np.float64)).astype(np.int64)


def _highest(mask: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(mask.astype(np.float64))).astype(np.int64)


def subtree_marks(key: np.ndarray, doc_id: np.ndarray, s0: np.ndarray, mask: np.ndarray, off: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
    """Per row the bits of its windows that stand at a node of depth ``n`` but not at its earliest place."""
    side = n - K
    marks = np.zeros(len(key), np.int64)
    for before in range(side + 1):  # words of the prefix before the anchor
        bit = off - before
        has = np.flatnonzero((bit >= 0) & (bit < 63) & ((mask >> np.clip(bit, 0, 62)) & 1 == 1))
        if len(has) < 2:
            continue
        _, group, size = np.unique(key[has], return_inverse=True, return_counts=True)
        has = has[size[group] > 1]
        if len(has) < 2:
            continue
        words = context[has][:, side - before : 2 * side - before]
        start = s0[has] + bit[has]
        order = np.lexsort((start, doc_id[has], *words.T[::-1], key[has]))
        words, k = words[order], key[has][order]
        # words that each suffix shares with the one before it, beyond the anchor
        agree = np.cumprod(words[1:] == words[:-1], axis=1).sum(axis=1) if side else np.zeros(len(has) - 1, np.int64)
        deep = (k[1:] == k[:-1]) & (K + agree >= n)
        new = np.concatenate(([True], ~deep))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        d, s = doc_id[has][order], start[order]
        later = (d != d[first]) | (s != s[first])
        at = has[order][later]
        marks[at] |= np.int64(1) << bit[at]
    return marks


def _trees(n: int, piece: int) -> Callable:
    """Marks of groups that come in order of (key, doc_id, s0)."""
    side = n - K
    names = ("key", "doc_id", "t", "s0", "mask", "off")

    def unpack(batch: pa.RecordBatch) -> np.ndarray:
        data = np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint8).reshape(batch.num_rows, 2 * side, 5)
        out = np.zeros((batch.num_rows, 2 * side, 8), np.uint8)
        out[:, :, :5] = data
        return out.reshape(batch.num_rows, -1).view(np.uint64)

    def result(rows: dict, marks: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(marks)
        if not len(at):
            return from_columns(doc_id=pa.array([], pa.int64()), t=pa.array([], pa.int64()), pairs=pa.array([], pa.binary()))
        ids, ts, pairs = _packed(rows["doc_id"][at], rows["t"][at], rows["s0"][at], marks[at])
        return from_columns(doc_id=ids, t=ts, pairs=pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def finish(rows: dict) -> tuple[dict, np.ndarray]:
            marks = subtree_marks(*[rows[c] for c in ("key", "doc_id", "s0", "mask", "off", "context")], n)
            return rows, marks

        for batch in batches:
            known = batch.column("off").to_numpy() < 0
            if known.any():
                done = batch.filter(pa.array(known))
                yield from_columns(doc_id=done.column("doc_id"), t=done.column("t"), pairs=done.column("context"))
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy().astype(np.int64) for c in names} | {"context": unpack(batch)}
            held = now if held is None else {c: np.concatenate((held[c], now[c])) for c in now}
            if len(held["key"]) < piece:
                continue
            cut_at = int(np.searchsorted(held["key"], held["key"][-1]))  # the last group may go on
            if cut_at:
                rows, marks = finish({c: v[:cut_at] for c, v in held.items()})
                yield result(rows, marks)
                held = {c: v[cut_at:] for c, v in held.items()}
            if len(held["key"]) >= piece:
                # one group alone: of what it has so far, only the first places matter to the rest
                rows, marks = finish(held)
                yield result(rows, marks)
                left = rows["mask"] & ~marks
                held = {c: v[left != 0] for c, v in (rows | {"mask": left}).items()}
        if held is not None and len(held["key"]):
            yield result(*finish(held))

    return run


def _kept(n: int, text: str, own: list[str], added: tuple[str, ...]) -> Callable:
    """Rows with the kept words as the text, their number before and the number removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, copy, key_text, words, removed = added
        for batch in batches:
            for part in slices(batch, text):
                flat, offsets = word_lists(part.column(text))
                size = np.diff(offsets)
                edge = np.zeros(len(flat) + 1, np.int64)
                marks = part.column(spans)
                where = marks.offsets.to_numpy().astype(np.int64)
                values = marks.values.slice(where[0], where[-1] - where[0])
                if len(values):
                    many = pc.binary_length(values).to_numpy() // 8
                    pairs = np.frombuffer(b"".join(values.to_pylist()), "<i4").reshape(-1, 2).astype(np.int64)
                    s0, mask = pairs[:, 0] + np.repeat(np.repeat(offsets[:-1], np.diff(where)), many), pairs[:, 1]
                    for bit in range(n - K + 1):
                        starts = s0[(mask >> bit) & 1 == 1] + bit
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + n, -1)
                gone = np.cumsum(edge[:-1]) > 0
                whole = part.column(copy).to_numpy(zero_copy_only=False) & (size >= n)
                gone |= np.repeat(whole, size)
                left = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(~gone)))
                yield from_columns(**{c: part.column(c) for c in own if c != text}, **{key_text: pc.binary_join(lists, " "), words: pa.array(size, pa.int64()), removed: pa.array(size - np.diff(left), pa.int64())})

    return run


def _lengthened(suffixes: DataFrame, heavy: DataFrame, n: int) -> DataFrame:
    """Suffixes of the heavy anchors by themselves, each under a key of its whole window."""
    side = n - K
    both = suffixes.join(heavy.select(F.col("key").alias("key2")), (F.col("key") == F.col("key2")) & (F.col("off") >= 0), "left")
    own = F.expr(f"""
        CASE WHEN key2 IS NULL THEN array(named_struct('key', key, 'mask', mask))
        ELSE transform(filter(sequence(0, {side}), b -> getbit(mask, b) = 1), b -> named_struct(
            'key', xxhash64(key, off - b, substring(context, ({side} - off + b) * 5 + 1, {side} * 5)), 'mask', shiftleft(1, b))) END""")
    return both.select("doc_id", "t", "s0", "off", "context", F.explode(own).alias("own")).select("own.key", "doc_id", "t", "s0", "own.mask", "off", "context")


def grouped_suffixes(rows: DataFrame, first: DataFrame, n: int, piece: int) -> DataFrame:
    """The suffixes that may repeat, of ``rows`` (doc_id, t, text), by the key of their group; ``first``: the smallest doc_id of each text."""
    anchors = rows.select("t", "text").mapInArrow(tidy(_anchors(n)), "key long, t long, place long")
    alike = Window.partitionBy("key")
    known = F.col("place") % 2 == 1
    several = (F.min("t").over(alike) < F.max("t").over(alike)) | F.max(known).over(alike)
    total = F.sum(F.shiftright("place", 32)).over(alike)
    seen = anchors.withColumn("again", known | several).withColumn("heavy", F.when(total > piece, F.col("key"))).where("again")
    position = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    places = sized(seen.groupBy("t").agg(F.collect_set(position).alias("places"), F.collect_set("heavy").alias("heavy")))
    heavy = sized(places.select(F.explode("heavy").alias("key")).distinct())
    where = places.join(first, F.col("t") == F.col("t2")).select(F.col("first").alias("id2"), "t2", "places")
    met = rows.join(where.hint("shuffle_hash"), (F.col("doc_id") == F.col("id2")) & (F.col("t") == F.col("t2"))).select("doc_id", "t", "text", "places")
    suffixes = met.mapInArrow(tidy(_suffixes(n)), "key long, doc_id long, t long, s0 int, mask int, off int, context binary")
    # without a heavy anchor there is nothing to lengthen
    return suffixes if heavy.isEmpty() else _lengthened(suffixes, heavy, n)


def remove_repeats(docs: DataFrame, n: int = 20, doc_id: str = "doc_id", text: str = "text", words: str = "n_words", removed: str = "n_removed", piece: int = PIECE) -> DataFrame:
    """``docs`` with the kept words, joined by a space, as the text, and two more columns: words before, and removed ones.
    ``piece``: suffixes that a task sorts at once, and the most that an anchor's group has."""
    if not K <= n < K + 31:
        raise ValueError(f"windows have {K} to {K + 30} words")
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    rows = docs.select(order.alias("doc_id"), text_key(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = rows.groupBy("t").agg(F.min("doc_id").alias("first")).withColumnRenamed("t", "t2")
    copies = cut(rows.select("doc_id", "t").distinct().join(first, (F.col("t") == F.col("t2")) & (F.col("doc_id") > F.col("first")), "left_semi"))
    suffixes = grouped_suffixes(rows, first, n, piece)
    marks = suffixes.repartition("key").sortWithinPartitions("key", "doc_id", "s0").mapInArrow(tidy(_trees(n, piece)), "doc_id long, t long, pairs binary")
    spans = marks.groupBy("doc_id", "t").agg(F.collect_list("pairs").alias("spans"))
    spans = spans.join(copies.select(F.col("doc_id").alias("id3"), F.col("t").alias("t3"), F.lit(True).alias("copy")), (F.col("doc_id") == F.col("id3")) & (F.col("t") == F.col("t3")), "full")
    spans = cut(spans.select(F.coalesce("doc_id", "id3").alias("doc_id"), F.coalesce("t", "t3").alias("t"), "spans", F.coalesce("copy", F.lit(False)).alias("copy")))

    id_, t, sp, cp = fresh(docs, "dedup_id", "dedup_t", "dedup_spans", "dedup_copy")
    found = spans.select(F.col("doc_id").alias(f"{id_}2"), F.col("t").alias(f"{t}2"), F.col("spans").alias(sp), F.col("copy").alias(cp))
    both = docs.withColumn(id_, order).withColumn(t, text_key(F.col(text))).join(found.hint("shuffle_hash"), (F.col(id_) == F.col(f"{id_}2")) & (F.col(t) == F.col(f"{t}2")), "left")
    both = both.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(sp, F.array().cast("array<binary>")).alias(sp), F.coalesce(cp, F.lit(False)).alias(cp))
    kept = fresh(both, "dedup_text")[0]
    others = [c for c in docs.columns if c != text]
    schema = schema_with(docs, others, **{kept: "string", words: "bigint", removed: "bigint"})
    out = both.mapInArrow(tidy(_kept(n, text, docs.columns, (sp, cp, kept, words, removed))), schema)
    return out.select(*[F.col(kept).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], words, removed)
