"""Alignment of two tokenizers' tokens of the same texts, by the byte offsets where both have a token end.

Both tokenise the whole text.  Where a token of each ends and the next ones of both are marked by a space, the shared
end is an anchor (verified: the byte offsets are equal), and anchors cut a document into windows of token ids.  The
alignment within a window depends on its ids alone, so it is worked out once for each different tuple of ids that a
shard holds; a document's alignment is that of its windows in a row.

A shard (a slice of a task's texts) writes the alignments of its documents, as numbers of its different pairs of
linked ids, and once the pairs themselves.  The pairs of all shards are summed up, and each shard gets the counts of
its own pairs back: no pair has more rows than there are shards, however frequent it is.

Cases: texts that are null, empty, or that a tokenizer does not spell byte by byte (the sign U+2581 in a text) have no
tokens and zeros in all columns; strings of special tokens are plain text; repeated rows are aligned and counted alike;
a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import from_columns, mix64, shared_path, slices, tidy
from seqframe.llm.token_files import Encoder, kept_by_worker

SPACE_PIECE = "▁"


def byte_alphabet() -> dict[str, int]:
    """Fixed by byte-level vocabularies: printable Latin-1 characters stand for their own bytes, the others are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteTokens(Encoder):
    """A byte-level vocabulary, with the bytes of each token."""

    def __init__(self, path: str):
        super().__init__(path, memory=2_000_000, plain=True)
        alphabet, vocabulary = byte_alphabet(), self.tokenizer.get_vocab()
        spelt = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            spelt[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.spelt, self.marked = pa.array(spelt, pa.binary()), self.begins_with_space


class PieceTokens(Encoder):
    """A piece model without normalisation; it puts a space before a text, and no piece holds a space behind another character."""

    #: A word and the space before it are encoded like a text; leading, trailing and double spaces are left to the model.
    joined = "^ | $|  "

    def __init__(self, path: str, memory: int = 2_000_000):
        import sentencepiece

        self.model, self.memory, self.special = sentencepiece.SentencePieceProcessor(model_file=path), memory, None
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces):
            raise ValueError("the model has pieces that go on over a space")
        spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)]
        self.spelt, self.marked = pa.array(spelt, pa.binary()), np.array([p.startswith(SPACE_PIECE) for p in pieces])
        self._forget()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self._encode([p[1:] if p[:1] == " " else p for p in pieces])
        return np.concatenate(ids), np.arange(len(ids)), np.fromiter(map(len, ids), np.int64, len(ids))


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of some spans, one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Aligns many texts at once."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.sizes = [pc.binary_length(t.spelt).to_numpy().astype(np.int64) for t in (self.a, self.b)]
        # decimal ids and what follows them: within a group, and at its end
        self.numbers = pa.array([f"{i}{end}" for size, ends in zip(self.sizes, (",|", ",;"), strict=True) for end in ends for i in range(len(size))], pa.large_binary())

    def _tokens(self, texts: pa.Array) -> tuple[list, list, np.ndarray]:
        """For A and B the ids of all texts and their offsets by text; no ids for texts that either does not spell."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        whole = spaced.cast(pa.large_binary())
        said = pc.binary_length(whole).to_numpy().astype(np.int64)
        true = np.concatenate(([0], np.cumsum(said)))
        data = memoryview(b"".join(whole.to_pylist()))
        good = said > 1
        ids, offsets = [], []
        for tokenizer, given in ((self.a, spaced), (self.b, texts)):
            flat, at = tokenizer.encode(given)
            joined = tokenizer.spelt.cast(pa.large_binary()).take(pa.array(flat))
            ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1][at] if len(joined) else np.zeros(len(at), np.int64)
            spelt = memoryview(joined.buffers()[2] or b"")
            good &= np.fromiter((bytes(spelt[s:e]) == bytes(data[x:y]) for s, e, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), true[:-1].tolist(), true[1:].tolist(), strict=True)), bool, len(said))
            ids.append(flat)
            offsets.append(at)
        for k in (0, 1):
            size = np.where(good, np.diff(offsets[k]), 0)
            ids[k] = ids[k][spans(offsets[k][:-1], size)]
            offsets[k] = np.concatenate(([0], np.cumsum(size)))
        return ids, offsets, np.where(good, said, 0)

    def align(self, texts: pa.Array) -> dict:
        """Per text the sizes, the groups' digest and the numbers of linked pairs; and the different pairs, with how often they stand."""
        (a, b), (of_a, of_b), said = self._tokens(texts)
        ends_a, ends_b = (np.cumsum(size[x]) for size, x in zip(self.sizes, (a, b), strict=True))
        # texts stand one after another and both spell them, so that ends of A and B are places in the same bytes
        mark = np.zeros(int(said.sum()) + 1, np.int8)
        mark[ends_a] += 1
        mark[ends_b] += 2
        shared_a, shared_b = mark[ends_a] == 3, mark[ends_b] == 3
        at_a, at_b = np.flatnonzero(shared_a), np.flatnonzero(shared_b)
        text_ends = np.zeros(len(a) + 1, bool)
        text_ends[of_a] = True
        marked_a, marked_b = np.append(self.a.marked[a], False), np.append(self.b.marked[b], False)
        anchor = text_ends[at_a + 1] | (marked_a[at_a + 1] & marked_b[at_b + 1])
        end_a, end_b = at_a[anchor] + 1, at_b[anchor] + 1
        size_a, size_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)

        number, first = self._windows(a, b, end_a, end_b, size_a, size_b)
        in_a, in_b = spans((end_a - size_a)[first], size_a[first]), spans((end_b - size_b)[first], size_b[first])
        fragments, links, many = self._groups(a[in_a], b[in_b], shared_a[in_a], shared_b[in_b], size_a[first], size_b[first])
        fragments = fragments.take(pa.array(number))
        pairs, pair = np.unique(links, return_inverse=True)
        links = pair.astype(np.int32)[spans((np.cumsum(many) - many)[number], many[number])]

        windows = np.searchsorted(end_a, of_a, side="right")  # of the texts before each
        windows[0] = 0
        linked = np.concatenate(([0], np.cumsum(many[number])))[windows]
        spelt = np.frombuffer(fragments.buffers()[1], np.int64)[: len(number) + 1][windows] if len(number) else np.zeros(len(windows), np.int64)
        held = memoryview(fragments.buffers()[2] or b"")
        digest = [hashlib.sha256(held[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(spelt[:-1].tolist(), spelt[1:].tolist(), strict=True)]
        return {"n_a": np.diff(of_a), "n_b": np.diff(of_b), "n_groups": np.diff(linked), "groups_sha256": digest, "links": links, "offsets": linked,
                "pairs": pairs, "n": np.bincount(links, minlength=len(pairs))}

    def _windows(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each window's ids among the different ones, and where those stand first."""
        if not len(end_a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.zeros(len(end_a), np.uint64)
        with np.errstate(over="ignore"):
            for ids, end, size, salt in ((a, end_a, size_a, 1), (b, end_b, size_b, 2)):
                place = np.arange(len(ids)) - np.repeat(end - size, size)
                key = mix64(key + np.uint64(salt) + np.add.reduceat(mix64(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), end - size))
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        # equal keys stand for equal ids only if the ids say so
        like = first[number]
        other = (size_a != size_a[like]) | (size_b != size_b[like])
        for ids, end, size in ((a, end_a, size_a), (b, end_b, size_b)):
            same = np.where(other, 0, size)
            differ = ids[spans(end - size, same)] != ids[spans((end - size)[like], same)]
            other[np.repeat(np.arange(len(end)), same)[differ]] = True
        alone = np.flatnonzero(other)
        number[alone] = len(first) + np.arange(len(alone))
        return number, np.concatenate((first, alone))

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Of windows in a row, whose tokens end a group or don't: their groups spelt out, their links (A id in the high half), and how
        many links each has."""
        if not len(a):
            return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        group_ends = [np.concatenate(([0], np.flatnonzero(last) + 1)) for last in (last_a, last_b)]
        group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
        # the tokens of A in a group, then those of B
        code = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = map(len, self.sizes)
        code[np.arange(len(a)) + group_ends[1][group_a]] = a + n_a * last_a
        code[np.arange(len(b)) + group_ends[0][group_b + 1]] = 2 * n_a + b + n_b * last_b
        spelt = self.numbers.take(pa.array(code))
        ends = np.concatenate(([0], np.cumsum(size_a + size_b)))
        offsets = np.frombuffer(spelt.buffers()[1], np.int64)[: len(code) + 1][ends]
        fragments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), spelt.buffers()[2]])
        many = np.add.reduceat(last_a.astype(np.int64), np.cumsum(size_a) - size_a)
        return fragments, (a[last_a].astype(np.int64) << 32) | b[last_b], many


def _aligned(path_a: str, path_b: str, max_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_by_worker(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", max_bytes):
                found, n = aligner.align(part.column("text")), part.num_rows
                lists = {c: pa.nulls(n, pa.list_(pa.int64() if c == "pair_n" else pa.int32())) for c in ("pair_a", "pair_b", "pair_n")}
                yield from_columns(shard=np.full(n, shard), doc_id=part.column("doc_id"), **{c: found[c] for c in ("n_a", "n_b", "n_groups")}, groups_sha256=pa.array(found["groups_sha256"], pa.string()),
                                   links=pa.ListArray.from_arrays(pa.array(found["offsets"], pa.int32()), pa.array(found["links"])), **lists)
                ends = pa.array([0, len(found["pairs"])], pa.int32())
                lists = {"pair_a": (found["pairs"] >> 32).astype(np.int32), "pair_b": (found["pairs"] & 0xFFFFFFFF).astype(np.int32), "pair_n": found["n"].astype(np.int64)}
                yield from_columns(shard=np.full(1, shard), **{c: pa.nulls(1, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")}, groups_sha256=pa.nulls(1, pa.string()), links=pa.nulls(1, pa.list_(pa.int32())),
                                   **{c: pa.ListArray.from_arrays(ends, pa.array(x)) for c, x in lists.items()})
                shard += 1

    return run


ALIGNED = "shard long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, pair_a array<int>, pair_b array<int>, pair_n array<long>"


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of a shard's documents, from the counts of its pairs."""
    number = pairs.column("i").to_numpy()
    count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number], best[number] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
    links = docs.column("links").combine_chunks()
    size = pc.list_value_length(links).to_numpy().astype(np.int64)
    flat = links.flatten().to_numpy()
    ends = np.cumsum(size)
    sums = [np.concatenate(([0], np.cumsum(x[flat]))) for x in (count, best)]
    sums = [s[ends] - s[ends - size] for s in sums]
    return pa.table({c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")} | {"n_links": size, "n_best": sums[1], "count_sum": sums[0], "groups_sha256": docs.column("groups_sha256")})


def align_tokens(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", shard_mb: int = 2) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return score_links(docs.sparkSession, write_alignment(docs, path_a, path_b, doc_id, text, shard_mb))


def write_alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", shard_mb: int = 2) -> str:
    """Write the shards' documents and pairs, and return the path."""
    path = shared_path(docs.sparkSession, "alignment")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows.mapInArrow(tidy(_aligned(path_a, path_b, shard_mb << 20)), ALIGNED).write.parquet(path)
    return path


def pair_counts(spark, path: str) -> DataFrame:
    """Linked pairs of ids (a, b) of all shards: count, and best, whether no other A id is linked more often to the B id."""
    rows = spark.read.schema(ALIGNED).parquet(path).where("pair_a is not null").select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = rows.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_n").alias("count"))
    most = counts.groupBy(F.col("b").alias("b2")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("b") == F.col("b2")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(spark, path: str) -> DataFrame:
    rows = spark.read.schema(ALIGNED).parquet(path)
    counts = pair_counts(spark, path)
    own = rows.where("pair_a is not null").select(F.col("shard").alias("of_shard"), F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("i", "p"))
    own = own.join(counts, (F.col("p.pair_a") == F.col("a")) & (F.col("p.pair_b") == F.col("b"))).select("of_shard", "i", "count", "best")
    aligned = rows.where("pair_a is null").select("shard", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return aligned.groupBy("shard").cogroup(own.groupBy("of_shard")).applyInArrow(
        _scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
