"""Token ids of documents in Parquet files that allow selective reads.

A file holds one row per document in ascending doc_id order: ``shard``,
``doc_id``, ``n_tokens`` and ``ids`` (a list column, end id included).  The
ids are dictionary-encoded, or delta-encoded where ``encoding="delta"``; row
groups and pages have set sizes, and the writer adds page indexes, so that a
range of doc_ids or the metadata columns alone can be read.

Cases: a null text is an empty one and gives the end id alone; a null doc_id
comes first; rows with equal doc_id stand next to each other in the order of
a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqframe.llm.common import from_columns, hashes, slices, text_key, tidy

#: Where a text can't be cut before a space: white space on both sides of it, or another space.  RE2 knows ASCII white space only;
#: a text with any other is rare enough to go the slow way too.
_JOINED = r"\s \s|  |[\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _kept() -> dict:
    """What a Python worker keeps from one task to its next ones."""
    return sys.modules.setdefault("seqframe_kept", types.ModuleType("seqframe_kept")).__dict__


def kept_by_worker(name: str, make: Callable) -> object:
    """What ``make`` gives, made once by each Python worker."""
    kept = _kept()
    if name not in kept:
        kept[name] = make()
    return kept[name]


class Encoder:
    """Encodes whole texts, each distinct piece between spaces once.

    The pre-tokenizer of a byte-level vocabulary takes a space into the word after it, so a text may be cut before
    each single space that stands between other characters than white space, and the pieces encoded alone give the
    ids of the whole.  Texts with a space beside white space are encoded whole.  New pieces are encoded many in a
    row: the first id of each is known by its space.  What pieces give is kept, by 64-bit hashes of the pieces, for
    the next batches, up to ``memory`` ids.  Strings of special tokens in a text are ordinary text if ``plain``;
    otherwise the library's own reading holds, and texts that have one are encoded whole.
    """

    joined = _JOINED

    def __init__(self, path: str, memory: int = 6_000_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.begins_with_space = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins_with_space[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        return kept_by_worker(path, lambda: cls(path))

    def _forget(self) -> None:
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, in some order, with the numbers and the sizes of the pieces in that order."""
        # pieces that begin with a space beside no other white space can stand in a row
        joined = [i for i, p in enumerate(pieces) if p[:1] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace()]
        groups = [joined[i : i + 200] for i in range(0, len(joined), 200)]
        ids, numbers, sizes = [], [], []
        alone = np.ones(len(pieces), bool)
        for group, x in zip(groups, self._encode(["".join([pieces[i] for i in g]) for g in groups]), strict=True):
            starts = np.flatnonzero(self.begins_with_space[x])
            if len(starts) == len(group) and starts[0] == 0:
                ids.append(x)
                numbers.append(np.array(group))
                sizes.append(np.diff(np.append(starts, len(x))))
                alone[numbers[-1]] = False
        rest = np.flatnonzero(alone)
        single = self._encode([pieces[i] for i in rest])
        return np.concatenate([*ids, *single]), np.concatenate([*numbers, rest]), np.concatenate([*sizes, np.fromiter(map(len, single), np.int64, len(single))])

    def _learn(self, words: list[str], firsts: list[str]) -> np.ndarray:
        """Numbers of the words after a space, and of those that begin a text."""
        if len(self.ids) > self.memory:
            self._forget()
        pieces = [" " + w for w in words] + firsts
        keys = hashes(pieces)
        ascending = np.argsort(keys)  # far quicker to look up
        at = np.empty(len(keys), np.int64)
        at[ascending] = np.searchsorted(self.keys, keys[ascending])
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ids, numbers, size = self._encode_pieces([pieces[i] for i in new])
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate((self.ids, ids))
            keys_now = np.concatenate((self.keys, keys[new[numbers]]))
            order = np.argsort(keys_now, kind="stable")
            self.keys, self.begin, self.size = keys_now[order], np.concatenate((self.begin, begin))[order], np.concatenate((self.size, size))[order]
            at[ascending] = np.searchsorted(self.keys, keys[ascending])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the offsets of the texts in them."""
        whole = pc.match_substring_regex(texts, self.joined).to_numpy(zero_copy_only=False)
        if self.special is not None:
            whole |= pc.match_substring_regex(texts, self.special.pattern).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts)
        parts = pc.split_pattern(plain, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        code = coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(code), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        # a piece has the space before it, but for the first one of a text
        words = coded.dictionary.to_pylist()
        starts = np.unique(code[first])
        numbers = self._learn(words, [words[i] for i in starts])
        number = numbers[code]
        number[first] = numbers[len(words) + np.searchsorted(starts, code[first])]
        begin, size = self.begin[number], self.size[number]
        at = np.concatenate(([0], np.cumsum(size)))
        narrow = np.int32 if max(at[-1], len(self.ids)) < 1 << 31 else np.int64
        flat = self.ids[np.repeat((begin - at[:-1]).astype(narrow), size) + np.arange(at[-1], dtype=narrow)]
        per_text = at[offsets]
        rows = np.flatnonzero(whole)
        if len(rows):
            slow = dict(zip(rows.tolist(), self._encode(texts.take(pa.array(rows)).to_pylist()), strict=True))
            lists = [slow[i] if i in slow else flat[per_text[i] : per_text[i + 1]] for i in range(len(texts))]
            per_text = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            flat = np.concatenate(lists)
        return flat, per_text


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, t (a hash of the text), n_tokens, ids: those of the whole text, then ``end_id``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                flat, offsets = encoder.encode(part.column("text"))
                n = np.diff(offsets)
                ids = np.insert(flat, offsets[1:], end_id).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(n + 1))).astype(np.int32)
                yield from_columns(doc_id=part.column("doc_id"), t=part.column("t"), n_tokens=n + 1, ids=pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartitionByRange("doc_id", "t").mapInArrow(tidy(encode), "doc_id long, t long, n_tokens long, ids array<int>")


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 1000, page_kb: int = 256) -> None:
    """Write rows of ``encode_documents`` in ascending doc_id order, one shard a range."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0", "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
               "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10), "parquet.page.row.count.limit": str(page_rows)}
    (tokens.sortWithinPartitions("doc_id", "t").select(F.spark_partition_id().alias("shard"), "doc_id", "t", "n_tokens", "ids")
     .write.options(**options).parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, t, n_tokens; no page of ids is read."""
    return spark.read.schema("shard int, doc_id long, t long, n_tokens long").parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All rows, or those with doc_id from ``first`` to ``last``; row groups and pages of other ids are passed over."""
    rows = spark.read.schema("shard int, doc_id long, t long, n_tokens long, ids array<int>").parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            data = ids.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield from_columns(**{c: batch.column(c) for c in ("shard", "doc_id", "t")}, n_tokens=np.diff(offsets).astype(np.int64), ids_crc32=pa.array(sums, pa.int64()))

    rows = read_tokens(spark, path).mapInArrow(tidy(crc), "shard int, doc_id long, t long, n_tokens long, ids_crc32 long")
    # one row a shard
    offsets = read_metadata(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        F.col("shard").alias("shard2"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).join(offsets, F.col("shard") == F.col("shard2")).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
