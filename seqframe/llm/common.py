"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqframe.session import ensure_checkpoint_dir

#: Fixed value of the contracts: what separates words.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def schema_with(df: DataFrame, columns: list[str], **added: str) -> T.StructType:
    """The schema of some columns of ``df`` and of added ones, whose types are given as DDL."""
    of = {f.name: f for f in df.schema.fields}
    return T.StructType([*[of[c] for c in columns], *[T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in added.items()]])


def words_of(text: Column | str) -> Column:
    """The words of a text as an array, by built-in functions; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def text_key(text: Column) -> Column:
    """With doc_id, tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that a slice holds about ``max_bytes`` of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back when a task ends; workers live on, and so would their peaks."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_lists(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and per text the position of its first one (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        offsets, flat = before[offsets], flat.filter(pa.array(full))
    return flat, offsets


def hashes(values: Iterable[bytes | str], seed: int = 0) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values), dtype=np.uint64)


def word_hashes(texts: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the offsets of the texts."""
    flat, offsets = word_lists(texts, lower)
    if not len(flat):
        return np.zeros(0, np.uint64), offsets
    coded = flat.dictionary_encode()
    return hashes(coded.dictionary.to_pylist(), seed)[coded.indices.to_numpy()], offsets


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row; there are n - 1 fewer than words."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mix64(words[:size] + np.uint64(n))
        for j in range(1, n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + size])
    return out


def from_columns(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})
