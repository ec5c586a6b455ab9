"""Near duplicates by 64-bit fingerprints, with tables of distances to pivots.

A document's fingerprint is the majority, bit by bit, of the hashes of its word shingles.  Equal fingerprints are
taken together first, so that copies cost a row.  Fingerprints that differ in at most three bits agree in one of four
blocks of 16 bits, and, of the other 48 bits, in one of four blocks of 12; they meet under a key of these 28 bits.
Under each key the distances of all fingerprints to the pivots (reference fingerprints) are worked out once: by the
triangle inequality two fingerprints differ in at least as many bits as their distances to any pivot differ, so pairs
whose largest difference is above the limit are discarded from the table alone, and only the survivors are
compared.  A key with many different fingerprints is dealt out in chunks, and every two chunks meet in a task.

Cases: null and empty texts, and those without words, have the fingerprint 0 and link like any other; a text of fewer
words than a shingle is one shingle; repeated rows link with each other; rows without a doc_id take part, and the
component of documents that all lack one is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut, from_columns, mix64, slices, tidy, word_lists
from seqframe.llm.components import connected_components

#: Fingerprints that differ in more bits need not agree in any block.
MOST_BITS = 3


def shingle_hashes(texts: pa.Array, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts (words joined by one space), and how many each text has."""
    import xxhash

    words, offsets = word_lists(texts, lower=True)
    many = np.diff(offsets)
    count = np.where(many >= n, many - n + 1, np.minimum(many, 1))
    if not len(words):
        return np.zeros(0, np.uint64), count
    joined = memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_buffer())
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    end = np.cumsum(size + 1) - 1
    ends = np.cumsum(count)
    first = np.repeat(offsets[:-1] - (ends - count), count) + np.arange(ends[-1])
    last = first + np.repeat(np.minimum(many, n), count) - 1
    digest = xxhash.xxh64_intdigest
    places = zip((end[first] - size[first]).tolist(), end[last].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in places), np.uint64, len(first)), count


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text the bits that more than half of its hashes have; 0 without any."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    starts = (np.cumsum(count) - count)[full]
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), starts, dtype=np.int64)
        out[full] |= (2 * ones > count[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id and fp, the fingerprint of its whole text as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield from_columns(doc_id=part.column("doc_id"), fp=majority(*shingle_hashes(part.column("text"), n, seed)).view(np.int64))

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, fp long")


def agreement_keys(fp: Column) -> list[Column]:
    """Sixteen numbers; fingerprints that differ in at most three bits share one of them."""
    keys = []
    for i in range(4):
        turned = fp if i == 0 else F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i))
        block = F.shiftleft(F.shiftrightunsigned(turned, 48), 12)
        keys += [block.bitwiseOR(F.shiftrightunsigned(turned, 12 * j).bitwiseAND(F.lit(0xFFF))) + F.lit((4 * i + j) << 28) for j in range(4)]
    return keys


def pivots(many: int) -> np.ndarray:
    """Reference fingerprints: numbers whose bits are spread evenly."""
    return mix64(np.arange(1, many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distances of all fingerprints to all pivots."""
    return np.bitwise_count(fps[:, None] ^ references[None, :])


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of rows the table does not discard: no coordinate differs by more than ``bits``."""
    alive = np.arange(len(a))
    for start in range(0, table.shape[1], 8):  # few pairs outlive the first pivots
        left, right = table[a[alive], start : start + 8], table[b[alive], start : start + 8]
        alive = alive[(np.maximum(left, right) - np.minimum(left, right) <= bits).all(axis=1)]
    return alive


def tie(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component among 0 to n - 1, by links between ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_short_groups(fps: np.ndarray, owner: np.ndarray, longest: int, references: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many short groups that stand one after another: each row with the next one, the one after that, and so on."""
    table = pivot_table(fps, references)
    found = []
    for step in range(1, longest):
        a = np.flatnonzero(owner[step:] == owner[:-step])
        if not len(a):
            break
        a = a[survivors(table, a, a + step, bits)]
        found.append(a[np.bitwise_count(fps[a] ^ fps[a + step]) <= bits])
        found.append(found[-1] + step)
    return np.concatenate([np.zeros(0, np.int64), *found[::2]]), np.concatenate([np.zeros(0, np.int64), *found[1::2]])


def _in_long_group(fps: np.ndarray, references: np.ndarray, bits: int, pairs_at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie the components of a long group, its rows in order of the distance to the first pivot, so that a row's partners
    stand in a window of that order."""
    table = pivot_table(fps, references)
    order = np.argsort(table[:, 0], kind="stable")
    table, fps = table[order], fps[order]
    end = np.searchsorted(table[:, 0], table[:, 0].astype(np.int64) + bits, side="right")
    label, start = np.arange(len(fps)), 0
    while start < len(fps):
        stop = start + 1
        while stop < len(fps) and (stop + 1 - start) * (end[stop] - start) <= pairs_at_once:
            stop += 1
        many = end[start:stop] - np.arange(start, stop) - 1
        a = np.repeat(np.arange(start, stop), many)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        alive = survivors(table, a, b, bits)
        a, b = a[alive], b[alive]
        linked = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        if linked.any():
            tied = np.flatnonzero(label != np.arange(len(label)))
            label = tie(len(label), np.concatenate((tied, a[linked])), np.concatenate((label[tied], b[linked])))
        start = stop
    tied = np.flatnonzero(label != np.arange(len(label)))
    return order[tied], order[label[tied]]


def _links(bits: int, many: int, short: int = 32) -> Callable:
    """Edges that tie the components of each group; groups stand one after another, a task's last one is kept until its next batch."""
    def found(key: np.ndarray, fps: np.ndarray, references: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        size = np.diff(np.append(begins, len(fps)))
        owner = np.repeat(np.arange(len(size)), size)
        few = size[owner] <= short
        at = np.flatnonzero(few)
        a, b = _in_short_groups(fps[at], owner[at], short, references, bits)
        ends = [(fps[at[a]], fps[at[b]])]
        for group in np.flatnonzero(size > short):
            mine = fps[begins[group] : begins[group] + size[group]]
            a, b = _in_long_group(mine, references, bits)
            ends.append((mine[a], mine[b]))
        a, b = (np.concatenate(side).view(np.int64) for side in zip(*ends, strict=True))
        return from_columns(a=np.minimum(a, b), b=np.maximum(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots(many)
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1))
            values.append(batch.column("fp").to_numpy().view(np.uint64))
            if (keys[0][0] == keys[-1][-1]).all():
                continue  # one group so far
            key, value = np.concatenate(keys), np.concatenate(values)
            done = len(key) - int(np.argmax((key[::-1] != key[-1]).any(axis=1)))
            yield found(key[:done], value[:done], references)
            keys, values = [key[done:]], [value[done:]]
        if keys:
            yield found(np.concatenate(keys), np.concatenate(values), references)

    return run


def fingerprint_links(fps: DataFrame, bits: int = MOST_BITS, many: int = 32, chunk: int = 4096) -> DataFrame:
    """From different fingerprints (fp) edges (a, b) that tie all those linked by at most ``bits`` differing bits, over any number of links."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"bits is 0 to {MOST_BITS}, not {bits}")
    rows = fps.select("fp", F.explode(F.array(*agreement_keys(F.col("fp")))).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("key2"), F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    rows = rows.join(shared, F.col("key") == F.col("key2"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.select("key", "fp", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("y"))
    rows = rows.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "fp")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(_links(bits, many)), "a long, b long")


def simhash_components(docs: DataFrame, n: int = 3, bits: int = MOST_BITS, seed: int = 42, many: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, fp, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, its own included.
    ``many``: pivots."""
    each = cut(fingerprints(docs, n, seed, doc_id, text))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = cut(connected_components(fingerprint_links(fps.select("fp"), bits, many)))
    joined = tied.join(fps, F.col("node") == F.col("fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c2")
    linked = tied.join(least, F.col("component") == F.col("c2")).select("node", "component_id")
    of = cut(fps.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp2"), F.coalesce("component_id", "least").alias("component_id")))
    # a fingerprint of very many copies is split by Spark's skew join, as both sides are shuffled for it alone
    return each.join(of, F.col("fp") == F.col("fp2")).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
