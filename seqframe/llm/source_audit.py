"""How the sources of a language differ from each other and from the language, by their use of terms.

Each shard keeps, for a slice of an Arrow text buffer, pointers to where terms begin, and sorts the pointers by the
bytes they point at: eight bytes at a time, and only pointers whose terms are equal so far go on to the next eight
(multikey quicksort with a machine word as the character).  A run of equal terms then gives, in one pass, the
documents and the occurrences of the term for each (language, source) of the slice; Spark adds the slices up.

A term has the share p in a group, add-two smoothed and in whole billionths; f = (p - q)^2 / (p + q), rounded down,
is what it adds to the divergence of two groups.  All arithmetic is on whole numbers.

Cases: null text, language and source are empty ones; a group whose documents hold no term is a group all the same;
a language without kept terms has divergences of 0 and no terms; each row is a document, repeated rows too; ties go
to the smaller item by its bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqframe.llm.common import cut, from_columns, shared_path, slices, tidy

#: Fixed values of the contract: bytes of terms, the scale of shares and what is added to a count.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[ord("A") : ord("Z") + 1] = TERM_BYTES[ord("a") : ord("z") + 1] = TERM_BYTES[0x80:] = True
SCALE, ADDED = 1_000_000_000, 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Terms that agree so far are compared as byte strings beyond this depth.
DEEP = 32


def term_pointers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts; where in them terms begin, their sizes, and the numbers of their texts."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 3
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    inside = np.concatenate(([False], TERM_BYTES[data], [False]))
    text_begins = np.zeros(len(data) + 1, bool)
    text_begins[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | text_begins[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | text_begins[1:])) + 1
    return LOWER[data], starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def sort_pointers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their terms, and for each place in it whether a run of equal terms begins there."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))

    def key(pointers: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes at this depth; zeros, which no term holds, behind its end."""
        left = np.clip(sizes[pointers] - 8 * depth, 0, 8)
        at = np.minimum(starts[pointers] + 8 * depth, len(data))
        shift = (8 * (8 - np.maximum(left, 1))).astype(np.uint64)
        return np.where(left > 0, (eight[at].astype(np.uint64) >> shift) << shift, np.uint64(0))

    first = key(np.arange(len(starts)), 0)
    order = np.argsort(first)
    first = first[order]
    begins = np.ones(len(order), bool)
    begins[1:] = first[1:] != first[:-1]
    depth = 1
    while True:
        run = np.cumsum(begins) - 1
        again = np.flatnonzero((np.bincount(run)[run] > 1) & (sizes[order] >= 8 * depth)) if len(run) else run
        if not len(again):
            return order, begins
        if depth == DEEP:
            return _sort_deep(data, starts, sizes, order, begins, again, run)
        keys, runs = key(order[again], depth), run[again]
        by = np.lexsort((keys, runs))
        order[again] = order[again[by]]
        keys = keys[by]
        begins[again[1:]] |= (keys[1:] != keys[:-1]) & (runs[1:] == runs[:-1])
        if not keys.any():
            return order, begins
        depth += 1


def _sort_deep(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray, begins: np.ndarray, again: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of terms that share a very long prefix, each sorted by their bytes."""
    for places in np.split(again, np.flatnonzero(np.diff(run[again])) + 1):
        terms = sorted((data[s : s + n].tobytes(), p) for p, s, n in zip(order[places].tolist(), starts[order[places]].tolist(), sizes[order[places]].tolist(), strict=True))
        order[places] = [p for _, p in terms]
        begins[places[1:]] |= np.array([a[0] != b[0] for a, b in zip(terms, terms[1:], strict=False)], bool)
    return order, begins


def spelt(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The strings at some places of a buffer."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = data[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat))


def _slice_counts(part: pa.RecordBatch) -> pa.RecordBatch:
    """Per language, source and term of a slice: its documents and its occurrences, from the runs of sorted pointers."""
    data, starts, sizes, doc = term_pointers(part.column("text"))
    order, begins = sort_pointers(data, starts, sizes)
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    by_group = np.argsort(group, kind="stable")  # documents numbered so that those of a group stand together
    place = np.empty(len(group), np.int64)
    place[by_group] = np.arange(len(group))
    term = np.cumsum(begins) - 1
    met = np.sort((term << 32) | place[doc[order]])
    if not len(met):
        return from_columns(lang=pa.array([], pa.string()), source=pa.array([], pa.string()), term=pa.array([], pa.string()), n=np.zeros(0, np.int64), docs=np.zeros(0, np.int64))
    new_doc = np.concatenate(([True], met[1:] != met[:-1]))
    term, owner = met >> 32, group[by_group[met & 0xFFFFFFFF]]
    new_group = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))))
    owner = owner[new_group]
    first = order[begins]
    return from_columns(
        lang=lang.dictionary.take(pa.array(owner // len(source.dictionary))), source=source.dictionary.take(pa.array(owner % len(source.dictionary))),
        term=spelt(data, starts[first], sizes[first]).take(pa.array(term[new_group])), n=np.diff(np.append(new_group, len(met))), docs=np.add.reduceat(new_doc.astype(np.int64), new_group))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per (lang, source, term): n, its occurrences, and docs, the documents that hold it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                yield _slice_counts(part)

    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    each = rows.mapInArrow(tidy(count), "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (n + ADDED) / whole), exactly: long division by three decimal digits at a time, so that nothing overflows."""
    left = n + ADDED if whole < 2**63 // 1000 else n.astype(object) + ADDED
    out = 0
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return (1 + out).astype(np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _divergences(best: int) -> Callable:
    """Of some terms of a language: their part of each two sources' divergence, and each source's best terms among them."""
    def run(key: tuple, terms: pa.Table, language: pa.Table) -> pa.Table:
        lang, known = language.column("lang")[0].as_py(), language.column("groups")[0].as_py()
        kinds, total = language.column("kinds")[0].as_py(), language.column("total")[0].as_py()
        names = [g["source"] for g in known]
        wholes = [g["n"] + ADDED * kinds for g in known]
        number = {name: i for i, name in enumerate(names)}
        rows: list[tuple] = []
        sums = np.zeros((len(names), len(names)), np.int64)
        # a block of terms at a time: the table of shares has a column for each source
        step = max(1, 4_000_000 // max(1, len(names)))
        held: list[list[tuple]] = [[] for _ in names]
        for start in range(0, terms.num_rows, step):
            block = terms.slice(start, step).combine_chunks()
            lists = block.column("sources").chunk(0)
            flat = lists.flatten()
            counts = np.zeros((block.num_rows, len(names)), np.int64)
            at = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
            column = flat.field("source").dictionary_encode()
            column = np.array([number[s] for s in column.dictionary.to_pylist()], np.int64)[column.indices.to_numpy()]
            counts[at, column] = flat.field("n").to_numpy()
            p = np.stack([shares(counts[:, i], w) for i, w in enumerate(wholes)], axis=1)
            q = shares(counts.sum(axis=1), total + ADDED * kinds)
            for i in range(len(names) - 1):
                sums[i, i + 1 :] += gap(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
            spelling = block.column("term").chunk(0)
            for i in range(len(names)):
                found = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
                value = gap(p[found, i], q[found])
                if len(found) > best:  # those that can be among the best, ties too
                    least = np.partition(value, len(value) - best)[len(value) - best]
                    found, value = found[value >= least], value[value >= least]
                here = zip(value.tolist(), spelling.take(pa.array(found)).to_pylist(), strict=True)
                held[i] = sorted([*held[i], *here], key=lambda x: (-x[0], x[1].encode()))[:best]
        for i, name in enumerate(names):
            rows += [(lang, name, "term", term, value) for value, term in held[i]]
            rows += [(lang, name, "pair", other, int(sums[min(i, j), max(i, j)])) for j, other in enumerate(names) if j != i]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table(dict(zip(("lang", "source", "part", "item", "value"), (pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)), strict=True)))

    return run


def source_audit(docs: DataFrame, least_docs: int = 10, best: int = 10, block: int = 20_000, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the divergence from each other source of the language, part ``term``
    the ``best`` terms that the source has more of than its language.  Terms of at least ``least_docs`` documents of the language are
    kept; ``block`` of them are worked on together, in as many tasks as that takes."""
    spark = docs.sparkSession
    counts = term_counts(docs, text, lang, source)
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources")).where(F.col("docs") >= least_docs).drop("docs"))

    groups = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    whole = kept.select("lang", F.explode("sources").alias("s")).groupBy(F.col("lang").alias("l2"), F.col("s.source").alias("s2")).agg(F.sum("s.n").alias("n"))
    groups = groups.join(whole, (F.col("lang") == F.col("l2")) & (F.col("source") == F.col("s2")), "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    kinds = kept.groupBy(F.col("lang").alias("l2")).agg(F.count(F.lit(1)).alias("kinds"))
    languages = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("total"))
    languages = languages.join(kinds, F.col("lang") == F.col("l2"), "left").select("lang", "groups", "total", F.coalesce("kinds", F.lit(0)).alias("kinds"))
    # a row for each language; from a file Spark knows its size, and picks the kind of join by it
    path = shared_path(spark, "source-audit")
    languages.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kinds") / block)).cast("int")).write.parquet(path)
    languages = spark.read.parquet(path)

    blocks = languages.select(F.col("lang").alias("l2"), "blocks")
    terms = kept.join(blocks, F.col("lang") == F.col("l2")).select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "sources")
    languages = languages.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = terms.groupBy("lang", "block").cogroup(languages.groupBy("lang", "block")).applyInArrow(_divergences(best), "lang string, source string, part string, item string, value long")
    parts = cut(parts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
