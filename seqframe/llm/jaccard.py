"""N-gram Jaccard join by filters under several global token orders.

A document is the set of its word n-grams, as 64-bit hashes ("tokens");
documents with equal sets form a class.  Two sets of a and b tokens with a
Jaccard similarity of at least P % share at least o = ceil(P * n / 100)
tokens, n being the size of either, so at most p - 1 = n - o tokens of a set
are missing in the other.  Then, under any order of all tokens, the first
p + g - 1 tokens of both share g of them.

* First order: by hash.  The first L = p + g - 1 tokens of each set are taken
  (about 23 % of them at 85 %), and each token's sets are counted.
* Second order, within these: rare tokens first.  The first L - g' + 1 of them
  must share one token (g' is the g of the smallest possible partner).  Tokens
  of one set alone can't be shared; a set that has enough of them is done.
* Third order: by descending hash.  Candidates must share g' of their first L
  tokens under the first and under the third order before the sets are compared,
  in groups of any size.

Candidates are not spelt out as pairs.  The smallest set that a token has is its
lead; the sets of all tokens of one lead are a group, and a group's sets are
compared in one step, by a matrix of their tokens, which is built in blocks of
rows so that many small sets need no more memory.  A group of more tokens than
``block`` first compares each set to the lead alone: sets that link with it need
no comparing among themselves.  The others are cut in chunks, and each pair of
chunks is a group of its own.

Cases: a text with fewer words than n is one token; null and empty texts and
texts without words have an empty set and link with nothing; repeated rows are
of one class; a null doc_id counts for no ``component_id`` (null if a component
has no other); an empty table gives an empty result; other columns are ignored.
64-bit hashes stand for words, n-grams and sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut, fresh, from_columns, grams, mix64, slices, text_key, tidy, word_hashes
from seqframe.llm.components import connected_components


def lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """L and g of sets of n tokens."""
    overlap = (percent * n + 99) // 100
    p = n - overlap + 1
    length = np.minimum(n, p + np.maximum(1, (p + 1) // 2) - 1)
    return length, length - p + 1


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """g': what the smallest possible partner of a set of n tokens still guarantees."""
    return lengths(np.maximum(1, (percent * n + 99) // 100), percent)[1]


def token_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Ascending distinct n-gram hashes of each text."""
    words, offsets = word_hashes(texts, lower=True)
    flat = grams(words, n)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(np.unique(flat[a : b - n + 1] if b - a >= n else grams(words[a:b], b - a) if b > a else words[:0]))
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit hash of each set; 0 for an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    full = sizes > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][full]
        flat = np.concatenate(sets)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix64(flat), starts) * np.uint64(3) + np.add.reduceat(mix64(flat ^ np.uint64(0x5DEECE66D)), starts)
            out[full] = mix64(sums + sizes[full].astype(np.uint64))
    return out.view(np.int64)


def _sizes(n: int, percent: int) -> Callable:
    """Per document its key, size, class, L and how many tokens of its first L the second order takes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = token_sets(part.column("text"), n)
                size = np.array([len(s) for s in sets], np.int64)
                first, _ = lengths(size, percent)
                yield from_columns(doc_id=part.column("doc_id"), t=part.column("t"), n=size, c=set_hashes(sets), first=first, take=first - least_shared(size, percent) + 1)

    return run


def _firsts(n: int, percent: int) -> Callable:
    """Per distinct set of a partition (tok, c) for its first L tokens by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = token_sets(part.column("text"), n)
                size = np.array([len(s) for s in sets], np.int64)
                first, _ = lengths(size, percent)
                own, toks, classes = set_hashes(sets), [], []
                if len(seen) > 2_000_000:
                    seen.clear()
                for i, c in enumerate(own.tolist()):
                    if size[i] and c not in seen:
                        seen.add(c)
                        toks.append(sets[i][: first[i]])
                        classes.append(i)
                if toks:
                    yield from_columns(tok=np.concatenate(toks).view(np.int64), c=np.repeat(own[classes], [len(x) for x in toks]))

    return run


def _set_bytes(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = token_sets(part.column("text"), n)
                yield from_columns(c=set_hashes(sets), toks=pa.array([s.tobytes() for s in sets], pa.binary()))

    return run


def compare(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[int, int]:
    """Sizes of intersection and union of ascending sets; (0, size) if a filter says that they can't be similar."""
    sizes = np.array([len(a), len(b)], np.int64)
    if 100 * sizes.min() < percent * sizes.max():
        return 0, int(sizes.sum())
    (la, lb), _ = lengths(sizes, percent)
    need = least_shared(sizes, percent).max()
    for x, y in ((a[:la], b[:lb]), (a[-la:], b[-lb:])):
        if len(np.intersect1d(x, y, assume_unique=True)) < need:
            return 0, int(sizes.sum())
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _with_lead(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("toks"), batch.column("lead_toks"), strict=True):
                both, either = compare(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                linked.append(100 * both >= percent * either)
            yield from_columns(lead=batch.column("lead"), c=batch.column("c"), n=batch.column("n"), settled=pa.array(linked, pa.bool_()))

    return run


def _shared(rows: list[np.ndarray], columns: list[np.ndarray], cells: int) -> np.ndarray:
    """How many tokens each of ``rows`` shares with each of ``columns``.  Frequent tokens go through a matrix product, ``cells`` at a
    time, the others are counted pair by pair."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    tok = np.concatenate(columns)
    column = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
    order = np.argsort(tok, kind="stable")
    tok, column = tok[order], column[order]
    own = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    begin, end = np.searchsorted(tok, own, side="left"), np.searchsorted(tok, own, side="right")
    often = end - begin > max(16, len(columns) // 16)
    at = np.unique(begin[often])
    step = max(1, cells // (len(rows) + len(columns)))
    for start in range(0, len(at), step):
        part = at[start : start + step]
        left, right = np.zeros((len(rows), len(part)), np.float32), np.zeros((len(columns), len(part)), np.float32)
        mine = often & (begin >= part[0]) & (begin <= part[-1])
        left[row[mine], np.searchsorted(part, begin[mine])] = 1
        for i, (x, y) in enumerate(zip(part, np.searchsorted(tok, tok[part], side="right"), strict=True)):
            right[column[x:y], i] = 1
        out += left @ right.T
    seldom = np.flatnonzero(~often & (end > begin))
    many = np.cumsum((end - begin)[seldom])
    start = 0
    while start < len(seldom):
        stop = max(start + 1, int(np.searchsorted(many, (many[start - 1] if start else 0) + cells, side="right")))
        some = seldom[start:stop]
        size = end[some] - begin[some]
        place = np.repeat(begin[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        np.add.at(out.reshape(-1), np.repeat(row[some], size) * len(columns) + column[place], np.float32(1))
        start = stop
    return out


def linked_sets(sets: list[np.ndarray], percent: int, columns: int = 8192, cells: int = 4_000_000) -> np.ndarray:
    """For each set the smallest number of a set that links reach from it.  ``cells`` bounds a matrix: sets are taken as blocks of
    rows, of which only the labels are kept, and at most ``columns`` rows at a time."""
    if len(sets) == 2:
        both, either = compare(*sets, percent)
        return np.array([0, 0 if 100 * both >= percent * either else 1])
    sizes = np.array([len(s) for s in sets], np.int64)
    length, need = lengths(sizes, percent)[0], least_shared(sizes, percent)
    first, last = [s[:n] for s, n in zip(sets, length)], [s[len(s) - n :] for s, n in zip(sets, length)]
    label = np.arange(len(sets))
    height = max(1, min(columns, cells // max(1, len(sets))))
    for start in range(0, len(sets), height):
        stop = min(start + height, len(sets))
        # links are mutual, so the sets before have been compared; the first and the third order say which pairs can be similar
        least = np.maximum(need[start:stop, None], need[None, start:])
        near = _shared(first[start:stop], first[start:], cells) >= least
        if near.sum() > stop - start:  # each set is near itself
            near &= _shared(last[start:stop], last[start:], cells) >= least
        near[np.arange(stop - start), np.arange(stop - start)] = False
        a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(a):
            continue
        rows, others = a + start, b + start
        both = _shared([sets[i] for i in rows], [sets[i] for i in others], cells).astype(np.int64)
        linked = near[np.ix_(a, b)] & (100 * both >= percent * (sizes[rows, None] + sizes[None, others] - both))
        while True:
            # the least label on both sides of a link, for all sets of the labels that it replaces
            by_row = np.minimum(label[rows], np.where(linked, label[others][None, :], len(sets)).min(axis=1))
            by_other = np.minimum(label[others], np.where(linked, by_row[:, None], len(sets)).min(axis=0))
            to = np.arange(len(sets))
            np.minimum.at(to, label[rows], by_row)
            np.minimum.at(to, label[others], by_other)
            if (to == np.arange(len(sets))).all():
                break
            label = to[label]
    return label


def _grouped(percent: int) -> Callable:
    """Per set of a group that links with an earlier one an edge; all of them together tie the group's components."""
    def run(group: pa.Table) -> pa.Table:
        c = group.column("c").to_numpy()
        label = linked_sets([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("toks")], percent)
        tied = label != np.arange(len(c))
        return pa.table({"a": pa.array(c[tied], pa.int64()), "b": pa.array(c[label[tied]], pa.int64())})

    return run


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", block: int = 150_000) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, t, n, c: their class) and classes that link with others (c, component).  ``block``: tokens of a chunk."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    each = cut(rows.mapInArrow(tidy(_sizes(n, percent)), "doc_id long, t long, n long, c long, first long, take long"))
    classes = each.where("n > 0").groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("take").alias("take"))

    # first order, and tokens that several sets (or copies of one in several partitions) have there
    firsts = rows.select("text").mapInArrow(tidy(_firsts(n, percent)), "tok long, c long")
    shared = firsts.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("tok").alias("tok2"), "df")
    own = firsts.join(shared, F.col("tok") == F.col("tok2")).groupBy("c", "df", "tok").agg(F.lit(1)).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("own"))
    # second order: rare ones first, after those that no other set has
    named = classes.select(F.col("c").alias("c2"), "n", "at", (F.col("take") - F.col("first")).alias("left"))
    postings = own.join(named, F.col("c") == F.col("c2")).withColumn("k", F.size("own") + F.col("left")).where("k > 0")
    postings = cut(postings.select("c", "n", "at", F.explode(F.slice("own", F.lit(1), F.least("k", F.size("own")).cast("int"))).alias("p")).select("c", "n", "at", F.col("p.tok").alias("tok")))

    lead = postings.groupBy("tok").agg(F.min("c").alias("lead"), F.max("c").alias("high")).where("lead < high").select(F.col("tok").alias("tok2"), "lead")
    members = cut(postings.join(lead, F.col("tok") == F.col("tok2")).groupBy("lead", "c").agg(F.first("n").alias("n"), F.first("at").alias("at")))
    wanted = members.groupBy("c").agg(F.first("at").alias("at")).select(F.col("at.doc_id").alias("id2"), F.col("at.t").alias("t2"))
    found = rows.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")), "left_semi")
    sets = cut(found.select("text").mapInArrow(tidy(_set_bytes(n)), "c long, toks binary").dropDuplicates(["c"]))
    set_of = sets.select(F.col("c").alias("c2"), "toks")

    groups = members.groupBy("lead").agg(F.sum("n").alias("weight")).select(F.col("lead").alias("lead2"), "weight")
    members = members.drop("at").join(groups, F.col("lead") == F.col("lead2")).drop("lead2")
    small = members.where(F.col("weight") <= block).select("lead", F.lit(0).alias("i"), F.lit(0).alias("j"), "c")

    lead_set = sets.select(F.col("c").alias("lead2"), F.col("toks").alias("lead_toks"))
    large = members.where(F.col("weight") > block).join(set_of, F.col("c") == F.col("c2")).join(lead_set, F.col("lead") == F.col("lead2"))
    large = cut(large.select("lead", "c", "n", "toks", "lead_toks").mapInArrow(tidy(_with_lead(percent)), "lead long, c long, n long, settled boolean"))
    chunks = large.groupBy("lead").agg(*[F.ceil(F.coalesce(F.sum(F.when(F.col("settled") == kind, F.col("n"))), F.lit(0)) / block).cast("int").alias(name) for name, kind in (("ks", True), ("ku", False))])
    settled = large.where("settled").select(F.col("c").alias("a"), F.col("lead").alias("b"))
    large = large.join(chunks.withColumnRenamed("lead", "lead2"), F.col("lead") == F.col("lead2")).where("ku > 0")
    # settled sets stand in chunks 0 to ks - 1, the others in ks to ks + ku - 1
    mine = F.when(F.col("settled"), F.pmod(F.xxhash64("c"), "ks")).otherwise(F.col("ks") + F.pmod(F.xxhash64("c"), "ku")).cast("int")
    other = F.explode(F.sequence(F.when(F.col("settled"), F.col("ks")).otherwise(F.lit(0)), F.col("ks") + F.col("ku") - 1))
    pairs = large.select("lead", "c", mine.alias("x"), other.alias("y")).select("lead", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "c")

    together = small.union(pairs).join(set_of, F.col("c") == F.col("c2")).select("lead", "i", "j", "c", "toks")
    edges = together.groupBy("lead", "i", "j").applyInArrow(_grouped(percent), "a long, b long")
    return each, connected_components(edges.union(settled)).withColumnRenamed("node", "c")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, t (a hash of its text), n_shingles, component_id (the smallest doc_id that links reach, its own included)."""
    each, of = jaccard_classes(docs, n, percent, doc_id, text)
    rows = each.select("doc_id", "t", F.col("n").alias("n_shingles"), "c").join(of.withColumnRenamed("c", "c2"), F.col("c") == F.col("c2"), "left")
    rows = rows.withColumn("component", F.coalesce("component", "c")).drop("c", "c2")
    least = rows.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "component2")
    rows = rows.join(least, (F.col("component") == F.col("component2")) & (F.col("n_shingles") > 0), "left")
    return rows.select("doc_id", "t", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that link, over any number of links, with one of a smaller doc_id; of rows with equal doc_id and
    text one stays.  Where no document of a component has a doc_id, all stay."""
    found = cut(jaccard_components(docs, n, percent, doc_id, text))
    stay = found.where("component_id = doc_id or component_id is null or (doc_id is null and n_shingles = 0)").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("rows"))
    id_, t = fresh(docs, "jaccard_id", "jaccard_t")
    stay = stay.select(F.col("doc_id").alias(f"{id_}2"), F.col("t").alias(f"{t}2"), "rows")
    kept = docs.withColumn(id_, F.col(doc_id).cast("long")).withColumn(t, text_key(F.col(text)))
    kept = kept.join(stay.hint("shuffle_hash"), F.col(id_).eqNullSafe(F.col(f"{id_}2")) & (F.col(t) == F.col(f"{t}2")), "left_semi")
    if not stay.where((F.col("rows") > 1) & F.col(f"{id_}2").isNotNull()).isEmpty():
        with_id = kept.where(F.col(id_).isNotNull()).dropDuplicates([id_, t])
        kept = with_id.union(kept.where(F.col(id_).isNull()))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
