"""Exact nearest neighbours and coverage by a metric partition.

The references are laid out by space.  Pivots are means of a bounded sample; a reference lies in the cell of its nearest
pivot, and within the cell in an annulus of the distance to that pivot.  What is known of an annulus (its cell, the least and the
largest distance to the pivot, how many rows, the largest ball) bounds, by the triangle inequality, how near any of its
rows can be to a subject, so a subject is sent only to annuli that can change its result:

* ``topk`` and ``realism`` visit the most promising annulus first; what it gives (the kth distance, the best ratio) is
  the bound that decides which others are visited at all;
* ``cover`` visits the annuli whose largest ball reaches the subject.

How many annuli matter is found out with the subjects of a probe.  Where the bounds rule out so little that sending each
subject to its annuli costs more than letting all rows meet in large blocks (vectors without clusters), all rows meet.

A subject and an annulus meet in one cogroup, whose kernel works as in ``allpairs``.  Annuli above ``block_rows`` rows
are split by a hash of the id, and so are the subjects that visit one, so no group grows with the data or with a hot
cell.  Copies of a reference vector beyond those that can be among the k nearest (ties go to the smaller id) are left
out beforehand.  The driver holds pivots and annuli: at most ``MAX_PIVOTS`` x ``MAX_ANNULI`` rows of numbers at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .allpairs import _SCHEMAS, EPS, _arrow_kernel, _grid, _matrix, _prep, blocked_reduce, check_vectors, group_rows, meet_all

#: Bounds of what the driver holds, and of the sample that pivots are taken from.
MAX_PIVOTS, MAX_ANNULI, SAMPLE_ROWS = 256, 64, 4096
#: How many subjects meet a block of references at once: in blocks, and at least so many.
SUBJECT_BLOCKS, SUBJECT_ROWS = 4, 4096
#: The references are cut into about so many blocks at most, of more than ``block_rows`` rows if need be.
MAX_BLOCKS = 1024
#: Subjects that show how many annuli matter; and how many pairs cost as much as sending a row somewhere.
PROBE_ROWS, ROW_PAIRS = 256, 512
#: Entries of a table of subjects by annuli or their parts, and of visits given out, at once.
ROUTE_CELLS, ROUTE_ROWS = 1 << 18, 8192


def _distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to pivots by the expanded square, and for each row how far off they may be."""
    xx, pp = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", pivots, pivots)
    d2 = xx[:, None] + pp[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0)), 1e-6 * np.sqrt(xx + pp.max() + 1.0)


def choose_pivots(refs: DataFrame, many: int, id_col: str = "rid", vec_col: str = "rvec", rounds: int = 5) -> np.ndarray:
    """Means (Lloyd's rounds) of at most ``SAMPLE_ROWS`` rows, taken by a hash of their id; starts are spread by farthest-first."""
    rows = refs.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(vec_col).toArrow()
    x = np.unique(_matrix(rows.column(0).combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))), axis=0)
    many = min(many, len(x))
    chosen, near = [0], np.full(len(x), np.inf)
    while len(chosen) < many:
        near = np.minimum(near, np.einsum("ij,ij->i", x - x[chosen[-1]], x - x[chosen[-1]]))
        chosen.append(int(near.argmax()))
    pivots = x[chosen]
    for _ in range(rounds):
        of = _distances(x, pivots)[0].argmin(axis=1)
        held = np.bincount(of, minlength=many)
        sums = np.zeros_like(pivots)
        np.add.at(sums, of, x)
        pivots = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], pivots)
    return pivots


@dataclass(frozen=True)
class Annuli:
    """The annuli of a set of references: bounded arrays, one entry for each."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    ball: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of ``x`` how near the rows of each annulus can be at least and how far the farthest can be at most,
        and how far it is to its own pivot."""
        to_pivot, slack = _distances(x, self.pivots)
        own = to_pivot.min(axis=1, keepdims=True)
        # a reference may have been nearer to another pivot by as much as its own size lets distances be off
        to_cell, slack = to_pivot[:, self.cell], slack[:, None] + 1e-6 * self.high.max()
        least = np.maximum.reduce([to_cell - self.high - slack, self.low - to_cell - slack, (to_cell - own) / 2 - slack])
        return np.maximum(least, 0.0), to_cell + self.high + slack, to_cell

    def surely_within(self, most: np.ndarray, k: int) -> np.ndarray:
        """For each row a distance within which k references lie for sure; infinite where there are fewer than k."""
        order = np.argsort(most, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        at = order[np.arange(len(most)), enough.argmax(axis=1)]
        return np.where(enough.any(axis=1), most[np.arange(len(most)), at], np.inf)


def lay_out(refs: DataFrame, n: int, block_rows: int, pivots: int | None = None) -> tuple[DataFrame, Annuli]:
    """References (rid, rvec, ...) with ``block`` (the number of their annulus) and ``part``, and the annuli."""
    spark = refs.sparkSession
    centres = choose_pivots(refs, min(MAX_PIVOTS, pivots or math.ceil(math.sqrt(n))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("rvec"))
            cell = _distances(x, centres)[0].argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(np.einsum("ij,ij->i", x - centres[cell], x - centres[cell])) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64())], names=[*batch.schema.names, "cell", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refs.schema.fields)
    placed = materialize(refs.mapInArrow(place, f"{kinds}, cell int, away double"))
    cuts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("away", [i / MAX_ANNULI for i in range(1, MAX_ANNULI)], 1000).alias("cuts")).collect()
    # at most MAX_PIVOTS rows of MAX_ANNULI - 1 numbers
    some = []
    for r in cuts:
        many = min(MAX_ANNULI, math.ceil(r["n"] / block_rows))
        some.append((r["cell"], sorted({r["cuts"][MAX_ANNULI * i // many - 1] for i in range(1, many)})))
    table = spark.createDataFrame(some, "cell2 int, cuts array<double>")
    placed = placed.join(F.broadcast(table), F.col("cell") == F.col("cell2")).withColumn("annulus", F.size(F.filter("cuts", lambda c: c < F.col("away")))).drop("cell2", "cuts")
    ball = F.max("rradius") if "rradius" in refs.columns else F.lit(0.0)
    found = placed.groupBy("cell", "annulus").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"), ball.alias("ball")).collect()
    column = {c: np.array([r[c] for r in found]) for c in ("cell", "low", "high", "n", "ball")}
    parts = -(-column["n"] // block_rows)
    numbers = spark.createDataFrame([(r["cell"], r["annulus"], i, int(p)) for i, (r, p) in enumerate(zip(found, parts, strict=True))], "cell2 int, annulus2 int, block int, parts int")
    placed = placed.join(F.broadcast(numbers), (F.col("cell") == F.col("cell2")) & (F.col("annulus") == F.col("annulus2")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).select(*refs.columns, "block", "part")
    return placed, Annuli(centres, column["cell"].astype(np.int64), column["low"], column["high"], column["n"].astype(np.int64), parts.astype(np.int64), column["ball"].astype(np.float64))


def _route(subjects: DataFrame, annuli: Annuli, choose) -> DataFrame:
    """(sid, svec, block, part) for what ``choose`` gives for a batch and its vectors: rows, blocks and parts."""
    rows = max(1, ROUTE_CELLS // max(len(annuli.cell), int(annuli.parts.sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                found = choose(batch, _matrix(batch.column("svec")))
                for first in range(0, len(found[0]), ROUTE_ROWS):
                    row, block, part = (x[first:first + ROUTE_ROWS] for x in found)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column("sid").take(at), batch.column("svec").take(at), pa.array(block, pa.int32()), pa.array(part, pa.int32())], names=["sid", "svec", "block", "part"])

    return subjects.mapInArrow(run, f"sid long, svec {dict(subjects.dtypes)['svec']}, block int, part int")


def first_visits(subjects: DataFrame, annuli: Annuli) -> DataFrame:
    """The most promising block of each subject."""
    def choose(batch: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least, _, to_cell = annuli.nearest(x)
        home = (least + 1e-6 * to_cell).argmin(axis=1)
        return np.arange(len(x)), home, batch.column("spread").to_numpy() % annuli.parts[home]

    return _route(subjects.withColumn("spread", F.pmod(F.xxhash64("sid"), F.lit(2**31))), annuli, choose)


def visits_that_matter(subjects: DataFrame, annuli: Annuli, mode: str, k: int = 1) -> DataFrame:
    """All blocks that can change a subject's result.  For ``topk`` and ``realism`` subjects have a ``bound`` (what the first visit
    gave, null if that is nothing) and the ``home`` and ``home_part`` of the first visit, which is not made again."""
    def choose(batch: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least, most, _ = annuli.nearest(x)
        if mode == "cover":
            can = least < annuli.ball * (1 + 1e-9) + 1e-12
        else:
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            unknown = np.isnan(bound)
            if mode == "topk":
                bound[unknown] = annuli.surely_within(most[unknown], k)
                can = least <= (bound * (1 + 1e-9) + 1e-12)[:, None]
            else:
                bound[unknown] = -np.inf
                can = annuli.ball / (least + EPS) * (1 + 1e-9) >= bound[:, None]
        row, block = np.nonzero(can)
        many = annuli.parts[block]
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, block = np.repeat(row, many), np.repeat(block, many)
        if mode != "cover":
            rest = (block != batch.column("home").to_numpy()[row]) | (part != batch.column("home_part").to_numpy()[row])
            row, block, part = row[rest], block[rest], part[rest]
        return row, block, part

    return _route(subjects, annuli, choose)


def meet(visits: DataFrame, placed: DataFrame, mode: str, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """Partial results of all visits.  A block that many subjects visit is copied once for each ``SUBJECT_BLOCKS`` blocks (or ``SUBJECT_ROWS``) of them."""
    spark = visits.sparkSession
    # a row for each block; from a file Spark knows its size, and picks the kind of join by it
    path = scratch_path(spark, "visits")
    visits.groupBy(F.col("block").alias("block2"), F.col("part").alias("part2")).agg(F.ceil(F.count(F.lit(1)) / max(SUBJECT_ROWS, SUBJECT_BLOCKS * block_rows)).cast("int").alias("groups")).write.parquet(path)
    busy = spark.read.parquet(path)
    same = (F.col("block") == F.col("block2")) & (F.col("part") == F.col("part2"))
    left = visits.join(busy, same).select("sid", "svec", F.col("block").alias("b"), F.col("part").alias("p"), F.pmod(F.xxhash64("sid"), F.col("groups")).cast("int").alias("g"))
    right = placed.join(busy, same).select(*placed.columns, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g2"))
    return left.groupBy("b", "p", "g").cogroup(right.groupBy("block", "part", "g2")).applyInArrow(_arrow_kernel(mode, k, exclude_self), _SCHEMAS[mode])


def pruned_reduce(subjects: DataFrame, refs: DataFrame, mode: str, *, k: int = 1, id_col: str = "id", vec_col: str = "embedding", ref_id_col: str | None = None,
                  ref_vec_col: str | None = None, radius_col: str | None = None, exclude_self: bool = False, ref_self_col: str | None = None, block_rows: int = 2048,
                  n_subjects: int | None = None, n_refs: int | None = None, pivots: int | None = None) -> DataFrame:
    """Partial results of ``topk``, ``cover`` or ``realism`` as of ``allpairs.blocked_reduce`` (merge them alike), without the pairs
    that the triangle inequality rules out.  Row counts may be given when the vectors are already counted and checked."""
    if mode not in ("topk", "cover", "realism"):
        raise ValueError(f"mode is topk, cover or realism, not {mode!r}")
    s = _prep(subjects, id_col, vec_col, None, "s")
    r = _prep(refs, ref_id_col or id_col, ref_vec_col or vec_col, radius_col, "r", ref_self_col)
    n_s = n_subjects if n_subjects is not None else check_vectors(s, "svec")
    n_r = n_refs if n_refs is not None else check_vectors(r, "rvec")
    if not n_s or not n_r:
        return subjects.sparkSession.createDataFrame([], _SCHEMAS[mode])
    if n_r <= block_rows:  # one block: there is nothing to lay out, each subject meets it once
        return blocked_reduce(subjects, refs, mode, k=k, id_col=id_col, vec_col=vec_col, ref_id_col=ref_id_col, ref_vec_col=ref_vec_col, radius_col=radius_col,
                              exclude_self=exclude_self, ref_self_col=ref_self_col, block_rows=block_rows, n_subjects=n_s, n_refs=n_r)
    # copies of a vector: k of them, those that a subject passes over as its own besides; or the one of the largest ball
    copies = 1 if mode != "topk" else k
    if exclude_self:
        copies += r.groupBy("rself").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    order = [F.col("rid")] if mode == "topk" else [F.col("rradius").desc(), F.col("rid")]
    r = r.withColumn("copy", F.row_number().over(Window.partitionBy("rvec").orderBy(*order))).where(F.col("copy") <= copies).drop("copy")
    block_rows = max(block_rows, n_r // MAX_BLOCKS)
    placed, annuli = lay_out(r, n_r, block_rows, pivots)
    n_r, reach = int(annuli.rows.sum()), copies if exclude_self else k
    rows = group_rows(annuli.pivots.shape[1], block_rows)
    if not visits_pay(s, placed, annuli, mode, k, exclude_self, block_rows, reach, n_s, rows):
        return meet_all(s, placed.select(*r.columns), mode, k, exclude_self, n_s, n_r, rows)
    found, others = _visits(s, placed, annuli, mode, k, exclude_self, block_rows, reach)
    others = meet(materialize(others), placed, mode, k, exclude_self, block_rows)
    return others if found is None else found.unionByName(others)


def _visits(s: DataFrame, placed: DataFrame, annuli: Annuli, mode: str, k: int, exclude_self: bool, block_rows: int, reach: int) -> tuple[DataFrame | None, DataFrame]:
    """What the first visits of the subjects gave (``cover`` makes none), and the other visits that matter."""
    if mode == "cover":
        return None, visits_that_matter(s, annuli, mode)
    first = materialize(first_visits(s, annuli))
    found = materialize(meet(first, placed, mode, k, exclude_self, block_rows))
    bound = F.when(F.count(F.lit(1)) >= k, F.max("dist")) if mode == "topk" else F.max("ratio")
    known = found.groupBy(F.col("sid").alias("sid2")).agg(bound.cast("double").alias("bound"))
    rest = first.join(known, F.col("sid") == F.col("sid2"), "left").select("sid", "svec", F.col("block").alias("home"), F.col("part").alias("home_part"), "bound")
    return found, visits_that_matter(rest, annuli, mode, reach)


def visits_pay(s: DataFrame, placed: DataFrame, annuli: Annuli, mode: str, k: int, exclude_self: bool, block_rows: int, reach: int, n_s: int, rows: int) -> bool:
    """Whether visits cost less than letting all rows meet in blocks of ``rows``, by the visits of ``PROBE_ROWS`` subjects taken by
    a hash of their id.  Either way the results are the same."""
    n_r = int(annuli.rows.sum())
    some = materialize(s.orderBy(F.xxhash64("sid"), "sid").limit(PROBE_ROWS))
    _, others = _visits(some, placed, annuli, mode, k, exclude_self, block_rows, reach)
    made = np.zeros(len(annuli.cell))
    for row in others.groupBy("block").count().collect():  # at most a row for each annulus
        made[row["block"]] = row["count"]
    each = n_s / min(n_s, PROBE_ROWS)
    visits = each * (ROW_PAIRS * made.sum() + (made * annuli.rows / annuli.parts).sum()) + ROW_PAIRS * (n_s + 2 * n_r)
    qb, rb = _grid(n_s, n_r, rows, s.sparkSession.sparkContext.defaultParallelism)
    return visits < float(n_s) * n_r + ROW_PAIRS * (float(n_s) * rb + float(n_r) * qb)
