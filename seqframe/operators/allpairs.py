"""Exact all-pairs vector work without a cross join: the kernel of ``metric``, which leaves out pairs by the triangle
inequality (J5, J6, J8, W1, W2, A11), and the plan for work that needs all pairs (A13) or has one block of references.

Both sides are cut into hash blocks of as many rows as a task can hold
(``group_rows``: bounded by bytes, not by the pairs).  Subject rows are
replicated once per reference block and reference rows once per subject
block, so the pair (subject block q, reference block r) meets in exactly one
co-group.  An Arrow kernel goes through a block a tile of ``CHUNK`` x
``TILE`` pairs at a time: one BLAS product (norm expansion; ``topk`` in float32 with a bound of its
error, in float64 where too many pairs lie within it) and
one comparison with what each subject has so far, and emits only reductions
per subject row:

* ``topk``    - the k nearest references (exact distances, ties by id)
* ``cover``   - whether the subject lies strictly inside any reference ball
* ``realism`` - max over references of radius / (distance + 1e-6)
* ``guard``   - count / minimum of negative squared distances (A13)

Pairs are never materialised as rows.  Memory per task is one block of each
side and one tile; shuffle volume is n_s * R + n_r * Q vectors.  Whatever may
change a result within the tolerance of the product (the k-th place, a
distance near a radius, the best ratio) is recomputed with the direct sum of
squared differences, so results equal the direct formula the SQL oracle uses.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-6
PAD_CANDIDATES = 8


# Pairs whose distance is worked out exactly at once: bounds the memory of ties.
EXACT_PAIRS = 16_384
#: Pairs a subject waiting to be worked out: the nearer the kth so far, the fewer follow.
FOLD_PAIRS = 8
#: Four times the unit rounding of single precision (twice what bounds the error), and one in how many references of a tile may be
#: near enough before products are of double precision.
SINGLE, CROWDED = 2.0 ** -22, 128


def check_vectors(df: DataFrame, vec_col: str) -> int:
    """Number of rows; raises with a count if a vector is null, holds a null,
    NaN or infinite component, or has another length than the others."""
    v = F.col(vec_col)
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~sound, 1)).alias("bad"),
               F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} of {r['n']} vectors are null or hold null, NaN or infinite components")
    if r["n"] and r["low"] != r["high"]:
        raise ValueError(f"vectors have {r['low']} to {r['high']} components")
    return r["n"]


def _prep(df: DataFrame, id_col: str, vec_col: str, radius_col: str | None, prefix: str,
          self_col: str | None = None) -> DataFrame:
    cols = [F.col(id_col).cast("long").alias(f"{prefix}id"), F.col(vec_col).alias(f"{prefix}vec")]
    if prefix == "r":
        cols.append(F.col(self_col or id_col).cast("long").alias("rself"))
    if radius_col:
        cols.append(F.col(radius_col).cast("double").alias(f"{prefix}radius"))
    return df.select(*cols)


MIN_BLOCK_ROWS = 128


#: A block of a side that meets another in one task: bytes of its vectors as float64, and rows.
GROUP_BYTES, GROUP_ROWS = 16 << 20, 65_536
#: Subjects and references whose products are worked out at once.
CHUNK, TILE = 256, 2048


def group_rows(dimension: int, block_rows: int = 1) -> int:
    """How many vectors of a side meet in one task."""
    return max(block_rows, min(GROUP_ROWS, GROUP_BYTES // (8 * max(1, dimension))), 1)


def _grid(n_s: int, n_r: int, rows: int, par: int) -> tuple[int, int]:
    """Numbers of hash blocks of subjects and references: enough to keep a block at most ``rows`` (bounded task memory),
    and for parallelism at least ``4 * par`` pairs of them - but no block below ``MIN_BLOCK_ROWS`` rows.  Every extra block
    replicates the other side once more (shuffle volume), so the cheaper side is cut first."""
    q, r = max(1, math.ceil(n_s / rows)), max(1, math.ceil(n_r / rows))
    most_q, most_r = max(q, math.ceil(n_s / MIN_BLOCK_ROWS)), max(r, math.ceil(n_r / MIN_BLOCK_ROWS))
    while q * r < 4 * par and (q < most_q or r < most_r):
        if q < most_q and (r >= most_r or n_r * q <= n_s * r):
            q += 1
        else:
            r += 1
    return q, r


def _matrix(column) -> np.ndarray:
    """Vectors of one length (an Arrow column) as rows of a table."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _stack(series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _approx_d2(x: np.ndarray, y: np.ndarray):
    xx = np.einsum("ij,ij->i", x, x)
    yy = np.einsum("ij,ij->i", y, y)
    d2 = xx[:, None] + yy[None, :] - 2.0 * (x @ y.T)
    tol = 1e-9 * (xx[:, None] + yy[None, :] + 1.0)
    return d2, tol


def _exact(x_rows: np.ndarray, y_rows: np.ndarray) -> np.ndarray:
    diff = x_rows - y_rows
    return np.sqrt(np.einsum("...j,...j->...", diff, diff))


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a table; mostly little is."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def _product(one: np.ndarray, wide: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Products of all rows of ``one`` and ``wide``, in ``room``: new memory for each tile would cost as much as the product."""
    return np.matmul(one, wide.T, out=room[:len(one) * len(wide)].reshape(len(one), len(wide)))


def _tiles(n: int):
    return (slice(t, min(t + TILE, n)) for t in range(0, n, TILE))


def _topk(sid, x, rid, rself, y, k: int, exclude_self: bool) -> dict:
    # about the middle and in units of the largest component nothing overflows, and single precision tells most pairs apart
    middle = y.mean(axis=0)
    wide = np.empty((len(y), y.shape[1] + 1))
    np.subtract(middle, y, out=wide[:, :-1])
    size = max(np.abs(v).max(initial=0.0) for v in (wide[:, :-1], *(x[s:s + CHUNK] - middle for s in range(0, len(x), CHUNK)))) * math.sqrt(wide.shape[1])
    unit = 1 / size if 1e-300 < size < 1e300 else 1.0
    wide[:, :-1] *= unit
    yy = np.einsum("ij,ij->i", wide[:, :-1], wide[:, :-1])
    wide[:, -1] = yy / 2
    single, largest = wide.astype(np.float32), yy.max()
    outs, room, single_room = [], np.empty(CHUNK * TILE), np.empty(CHUNK * TILE, np.float32)
    for s in range(0, len(sid), CHUNK):
        xs, ids = x[s:s + CHUNK], sid[s:s + CHUNK]
        one = np.concatenate([(xs - middle) * unit, np.ones((len(xs), 1))], axis=1)
        single_one = one.astype(np.float32)
        xx = np.einsum("ij,ij->i", one[:, :-1], one[:, :-1])
        fine = 1e-9 * (xx + largest)
        rough = fine + SINGLE * (wide.shape[1] + 8) * (np.sqrt(xx * largest) + largest / 2 + xx) + 1e-36
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # row of the chunk, rid, dist
        reach, waiting, held, close = np.full(len(xs), np.inf), [], 0, True

        def fold(best, reach):
            """The k nearest so far by (distance, id), a bounded number of pairs at a time, and the squared distance of the kth."""
            for w in waiting:
                for at in range(0, len(w[0]), EXACT_PAIRS):
                    row, col = w[0][at:at + EXACT_PAIRS], w[1][at:at + EXACT_PAIRS]
                    row, near, dist = (np.concatenate(c) for c in zip(best, (row, rid[col], _exact(xs[row], y[col])), strict=True))
                    order = np.lexsort((near, dist, row))
                    row, near, dist = row[order], near[order], dist[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    last = place == k - 1
                    reach[row[last]] = (dist[last] * unit) ** 2
                    best = tuple(c[place < k] for c in (row, near, dist))
            return best, reach

        def near(t, one, wide, room, tol):
            """Rows and columns of the pairs of a tile that may be among the k nearest, by products of which ``tol`` bounds the error."""
            half = _product(one, wide[t], room)  # (squared distance - xx) / 2
            most = (reach + tol - xx) / 2
            if np.isinf(reach).any():
                if exclude_self:
                    half[ids[:, None] == rself[None, t]] = np.inf
                keep = min(k + PAD_CANDIDATES, half.shape[1])
                most = np.minimum(most, np.partition(half, keep - 1, axis=1)[:, keep - 1] + tol)
            return _where(half <= np.nextafter(most.astype(half.dtype), half.dtype.type(np.inf))[:, None])

        for t in _tiles(len(rid)):
            if close:
                row, col = near(t, single_one, single, single_room, rough)
                close = len(row) <= len(xs) * (k + PAD_CANDIDATES + (t.stop - t.start) // CROWDED)
            if not close:  # too many within the error of single precision
                row, col = near(t, one, wide, room, fine)
            col += t.start
            if exclude_self:
                other = ids[row] != rself[col]
                row, col = row[other], col[other]
            waiting.append((row, col))
            held += len(row)
            if held >= min(EXACT_PAIRS, FOLD_PAIRS * len(xs)) or np.isinf(reach).any():
                best, reach = fold(best, reach)
                waiting, held = [], 0
        best, reach = fold(best, reach)
        outs.append((ids[best[0]], best[1], best[2]))
    return dict(zip(("sid", "rid", "dist"), (np.concatenate(c) for c in zip(*outs, strict=True)), strict=True))


def _cover(sid, x, rself, y, radius, exclude_self: bool) -> dict:
    known = ~np.isnan(radius)
    rself, y, radius = rself[known], y[known], radius[known]
    r2, yy = radius ** 2, np.einsum("ij,ij->i", y, y)
    wide = np.concatenate([-y, (yy - r2)[:, None] / 2], axis=1)
    covered, room = np.zeros(len(sid), bool), np.empty(CHUNK * TILE)
    for s in range(0, len(sid) if len(y) else 0, CHUNK):
        xs, ids, hit = x[s:s + CHUNK], sid[s:s + CHUNK], covered[s:s + CHUNK]
        xx = np.einsum("ij,ij->i", xs, xs)
        tol = 1e-9 * (xx + (yy + r2).max() + 1.0)
        one = np.concatenate([xs, np.ones((len(xs), 1))], axis=1)
        for t in _tiles(len(y)):
            open_ = np.flatnonzero(~hit)
            if not len(open_):
                break
            half = _product(one[open_], wide[t], room)  # (squared distance - squared radius - xx) / 2
            if exclude_self:
                half[ids[open_][:, None] == rself[None, t]] = np.inf
            low = half.min(axis=1)
            sure = low < (-xx[open_] - tol[open_]) / 2
            hit[open_[sure]] = True
            edge = ~sure & (low <= (tol[open_] - xx[open_]) / 2)
            rows, cols = _where(half[edge] <= ((tol - xx)[open_[edge]] / 2)[:, None])
            rows, cols = open_[edge][rows], cols + t.start
            for at in range(0, len(rows), EXACT_PAIRS):
                row, col = rows[at:at + EXACT_PAIRS], cols[at:at + EXACT_PAIRS]
                inside = _exact(xs[row], y[col]) < radius[col]
                if exclude_self:
                    inside &= ids[row] != rself[col]
                hit[row[inside]] = True
    return {"sid": sid, "covered": covered}


def _realism(sid, x, rself, y, radius, exclude_self: bool) -> dict:
    known = ~np.isnan(radius)
    rself, y, radius = rself[known], y[known], radius[known]
    yy = np.einsum("ij,ij->i", y, y)
    best, room = np.full(len(sid), -np.inf), np.empty(CHUNK * TILE)
    wide = np.concatenate([-y, yy[:, None] / 2, np.ones((len(y), 1)), -(radius ** 2)[:, None] / 2], axis=1)
    for s in range(0, len(sid) if len(y) else 0, CHUNK):
        xs, ids, top = x[s:s + CHUNK], sid[s:s + CHUNK], best[s:s + CHUNK]
        xx = np.einsum("ij,ij->i", xs, xs)
        for t in _tiles(len(y)):
            if (top > 1e-100).all():
                # (squared distance - squared radius / squared best) / 2: not above 0 where the ratio may be better
                one = np.concatenate([xs, np.ones((len(xs), 1)), xx[:, None] / 2, (1 / top ** 2)[:, None]], axis=1)
                tol = 1e-9 * (xx + yy.max() + 1.0 + (radius.max() / top) ** 2)
                rows, cols = _where(_product(one, wide[t], room) <= tol[:, None])
            else:
                d2 = np.maximum(_approx_d2(xs, y[t])[0], 0.0)
                if exclude_self:
                    d2[ids[:, None] == rself[None, t]] = np.inf
                ratio = np.where(np.isfinite(d2), radius[None, t] / (np.sqrt(d2) + EPS), -np.inf)
                # recompute exactly wherever the approximate ratio could reach the max
                able = (ratio >= ratio.max(axis=1)[:, None] * (1 - 1e-6) - 1e-12) | (d2 < 1e-6)
                rows, cols = _where(able & np.isfinite(d2))
            cols += t.start
            for at in range(0, len(rows), EXACT_PAIRS):
                row, col = rows[at:at + EXACT_PAIRS], cols[at:at + EXACT_PAIRS]
                if exclude_self:
                    other = ids[row] != rself[col]
                    row, col = row[other], col[other]
                np.maximum.at(top, row, radius[col] / (_exact(xs[row], y[col]) + EPS))
    seen = best > -np.inf
    return {"sid": sid[seen], "ratio": best[seen]}


def _guard(x, y) -> dict:
    found = [d2 for s in range(0, len(x), 1024) for t in _tiles(len(y)) for d2 in [_approx_d2(x[s:s + 1024], y[t])[0]] for d2 in [((d2 < 0).sum(), d2.min())]]
    return {"n_negative": np.array([sum(n for n, _ in found)], np.int64), "min_d2": np.array([min(d for _, d in found)], np.float64)}


_EMPTY = {
    "topk": {"sid": "int64", "rid": "int64", "dist": "float64"},
    "cover": {"sid": "int64", "covered": "bool"},
    "realism": {"sid": "int64", "ratio": "float64"},
    "guard": {"n_negative": "int64", "min_d2": "float64"},
}


def _reduce(mode: str, k: int, exclude_self: bool, sid, x, rid, rself, y, radius) -> dict:
    """The columns of a block's reduction."""
    if not len(sid) or not len(rid):
        return {c: np.zeros(0, t) for c, t in _EMPTY[mode].items()}
    if mode == "topk":
        return _topk(sid, x, rid, rself, y, k, exclude_self)
    if mode == "cover":
        return _cover(sid, x, rself, y, radius, exclude_self)
    if mode == "realism":
        return _realism(sid, x, rself, y, radius, exclude_self)
    return _guard(x, y)


def _kernel(mode: str, k: int, exclude_self: bool):
    """The reduction of two blocks as pandas tables."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        radius = right["rradius"].to_numpy(dtype=np.float64) if "rradius" in right else None
        return pd.DataFrame(_reduce(mode, k, exclude_self, left["sid"].to_numpy(dtype=np.int64), _stack(left["svec"]),
                                    right["rid"].to_numpy(dtype=np.int64), right["rself"].to_numpy(dtype=np.int64), _stack(right["rvec"]), radius))

    return run


def _arrow_kernel(mode: str, k: int, exclude_self: bool):
    """The reduction of two blocks as Arrow tables, for ``cogroup().applyInArrow``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: np.zeros(0, t) for c, t in _EMPTY[mode].items()})
        radius = right["rradius"].to_numpy().astype(np.float64) if "rradius" in right.column_names else None
        return pa.table(_reduce(mode, k, exclude_self, left["sid"].to_numpy(), _matrix(left["svec"]), right["rid"].to_numpy(), right["rself"].to_numpy(), _matrix(right["rvec"]), radius))

    return run


_SCHEMAS = {
    "topk": "sid long, rid long, dist double",
    "cover": "sid long, covered boolean",
    "realism": "sid long, ratio double",
    "guard": "n_negative long, min_d2 double",
}


def blocked_reduce(subjects: DataFrame, refs: DataFrame, mode: str, *, k: int = 1,
                   id_col: str = "id", vec_col: str = "embedding", ref_id_col: str | None = None,
                   ref_vec_col: str | None = None, radius_col: str | None = None,
                   exclude_self: bool = False, ref_self_col: str | None = None, block_rows: int = 2048,
                   n_subjects: int | None = None, n_refs: int | None = None) -> DataFrame:
    """Run one blocked all-pairs reduction; returns per-block partial results
    (merge with :func:`merge_topk` / ``groupBy(sid)``).  Row counts size the
    blocks; pass them when the vectors are already counted and checked.  A block
    holds what a task can, or ``block_rows`` rows if that is more.
    ``exclude_self`` leaves out references whose ``ref_self_col`` (their id, if
    not given) is the subject's id."""
    s = _prep(subjects, id_col, vec_col, None, "s")
    r = _prep(refs, ref_id_col or id_col, ref_vec_col or vec_col, radius_col, "r", ref_self_col)
    n_s = n_subjects if n_subjects is not None else check_vectors(s, "svec")
    n_r = n_refs if n_refs is not None else check_vectors(r, "rvec")
    if not n_s or not n_r:
        return subjects.sparkSession.createDataFrame([], _SCHEMAS[mode])
    return meet_all(s, r, mode, k, exclude_self, n_s, n_r, group_rows(dimension(r, "rvec"), block_rows))


def dimension(df: DataFrame, vec_col: str) -> int:
    """Components of the vectors, which are all of one length."""
    return df.select(F.size(vec_col)).first()[0]


def meet_all(s: DataFrame, r: DataFrame, mode: str, k: int, exclude_self: bool, n_s: int, n_r: int, rows: int) -> DataFrame:
    """Partial results of all pairs of blocks of at most about ``rows`` subjects (sid, svec) and references (rid, rvec, rself, rradius)."""
    par = s.sparkSession.sparkContext.defaultParallelism
    qb, rb = _grid(n_s, n_r, rows, par)
    s = s.withColumn("qb", F.pmod(F.xxhash64("sid"), F.lit(qb)).cast("int")) \
         .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))
    r = r.withColumn("rb", F.pmod(F.xxhash64("rid"), F.lit(rb)).cast("int")) \
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    # few bytes but much work for each of them: dealt to so many tasks whatever the size of the rows
    tasks = min(qb * rb, 4 * par)
    return (s.repartition(tasks, "qb", "rb").groupBy("qb", "rb").cogroup(r.repartition(tasks, "qb", "rb").groupBy("qb", "rb"))
            .applyInArrow(_arrow_kernel(mode, k, exclude_self), _SCHEMAS[mode]))


def merge_topk(partials: DataFrame, k: int) -> DataFrame:
    """Final exact top-k per subject over <= (#ref blocks * k) candidates;
    Spark plans a partial ``WindowGroupLimit`` ahead of the shuffle."""
    w = Window.partitionBy("sid").orderBy(F.col("dist"), F.col("rid"))
    return partials.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)


def knn(subjects: DataFrame, refs: DataFrame, k: int, **kw) -> DataFrame:
    """``(sid, rid, dist, nn_rank)`` for the k nearest references."""
    from .metric import pruned_reduce

    return merge_topk(pruned_reduce(subjects, refs, "topk", k=k, **kw), k)


def distance_guard(subjects: DataFrame, refs: DataFrame, **kw) -> DataFrame:
    """Negative squared distances produced by the norm expansion."""
    p = blocked_reduce(subjects, refs, "guard", **kw)
    return p.agg(F.sum("n_negative").alias("n_negative"), F.min("min_d2").alias("min_d2"))
