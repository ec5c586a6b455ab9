"""Perturbations: random substitution replicates (C6: W6, F18, F19, U4) and
random masking (C12: F15-F17).  All in-row; a draw is md5 of
(seed, row id, replicate/step, position), so any partitioning repeats it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import hash_order, hash_uniform
from ..functions.vocab import MASK, PAD, SUBSTITUTES, chars


def _symbols(symbols) -> Column:
    return F.array(*[F.lit(s) for s in symbols])


def replicate(df: DataFrame, n: int, col: str = "replicate") -> DataFrame:
    """``n`` copies with an index column, no driver loop."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def position_key(seed, row_id, rep, i) -> Column:
    """Total order of positions within a row: md5 key, ties by position."""
    return F.concat(hash_order(seed, row_id, rep, i), F.lpad(i.cast("string"), 10, "0"))


def substitute(df: DataFrame, seq_col: str, id_col: str, rep_col: str, percent: float, seed: int,
               out_col: str = "gen") -> DataFrame:
    """W6 + F18: change exactly ``int(len * percent)`` distinct positions, each
    to a symbol drawn uniformly from the 21 valid ones (20 standard + X)
    other than the current symbol.  The chosen positions are those whose
    hash key is among the n smallest: one in-row sort, no shuffle.  Keys and
    the cut-off come out of generators of one element: Catalyst would put
    plain columns into the lambda, and sort the keys again for every position."""
    row_id, rep = F.col(id_col), F.col(rep_col)
    d = df.withColumn("_c", chars(F.col(seq_col)))
    keys = F.transform("_c", lambda x, i: position_key(F.lit(seed), row_id, rep, i))
    d = d.withColumn("_s", F.explode_outer(F.array(F.struct(F.col("_c").alias("c"), keys.alias("k"), F.floor(F.size("_c") * F.lit(float(percent))).cast("int").alias("n"))))).drop("_c")
    cut = F.when(F.col("_s.n") > 0, F.element_at(F.array_sort("_s.k"), F.greatest(F.col("_s.n"), F.lit(1))))
    d = d.withColumn("_cut", F.explode_outer(F.array(cut)))
    others = F.create_map(*[c for s in SUBSTITUTES for c in (F.lit(s), _symbols([v for v in SUBSTITUTES if v != s]))])

    def pick(x, i):
        cands = F.coalesce(F.try_element_at(others, x), _symbols(SUBSTITUTES))
        u = hash_uniform(F.lit(seed), row_id, rep, i, F.lit("s"))
        return F.element_at(cands, (F.floor(u * F.size(cands)) + 1).cast("int"))

    pairs = F.zip_with("_s.c", "_s.k", lambda x, k: F.struct(x.alias("x"), (k <= F.col("_cut")).alias("hit")))
    out = F.transform(pairs, lambda s, i: F.when(s["hit"], pick(s["x"], i)).otherwise(s["x"]))
    return d.withColumn(out_col, F.array_join(out, "")).drop("_s", "_cut")


def random_substitution(df: DataFrame, id_col: str, seq_col: str, percent: float = 0.1,
                        replicates: int = 1, seed: int = 0) -> DataFrame:
    """``(id, replicate, orig, gen)`` for every row and replicate."""
    r = replicate(df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("orig")), replicates)
    return substitute(r, "orig", "id", "replicate", percent, seed)


def changed_positions(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda t: t))


def mask_ids(ids: Column, row_id: Column, p: Column, seed: int, step=None, mask_pads: bool = False) -> Column:
    """F16: each token -> 23 with probability p (Bernoulli by hash draw).
    Pads are left alone unless ``mask_pads`` (the reference masks them, Q9)."""
    step = F.lit(0) if step is None else step

    def one(t, i):
        hit = hash_uniform(F.lit(seed), row_id, step, i) < p
        if not mask_pads:
            hit = hit & (t != F.lit(PAD))
        return F.when(hit, F.lit(MASK)).otherwise(t)

    return F.transform(ids, one)


def row_mask_rate(row_id: Column, seed: int, floor: float = 0.05) -> Column:
    """one rate per row, clamp(U + floor, 0, 1)."""
    u = hash_uniform(F.lit(seed), row_id, F.lit("p"))
    return F.least(F.greatest(u + F.lit(float(floor)), F.lit(0.0)), F.lit(1.0))


def random_mask(df: DataFrame, id_col: str, ids_col: str, seed: int = 0, p: float | None = None,
                floor: float = 0.05, mask_pads: bool = False, out_col: str = "masked") -> DataFrame:
    """F15 (per-row random rate) or F16 (given rate ``p``)."""
    rate = F.lit(float(p)) if p is not None else row_mask_rate(F.col(id_col), seed, floor)
    return (df.withColumn("mask_p", rate)
            .withColumn(out_col, mask_ids(F.col(ids_col), F.col(id_col), F.col("mask_p"), seed,
                                          mask_pads=mask_pads)))


def mask_schedule(df: DataFrame, id_col: str, ids_col: str, steps: int = 20, min_p: float = 0.0,
                  seed: int = 0, mask_pads: bool = False, out_col: str = "masked") -> DataFrame:
    """linear schedule from 1 down to ``min_p`` over ``steps`` steps,
    one masked copy per step (explode, not a driver loop)."""
    d = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    denom = max(steps - 1, 1)
    p = F.lit(1.0) + F.col("step").cast("double") * F.lit(float(min_p) - 1.0) / F.lit(float(denom))
    d = d.withColumn("mask_p", p)
    return d.withColumn(out_col, mask_ids(F.col(ids_col), F.col(id_col), F.col("mask_p"), seed,
                                          step=F.col("step"), mask_pads=mask_pads))
