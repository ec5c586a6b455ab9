"""Exact global ranks and running sums without a one-partition window.

Spark puts an un-partitioned window (``Window.orderBy(...)``) into a single
task.  Here the total order is cut into order-preserving buckets; a tiny
per-bucket table (bounded by the bucket count) gives each bucket its offset,
and a window partitioned by bucket finishes the job in parallel:

    bucket(row)  --groupBy-->  (bucket, n, sums)  --prefix over <= B rows-->
    offsets  --broadcast join (B rows)-->  row_number within bucket + offset

Used by the seeded split (W3), dictionary indexing (W4), running
precision/recall (W5), exact quantiles (A19) and loader batches (T4).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 65536


def md5_bucket(hex_key, hex_digits: int = 4) -> Column:
    """Order-preserving bucket of a hex md5 key (16**hex_digits buckets)."""
    k = F.col(hex_key) if isinstance(hex_key, str) else hex_key
    return F.conv(F.substring(k, 1, hex_digits), 16, 10).cast("int")


def range_bucket(df: DataFrame, col: str, nbuckets: int = 64, descending: bool = False,
                 rel_err: float = 0.001) -> Column:
    """Order-preserving bucket of a numeric column from approximate quantile
    cut points.  Only ``nbuckets - 1`` numbers reach the driver (bounded by the
    parameter, not by the data); equal values always share a bucket."""
    nb = int(nbuckets)
    if not 1 <= nb <= MAX_BUCKETS:
        raise ValueError(f"nbuckets must be 1 to {MAX_BUCKETS}, not {nbuckets}")
    probs = [i / nb for i in range(1, nb)]
    cuts = sorted(set(df.approxQuantile(col, probs, rel_err))) if probs else []
    v = F.col(col).cast("double")
    if not cuts:
        return F.lit(0)
    if descending:
        terms = [(v < F.lit(float(c))).cast("int") for c in cuts]
    else:
        terms = [(v > F.lit(float(c))).cast("int") for c in cuts]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def key_bucket(df: DataFrame, keys: Sequence[tuple[str, bool]], nbuckets: int = 16, per_bucket: int = 64) -> Column:
    """Order-preserving bucket along a composite key of (column, descending) parts, from cut points over the whole key: rows
    that tie in its first parts are told apart by the later ones, so no value fills a bucket.  The cuts come from
    ``nbuckets * per_bucket`` rows, taken by a hash of the key, which is all that reaches the driver."""
    if not 1 <= nbuckets <= 1024:
        raise ValueError(f"nbuckets must be 1 to 1024, not {nbuckets}")
    names = [c for c, _ in keys]
    some = df.select(*names).orderBy(F.xxhash64(*names), *names).limit(nbuckets * per_bucket).collect()

    def rank(row):
        return [x.encode() if isinstance(x, str) else -x if desc else x for x, (_, desc) in zip(row, keys, strict=True)]

    if any(desc and isinstance(x, str) for row in some[:1] for x, (_, desc) in zip(row, keys, strict=True)):
        raise ValueError("text parts of the key are in ascending order")
    some.sort(key=rank)
    bucket = F.lit(0)
    for cut in sorted({i * len(some) // nbuckets for i in range(1, nbuckets)} - {0}):
        beyond, level = F.lit(False), F.lit(True)
        for (name, desc), x in zip(keys, some[cut], strict=True):
            beyond = beyond | (level & (F.col(name) < F.lit(x) if desc else F.col(name) > F.lit(x)))
            level = level & (F.col(name) == F.lit(x))
        bucket = bucket + beyond.cast("int")
    return bucket


#: Rows of one bucket that may reach the driver when a key is picked from it.
PICK_ROWS = 4096


def keys_at(df: DataFrame, hex_key: str, id_col: str, positions: Callable[[int], Sequence[int]]) -> tuple[int, list[tuple | None]]:
    """The number of rows and the keys (hex_key, id) at some 1-based positions of their order; None for position 0.

    Rows are counted by a prefix of the key, and only the buckets where a position falls are looked at again, by a
    longer prefix, until they are small enough to be read.  Nothing is sorted or shuffled but counts; the driver
    sees at most 16**4 counts a position and round, and ``PICK_ROWS`` keys."""
    def counted(digits: int, within: set[str]) -> dict[str, int]:
        rows = df if not within else df.where(F.substring(hex_key, 1, digits - 4).isin(*within))
        return {r["p"]: r["n"] for r in rows.groupBy(F.substring(hex_key, 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}

    digits, counts = 4, counted(4, set())
    total = sum(counts.values())
    wanted = [(p, "") for p in positions(total)]  # what is left of the position within a prefix
    while True:
        found = []
        for left, prefix in wanted:
            for bucket in sorted(b for b in counts if b.startswith(prefix)) if left > 0 else ():
                if left <= counts[bucket]:
                    found.append((left, bucket))
                    break
                left -= counts[bucket]
            else:
                found.append((0, ""))
        wanted = found
        near = {b for left, b in wanted if left}
        if digits == 32 or all(counts[b] <= PICK_ROWS for b in near):
            break
        digits += 4
        counts = counted(digits, near)
    if not near:
        return total, [None] * len(wanted)
    # rows of one id have one key, so what is read stays small where a hash is a whole key
    rows = df.where(F.substring(hex_key, 1, digits).isin(*near)).groupBy(hex_key, id_col).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r[0], r[1], r[2]) for r in rows)
    out = []
    for left, prefix in wanted:
        key = None
        for h, i, n in rows if left else ():
            if h.startswith(prefix):
                key, left = (h, i), left - n
                if left <= 0:
                    break
        out.append(key)
    return total, out


def up_to(hex_key: str, id_col: str, key: tuple | None) -> Column:
    """Whether a row's key is not beyond the given one."""
    if key is None:
        return F.lit(False)
    return (F.col(hex_key) < F.lit(key[0])) | ((F.col(hex_key) == F.lit(key[0])) & (F.col(id_col) <= F.lit(key[1])))


def prefix_rank(df: DataFrame, bucket: Column, order_cols: Sequence[Column],
                measures: Sequence[str] = (), rank_col: str | None = "rank",
                partition_cols: Sequence[str] = ()) -> DataFrame:
    """Global ``row_number`` (``rank_col``) and running sums ``cum_<m>`` in the
    total order ``order_cols`` (must be a total order; ``bucket`` must be
    non-decreasing along it).  Adds ``total_n`` and ``total_<m>``.

    ``partition_cols`` restarts the order per group (a few groups only, e.g.
    classes: the offsets table has #groups x #buckets rows)."""
    parts = list(partition_cols)
    d = df.withColumn("_bkt", bucket)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.sum(m).alias(f"_s_{m}") for m in measures]
    per_bucket = d.groupBy(*parts, "_bkt").agg(*aggs)
    # <= #groups x #buckets rows: the offset windows here are bounded.
    before = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*parts)
    off_cols = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off_rows"),
                F.sum("_rows").over(everything).alias("total_n")]
    for m in measures:
        off_cols.append(F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_off_{m}"))
        off_cols.append(F.sum(f"_s_{m}").over(everything).alias(f"total_{m}"))
    offsets = per_bucket.select(*parts, "_bkt", *off_cols)
    out = d.join(F.broadcast(offsets), [*parts, "_bkt"])
    within = Window.partitionBy(*parts, "_bkt").orderBy(*order_cols)
    if rank_col:
        out = out.withColumn(rank_col, F.row_number().over(within) + F.col("_off_rows"))
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for m in measures:
        out = out.withColumn(f"cum_{m}", F.sum(m).over(running) + F.col(f"_off_{m}"))
    drop = ["_bkt", "_off_rows"] + [f"_off_{m}" for m in measures]
    return out.drop(*drop)


def hash_rank(df: DataFrame, seed, id_col: str, rank_col: str = "rank", hex_digits: int = 4) -> DataFrame:
    """Rank rows by ``md5(seed|id)`` (ties by id): a seeded permutation that is
    identical in Spark, DuckDB and plain Python."""
    from ..functions.random import hash_order

    d = df.withColumn("_h", hash_order(F.lit(seed), F.col(id_col)))
    out = prefix_rank(d, md5_bucket("_h", hex_digits), [F.col("_h"), F.col(id_col)], rank_col=rank_col)
    return out.drop("_h")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], nbuckets: int = 64) -> DataFrame:
    """Exact continuous quantiles (linear interpolation, ``quantile_cont``).

    Values collapse to a histogram first (partial aggregation, so a hot value
    costs one row per partition); running counts come from ``prefix_rank``
    and each row knows the total, so the two order statistics around every
    position h = (n-1)p + 1 are picked by one conditional aggregate - no join,
    no single-task sort."""
    from ..session import materialize

    # one row per distinct value: bounded by the value domain, read 3 times
    hist = materialize(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("cnt")))
    bucket = range_bucket(hist, col, nbuckets)
    ranked = prefix_rank(hist, bucket, [F.col(col)], measures=["cnt"], rank_col=None)
    v = F.col(col).cast("double")
    lower = F.col("cum_cnt") - F.col("cnt")
    aggs = [F.first("total_cnt").alias("_n")]
    for i, p in enumerate(probs):
        h = (F.col("total_cnt") - 1) * F.lit(float(p)) + 1
        aggs.append(F.max(F.when((lower < F.floor(h)) & (F.col("cum_cnt") >= F.floor(h)), v)).alias(f"_lo{i}"))
        aggs.append(F.max(F.when((lower < F.ceil(h)) & (F.col("cum_cnt") >= F.ceil(h)), v)).alias(f"_hi{i}"))
    one = ranked.agg(*aggs)
    rows = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p)) + 1
        val = F.col(f"_lo{i}") + (h - F.floor(h)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
        rows.append(F.struct(F.lit(float(p)).alias("p"), val.alias("value")))
    return one.select(F.explode(F.array(*rows)).alias("_q")).select("_q.p", "_q.value")
