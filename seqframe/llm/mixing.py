"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in an order shuffled by a keyed hash.  A copy
of a document gets the virtual finish time (words of its source up to and
with it, over all passes so far) / (target of its source).  All copies are
sorted by that time, in ranges, and the sort is cut where the total budget is
used up.  A source whose target exceeds its size is passed through again, at
most ``max_repeats`` times.

Cases: a null text has no words and is never taken; the null source is the
last one; a null doc_id orders by a hash of its own; repeated rows are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.llm.common import cut, fresh, text_key, words_of

#: Ranges of virtual time in which the copies are summed before one range is sorted; a unit is the time of one whole target.
RANGES, LAST = 4096, 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """From (source, size) of all documents, per source: source_size, s_rank, weight, target.

    Sources in order of code points, null last, get the weights in turn and share the sum of all sizes.  A target
    stops at ``max_repeats`` times its source's size; the excess is shared by weight among the rest.  One row per
    source is sorted, in the order in which targets reach their stops.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("s_rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("s_rank") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("stop", F.col("source_size") * max_repeats)
    filling = Window.orderBy(F.col("stop") / F.col("weight"), "s_rank")
    whole = Window.partitionBy(F.lit(1))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", rest.cast("double") / heavy)
    # the first source in this order that its share does not fill sets the level for itself and all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), "s_rank", "level"))).over(whole)["level"]
    return s.withColumn("target", F.least(F.col("stop").cast("double"), level * F.col("weight"))).select("source", "source_size", "s_rank", "weight", "target")


def _in_order(rows: DataFrame, digits: int) -> DataFrame:
    """Adds ``c0``: words of the source before the document, in shuffled order.

    Sums run within ranges of the hash (16 ** digits a source), after the sums of the ranges before, so that no
    source is sorted as a whole.
    """
    rows = rows.withColumn("b", F.substring("h", 1, digits))
    by_range = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("source", "b").agg(F.sum("size").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(by_range), F.lit(0)))
              .select(F.col("source").alias("source2"), F.col("b").alias("b2"), "start"))
    within = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("source2")) & (F.col("b") == F.col("b2")))
    return rows.withColumn("c0", F.col("start") + F.col("own")).drop("b", "own", "source2", "b2", "start")


def _finish(repeat: Column) -> Column:
    return (repeat * F.col("source_size") + F.col("c0") + F.col("size")).cast("double") / F.col("target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", digits: int = 3,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted), repeats, t (hash of the text).  ``digits`` hash digits (16 ** digits ranges a source) bound the rows that are sorted together."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null "), text_key(F.col(text)).cast("string")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"),
                       F.md5(F.concat(F.lit(seed + ":"), own)).alias("h"), text_key(F.col(text)).alias("t"))
    slim = cut(rows)
    targets = cut(source_targets(slim.select("source", "size"), weights, max_repeats))
    named = targets.withColumnRenamed("source", "source3")
    rows = _in_order(slim, digits).join(named, F.col("source").eqNullSafe(F.col("source3"))).drop("source3", "weight")
    rows = cut(rows)

    copies = rows.where("size > 0").select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in range(max_repeats)])).alias("repeat"))
    copies = copies.withColumn("v", _finish(F.col("repeat"))).withColumn("range", F.least(F.floor(F.col("v") * RANGES), F.lit(LAST * RANGES)))
    budget = targets.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    # LAST * RANGES + 1 sums at most
    sums = copies.groupBy("range").agg(F.sum("size").alias("n"))
    reached = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(Window.orderBy("range")).alias("upto"))
    first = reached.where(F.col("upto") > budget).orderBy("range").first()
    if first is None:
        repeats = F.when(F.col("size") > 0, F.lit(max_repeats)).otherwise(0)
    else:
        key = ["v", "s_rank", "repeat", "c0"]
        last = (copies.where(F.col("range") == first["range"]).select(*key, (F.sum("size").over(Window.orderBy(*key)) + first["before"]).alias("upto"))
                .where(F.col("upto") <= budget).agg(F.max(F.struct(*key)).alias("k")).first()["k"])
        # where even the first copy of the range is too much, all before the range is taken
        taken = []
        for i in range(max_repeats):
            v = _finish(F.lit(i))
            if last is None:
                ok = F.least(F.floor(v * RANGES), F.lit(LAST * RANGES)) < first["range"]
            else:
                ok = F.struct(v.alias("v"), F.col("s_rank"), F.lit(i).cast("long").alias("repeat"), F.col("c0")) <= F.struct(
                    F.lit(last["v"]).alias("v"), F.lit(last["s_rank"]).cast("int").alias("s_rank"), F.lit(last["repeat"]).cast("long").alias("repeat"), F.lit(last["c0"]).cast("long").alias("c0"))
            taken.append(F.when((F.col("size") > 0) & ok, 1).otherwise(0))
        repeats = sum(taken[1:], taken[0])
    out = rows.withColumn("repeats", repeats.cast("int")).withColumn("taken", F.col("size") * F.col("repeats"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "repeats", "t")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a document taken twice stands twice, one not taken not at all.

    Rows with equal doc_id, text and source share what the mix takes of them as evenly as it goes.
    """
    doc_id, text, source = (options.get(c, c) for c in ("doc_id", "text", "source"))
    key, n, rows, number = fresh(docs, "mix_key", "mix_n", "mix_rows", "mix_number")
    taken = mix_sources(docs, **options).groupBy(F.struct("doc_id", "source", "t").alias(f"{key}2")).agg(F.sum("repeats").alias(n), F.count(F.lit(1)).alias(rows)).where(F.col(n) > 0)
    own = F.struct(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), text_key(F.col(text)).alias("t"))
    both = docs.withColumn(key, own).join(taken, F.col(key) == F.col(f"{key}2"))
    both = both.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
    each = (F.floor(F.col(n) / F.col(rows)) + F.when(F.col(number) <= F.col(n) % F.col(rows), 1).otherwise(0)).cast("int")
    copies = F.explode(F.array_repeat(F.lit(0), each)).alias(f"{key}3")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop(f"{key}3")
