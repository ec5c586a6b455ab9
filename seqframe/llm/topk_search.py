"""Exact top-k search by integer inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id, queries to blocks.  A task
builds the ball tree of a shard and searches it for a block of queries: it goes
down the nodes in the order of their upper bounds (query . centre + |query| *
radius) and leaves out, query by query, nodes whose bound is below the kth
score so far.  Each query first searches one shard; the kth score found there
is shared with the search of all other shards.

Components are floor(scale * x) as integers; the products are taken in 64-bit
floats where these hold them exactly, else in Python integers.

Cases: vectors that are null or hold a null or non-finite component take no
part, nor does a row without an id; vectors of other length than the query are
no candidates; repeated rows of an id are separate candidates, all left out for
a query of that id; scores beyond 64 bits stop there; a query with fewer than k candidates gets them all; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.llm.common import cut

EXACT = 2.0**52


class BallTree:
    """Nodes of a binary tree over the rows of ``x``; a node holds the rows order[start:stop] within a ball."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.x, self.order = x, np.arange(len(x))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        todo = [(0, len(x), None, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            rows = x[self.order[start:stop]]
            centre = rows.mean(axis=0)
            apart = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.span)
            self.centre.append(centre)
            self.radius.append(float(apart.max()))
            self.span.append((start, stop))
            self.children.append(None)
            if parent is not None:
                self.children[parent] = (node, -1) if side == 0 else (self.children[parent][0], node)
            if stop - start > leaf and apart.max() > 0:
                # along the line from the farthest row to the one farthest from it
                a = rows[apart.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                half = (stop - start) // 2
                self.order[start:stop] = self.order[start:stop][np.argpartition(rows @ (b - a), half)]
                todo += [(start + half, stop, node, 1), (start, start + half, node, 0)]
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)


class Best:
    """The k best (score, smallest id first) of each query so far."""

    def __init__(self, n: int, k: int, kth: np.ndarray):
        self.k, self.floor = k, kth.astype(np.float64)
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    @property
    def kth(self) -> np.ndarray:
        """A row scoring less than this is not among a query's k best."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate((self.score[queries], scores), axis=1)
        i = np.concatenate((self.id[queries], np.broadcast_to(ids, scores.shape)), axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[queries], self.id[queries] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, kth: np.ndarray) -> Best:
    best = Best(len(queries), k, kth)
    length = np.sqrt((queries**2).sum(axis=1))
    # rounding of the bounds, with room to spare
    slack = 1e-9 * (1 + length * (np.abs(tree.centres).max(initial=0) * np.sqrt(queries.shape[1]) + tree.radii.max()))

    def bounds(node: int, active: np.ndarray) -> np.ndarray:
        return queries[active] @ tree.centres[node] + length[active] * tree.radii[node] + slack[active]

    todo = [(0, np.arange(len(queries)), np.full(len(queries), np.inf))]
    while todo:
        node, active, bound = todo.pop()
        live = bound >= best.kth[active]
        active = active[live]
        if not len(active):
            continue
        if tree.children[node] is None:
            start, stop = tree.span[node]
            for a in range(start, stop, 1024):
                rows = tree.order[a : min(stop, a + 1024)]
                scores = queries[active] @ tree.x[rows].T
                scores[query_ids[active][:, None] == ids[rows][None, :]] = -np.inf
                better = (scores >= best.kth[active][:, None]).any(axis=1)
                if better.any():
                    best.add(active[better], scores[better], ids[rows])
            continue
        left, right = tree.children[node]
        bl, br = bounds(left, active), bounds(right, active)
        # the child with the higher bounds is searched first
        ordered = [(left, active, bl), (right, active, br)]
        todo += ordered if bl.mean() < br.mean() else ordered[::-1]
    return best


def _plain(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """For components so large that floats would not be exact."""
    vectors = [(int(i), [int(c) for c in v]) for i, v in zip(rows["vec_id"], rows["vector"], strict=True)]
    out = []
    for q, v in zip(queries["id"], queries["v"], strict=True):
        v = [int(c) for c in v]
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q)
        out += [(int(q), i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scored[:k]]
    return out


def _searched(k: int) -> Callable:
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "score"]
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        x, q = np.array(rows["vector"].tolist(), np.float64), np.array(queries["v"].tolist(), np.float64)
        if x.shape[1] and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= EXACT:
            return pd.DataFrame(_plain(rows, queries, k), columns=names)
        kth = queries["kth"].to_numpy(np.float64, na_value=-np.inf)
        best = search(BallTree(x), rows["vec_id"].to_numpy(), q, queries["id"].to_numpy(), k, kth)
        hit = (best.score > -np.inf) & (best.score >= kth[:, None])
        at = np.nonzero(hit)[0]
        return pd.DataFrame({"query_id": queries["id"].to_numpy()[at], "id": best.id[hit], "score": best.score[hit].astype(np.int64)})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, shard_rows: int = 4096, query_rows: int = 2048, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row where ``queries`` holds: query_id, rank, vec_id, score of its k best among all other rows.

    ``shard_rows`` and ``query_rows`` are the rows of a shard and of a block of queries; their numbers follow from
    the size of the table.
    """
    x = F.col(embedding)
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    rows = vectors.where(sound & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")).alias("v"), F.size(x).alias("dims"), queries.alias("is_query"))
    rows = cut(rows)
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).first()
    shards, blocks = max(1, -(-count["n"] // shard_rows)), max(1, -(-count["q"] // query_rows))
    # equal ids may be many, so the vector has a say too
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", shard)
    asked = rows.where("is_query").select("id", "v", "dims", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "shard").dropDuplicates(["id", "dims", "v"])
    schema, on = "query_id long, id long, score long", ["dims", "shard", "block"]

    def met(wanted: DataFrame) -> DataFrame:
        """Queries against the shards they name; a shard is sent once to each block of queries."""
        places = wanted.select(*[F.col(c).alias(f"{c}2") for c in on]).distinct()
        dealt = rows.join(places, (F.col("dims") == F.col("dims2")) & (F.col("shard") == F.col("shard2"))).select("dims2", "shard2", "block2", F.col("id").alias("vec_id"), F.col("v").alias("vector"))
        return dealt.groupBy("dims2", "shard2", "block2").cogroup(wanted.groupBy(*on)).applyInPandas(_searched(k), schema)

    # the first shard of a block is the same for all its queries, so few shards are sent twice
    first = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    pilot = cut(_ranked(met(asked.withColumn("shard", first).withColumn("kth", F.lit(None).cast("double"))), k))
    kth = pilot.where(F.col("rank") == k).select(F.col("query_id").alias("id2"), F.col("score").cast("double").alias("kth"))
    rest = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != first) if shards > 1 else None
    found = pilot.select("query_id", "id", "score")
    if rest is not None:
        found = found.union(met(rest.join(kth, F.col("id") == F.col("id2"), "left").drop("id2")))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
