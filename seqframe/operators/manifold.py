"""k-NN manifolds: radii, precision / recall coverage, realism.

A manifold is ``(id, embedding, radius)``: radius = distance to the k-th
nearest neighbour inside the same set, counting the row itself (the
(k+1)-th smallest distance, duplicates included - Q11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allpairs import check_vectors, merge_topk
from .metric import pruned_reduce


def compute_manifold(df: DataFrame, k: int = 3, id_col: str = "id", vec_col: str = "embedding",
                     block_rows: int = 2048, materialize: bool = True) -> DataFrame:
    """J5 self-join + W1: ``(id, embedding, radius)``.  Raises if N < k + 2.

    The manifold is reused (coverage both ways, realism), so by default it is
    checkpointed into the shared checkpoint folder once - the reference's
    saved-manifold reuse (S11) - instead of being recomputed per use."""
    n = check_vectors(df, vec_col)
    if n < k + 2:
        raise ValueError(f"manifold needs at least k+2={k + 2} rows, got {n}")
    part = pruned_reduce(df, df, "topk", k=k + 1, id_col=id_col, vec_col=vec_col, block_rows=block_rows,
                          n_subjects=n, n_refs=n)
    radii = merge_topk(part, k + 1).groupBy("sid").agg(F.max("dist").alias("radius"))
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding"))
    out = base.join(radii, base["id"] == radii["sid"]).drop("sid")
    if materialize:
        from ..session import materialize as _materialize

        out = _materialize(out)
    return out


def covered_rows(ball_manifold: DataFrame, points: DataFrame, id_col: str = "id",
                 vec_col: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``(id, covered)``: point strictly inside any ball of the manifold."""
    part = pruned_reduce(points, ball_manifold, "cover", id_col=id_col, vec_col=vec_col,
                          ref_id_col="id", ref_vec_col="embedding", radius_col="radius",
                          block_rows=block_rows)
    merged = part.groupBy("sid").agg(F.max(F.col("covered").cast("int")).alias("_c"))
    base = points.select(F.col(id_col).cast("long").alias("id"))
    return (base.join(merged, base["id"] == merged["sid"], "left")
            .select("id", (F.coalesce(F.col("_c"), F.lit(0)) == 1).alias("covered")))


def precision_recall(ref_manifold: DataFrame, subject_manifold: DataFrame, block_rows: int = 2048) -> DataFrame:
    """A10: precision = share of subject rows inside the reference manifold,
    recall = share of reference rows inside the subject manifold."""
    prec = covered_rows(ref_manifold, subject_manifold, block_rows=block_rows).withColumn("_side", F.lit("p"))
    rec = covered_rows(subject_manifold, ref_manifold, block_rows=block_rows).withColumn("_side", F.lit("r"))
    c = F.col("covered").cast("double")
    return prec.unionByName(rec).agg(
        F.avg(F.when(F.col("_side") == "p", c)).alias("precision"),
        F.avg(F.when(F.col("_side") == "r", c)).alias("recall"),
    )


def realism(ref_manifold: DataFrame, subjects: DataFrame, id_col: str = "id", vec_col: str = "embedding",
            block_rows: int = 2048) -> DataFrame:
    """``(id, realism)`` = max over references of radius/(distance+1e-6)."""
    part = pruned_reduce(subjects, ref_manifold, "realism", id_col=id_col, vec_col=vec_col,
                          ref_id_col="id", ref_vec_col="embedding", radius_col="radius",
                          block_rows=block_rows)
    return part.groupBy("sid").agg(F.max("ratio").alias("realism")).withColumnRenamed("sid", "id")


def realism_aligned(ref_manifold: DataFrame, subjects: DataFrame, ref_key: str, subject_key: str,
                    vec_col: str = "embedding") -> DataFrame:
    """The reference pairs rows by position; here by an explicit key
    (equi-join), then the global max of radius/(distance+1e-6)."""
    from ..functions.vectors import l2_distance

    r = ref_manifold.select(F.col(ref_key).alias("_key"), F.col("embedding").alias("_rv"), "radius")
    s = subjects.select(F.col(subject_key).alias("_key"), F.col(vec_col).alias("_sv"))
    j = r.join(s, "_key")
    return j.agg(F.max(F.col("radius") / (l2_distance("_rv", "_sv") + F.lit(1e-6))).alias("realism"))
