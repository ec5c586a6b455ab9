"""k-NN two-class evaluation (C10): labelled class subsets, neighbour votes,
predictions (J4, U1, J8, W2, F20, F21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allpairs import knn


def class_union(class0: DataFrame, class1: DataFrame) -> DataFrame:
    """Union-all of two labelled subsets; a row in both appears twice with
    opposite labels (classes are not exclusive, Q17)."""
    return class0.withColumn("y", F.lit(0)).unionByName(class1.withColumn("y", F.lit(1)))


def gather(embeddings: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of an embedding set selected by an id list (inner equi-join)."""
    return embeddings.join(ids, id_col)


def neighbour_votes(queries: DataFrame, labelled: DataFrame, k: int = 5, weights: str = "uniform",
                    id_col: str = "id", vec_col: str = "embedding", y_col: str = "y",
                    exclude_self: bool = False, block_rows: int = 2048) -> DataFrame:
    """J8 + W2 + F21: ``(id, p0, p1)`` class probabilities from the k nearest
    labelled references (ties by reference id).  ``distance`` weights are
    1/d; if any neighbour is at distance 0 those neighbours take all weight.

    The labelled side may hold the same vector twice (U1); its neighbour key
    is therefore (id, y) folded into one long."""
    lab = labelled.select(F.col(id_col).cast("long").alias("_oid"), F.col(vec_col).alias("_v"),
                          F.col(y_col).cast("int").alias("_y"))
    lab = lab.withColumn("_nid", F.col("_oid") * 2 + F.col("_y"))
    bad = lab.where(F.col("_y").isNull() | ~F.col("_y").isin(0, 1) | (F.abs(F.col("_oid")) >= 2 ** 62)).count()
    if bad:
        raise ValueError(f"{bad} labelled rows have a class other than 0 or 1, or an id beyond 62 bits")
    nn = knn(queries, lab, k, id_col=id_col, vec_col=vec_col, ref_id_col="_nid", ref_vec_col="_v",
             exclude_self=exclude_self, ref_self_col="_oid", block_rows=block_rows)
    nn = nn.withColumn("_y", F.pmod(F.col("rid"), F.lit(2)).cast("int"))
    if weights == "uniform":
        w = F.lit(1.0)
        agg = nn.groupBy("sid").agg(
            F.sum(F.when(F.col("_y") == 0, w).otherwise(0.0)).alias("_w0"),
            F.sum(F.when(F.col("_y") == 1, w).otherwise(0.0)).alias("_w1"),
            F.count(F.lit(1)).cast("double").alias("_wt"))
    elif weights == "distance":
        zero = F.col("dist") == 0
        agg0 = nn.groupBy("sid").agg(
            F.max(zero.cast("int")).alias("_hz"),
            F.sum(F.when(zero & (F.col("_y") == 0), 1.0).otherwise(0.0)).alias("_z0"),
            F.sum(F.when(zero & (F.col("_y") == 1), 1.0).otherwise(0.0)).alias("_z1"),
            F.sum(F.when(~zero & (F.col("_y") == 0), 1.0 / F.col("dist")).otherwise(0.0)).alias("_d0"),
            F.sum(F.when(~zero & (F.col("_y") == 1), 1.0 / F.col("dist")).otherwise(0.0)).alias("_d1"))
        hz = F.col("_hz") == 1
        agg = agg0.select(
            "sid",
            F.when(hz, F.col("_z0")).otherwise(F.col("_d0")).alias("_w0"),
            F.when(hz, F.col("_z1")).otherwise(F.col("_d1")).alias("_w1"))
        agg = agg.withColumn("_wt", F.col("_w0") + F.col("_w1"))
    else:
        raise ValueError(f"unknown weights {weights!r}")
    return agg.select(F.col("sid").alias(id_col), (F.col("_w0") / F.col("_wt")).alias("p0"),
                      (F.col("_w1") / F.col("_wt")).alias("p1"))


def predict(votes: DataFrame) -> DataFrame:
    """argmax of class probabilities, a tie goes to the lowest class."""
    return votes.withColumn("pred", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0))
