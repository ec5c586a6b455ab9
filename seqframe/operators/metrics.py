"""Classification report (A14) and average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_rank, range_bucket


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_counts(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """Per class (union of true and predicted labels): support, tp, predicted.
    One exploded pass + partial aggregation; the output has one row per class."""
    e = df.select(F.explode(F.array(
        F.struct(F.col(y_col).cast("string").alias("c"), F.lit(1).alias("t"),
                 (F.col(y_col) == F.col(pred_col)).cast("int").alias("h"), F.lit(0).alias("p")),
        F.struct(F.col(pred_col).cast("string").alias("c"), F.lit(0).alias("t"),
                 F.lit(0).alias("h"), F.lit(1).alias("p")))).alias("_e")).select("_e.*")
    return e.groupBy("c").agg(F.sum("t").cast("long").alias("support"), F.sum("h").cast("long").alias("tp"),
                              F.sum("p").cast("long").alias("predicted"))


def classification_report(df: DataFrame, y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """``(name, precision, recall, f1_score, support)`` rows for each class,
    ``macro avg`` and ``weighted avg``, plus an ``accuracy`` row whose value
    is in ``f1_score`` (as in the usual report layout).  Zero division -> 0."""
    cc = class_counts(df, y_col, pred_col)
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    per = cc.select(F.col("c").alias("name"), prec.alias("precision"), rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1_score", _safe_div(2 * F.col("precision") * F.col("recall"),
                                              F.col("precision") + F.col("recall")))
    tot = F.sum("support")
    summary = per.agg(
        F.avg("precision").alias("m_p"), F.avg("recall").alias("m_r"), F.avg("f1_score").alias("m_f"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("w_r"),
        (F.sum(F.col("f1_score") * F.col("support")) / tot).alias("w_f"),
        (F.sum("tp") / tot).alias("acc"), tot.cast("long").alias("n"))
    rows = summary.select(F.explode(F.array(
        F.struct(F.lit("macro avg").alias("name"), F.col("m_p").alias("precision"), F.col("m_r").alias("recall"),
                 F.col("m_f").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("name"), F.col("w_p").alias("precision"), F.col("w_r").alias("recall"),
                 F.col("w_f").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"),
                 F.col("n").alias("support")))).alias("_r")).select("_r.*")
    return per.select("name", "precision", "recall", "f1_score", "support").unionByName(rows)


def _known(score):
    """The score as a double; a null or NaN one raises, since it has no place in the order."""
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit("null or NaN score")).cast("double")).otherwise(s)


def average_precision(df: DataFrame, y_col: str, score_col: str, positive=1, nbuckets: int = 64) -> DataFrame:
    """One-vs-rest AP = sum over distinct scores (descending) of
    (R_i - R_{i-1}) * P_i.  Rows are first collapsed per distinct score
    (equal scores form one step), the running sums use the bucketed prefix,
    so no single task sorts the scores.  Returns one row ``avg_prec``."""
    g = (df.select(_known(F.col(score_col)).alias("score"),
                   (F.col(y_col) == F.lit(positive)).cast("long").alias("pos"))
         .groupBy("score").agg(F.sum("pos").alias("tp"), F.count(F.lit(1)).alias("n")))
    bucket = range_bucket(g, "score", nbuckets, descending=True)
    r = prefix_rank(g, bucket, [F.col("score").desc()], measures=["tp", "n"], rank_col=None)
    return r.agg(_safe_div(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.first("total_tp"))
                 .alias("avg_prec"))


def average_precision_ovr(df: DataFrame, y_col: str, score_cols: dict, nbuckets: int = 64) -> DataFrame:
    """One-vs-rest AP for several classes in one pass: ``(name, avg_prec)``
    per class plus ``macro avg``.  ``score_cols`` maps class -> score column.
    Rows become (class, score, positive) triples, are collapsed per distinct
    (class, score), and the running sums restart per class."""
    items = F.array(*[F.struct(F.lit(str(c)).alias("name"), _known(F.col(col)).alias("score"),
                               (F.col(y_col) == F.lit(c)).cast("long").alias("pos"))
                      for c, col in score_cols.items()])
    g = (df.select(F.explode(items).alias("_i")).select("_i.*")
         .groupBy("name", "score").agg(F.sum("pos").alias("tp"), F.count(F.lit(1)).alias("n")))
    bucket = range_bucket(g, "score", nbuckets, descending=True)
    r = prefix_rank(g, bucket, [F.col("score").desc()], measures=["tp", "n"], rank_col=None,
                    partition_cols=["name"])
    from ..session import materialize

    # one row per class, read twice (classes and macro): computed once
    per = materialize(r.groupBy("name").agg(_safe_div(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")),
                                                      F.first("total_tp")).alias("avg_prec")))
    macro = per.agg(F.avg("avg_prec").alias("avg_prec")).withColumn("name", F.lit("macro avg"))
    return per.unionByName(macro)
