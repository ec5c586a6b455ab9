"""Scores of many runs against one saved reference manifold (C8 over the run registry S13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .manifold import compute_manifold, covered_rows, realism


def score_runs(ref_manifold: DataFrame, runs: DataFrame, k: int = 3, run_col: str = "run", id_col: str = "id",
               vec_col: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``(run, n, precision, recall, realism)``, one row per run.

    ``ref_manifold`` is ``(id, embedding, radius)``, computed once and saved.  The rows of all runs meet it in
    one pass, under a number of their own, since ids repeat from run to run.  Recall asks the balls of each run
    about the reference rows; a run's radii come from its own rows only, so that is done run by run, over the
    run's partition folder (``runs`` as ``read_runs`` gives it).  The driver holds the names of the runs.

    A null run is a run of its own; a run of fewer than k + 2 rows raises, as a manifold of it would; without
    rows there are no runs."""
    own = F.col(run_col)
    rows = materialize(runs.select(own.alias("run"), F.col(vec_col).alias("embedding"), F.monotonically_increasing_id().alias("_row")))
    inside = covered_rows(ref_manifold, rows, id_col="_row", block_rows=block_rows).withColumnRenamed("id", "_row")
    near = realism(ref_manifold, rows, id_col="_row", block_rows=block_rows).withColumnRenamed("id", "_row")
    one = (rows.select("run", "_row").join(inside, "_row").join(near, "_row").groupBy("run")
           .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("double")).alias("precision"),
                F.max("realism").alias("realism")))
    names = [r["run"] for r in rows.select("run").distinct().collect()]
    if not names:
        return one.withColumn("recall", F.lit(None).cast("double")).select("run", "n", "precision", "recall", "realism")

    def recall(name) -> DataFrame:
        balls = compute_manifold(runs.where(own.eqNullSafe(F.lit(name))), k, id_col=id_col, vec_col=vec_col, block_rows=block_rows)
        share = covered_rows(balls, ref_manifold, block_rows=block_rows).agg(F.avg(F.col("covered").cast("double")).alias("recall"))
        return share.select(F.lit(name).cast(rows.schema["run"].dataType).alias("_run"), "recall")

    found = reduce(DataFrame.unionByName, [recall(n) for n in names])
    return (one.join(found, F.col("run").eqNullSafe(F.col("_run")))
            .select("run", "n", "precision", "recall", "realism"))
