"""User-level composite jobs (C1-C12): the reference's scripts as Spark jobs
over DataFrames.  Each takes and returns DataFrames (or writes through the
sinks in ``seqframe.sources``); none collects data to the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import curate as C
from ..operators import manifold as M
from ..operators.batches import assign_batches, collate
from ..operators.dictionary import conditioning_dictionary
from ..operators.encode import encode_curated
from ..operators.knn import class_union, neighbour_votes, predict
from ..operators.metrics import average_precision, classification_report
from ..operators.perturb import mask_schedule, random_mask, random_substitution
from ..operators.pooling import masked_mean_pool, mean_pool, to_vectors
from ..session import materialize, sized
from ..sources import files as S


def ingest_entries(spark: SparkSession, xml_path: str, out_path: str, rows_per_file: int = 100000,
                   last_wins: bool = True) -> DataFrame:
    """XML ``<entry>`` records -> flat records -> chunked Parquet parts."""
    recs = S.flatten_entries(S.read_entries(spark, xml_path), last_wins=last_wins)
    S.write_records(recs, out_path, rows_per_file=rows_per_file)
    return spark.read.parquet(out_path)


def curate_corpus(records: DataFrame, out_path: str, id_col: str = "cluster_id", category_col: str = "common_taxon",
                  tags_col: str = "property_tags", length_col: str | None = None, min_len: int = 50,
                  max_len: int = 256, min_category_count: int = 1000, min_tag_count: int = 1000,
                  drop_wo_tag: bool = True, val_frac: float = 0.1, test_frac: float = 0.1, seed: int = 147,
                  dev_sizes: dict | None = None) -> dict:
    """Length filter, untagged rows dropped, rare categories folded to
    ``root``, tags thresholded and regrouped, seeded exact 80/10/10 split.

    Writes ``splits/split=...`` (S6), ``dev/split=...`` subsets (P10) and the
    two headerless dictionaries (S7) under ``out_path``; returns the curated
    DataFrame and the dictionaries."""
    f = records
    if length_col:
        f = C.length_filter(f, length_col, min_len, max_len)
    f = C.drop_untagged(f, tags_col)
    counts = C.dictionary_counts(f, category_col, tags_col)
    kept = materialize(counts.where(((F.col("kind") == "category") & (F.col("count") >= min_category_count))
                                    | ((F.col("kind") == "tag") & (F.col("count") >= min_tag_count))))
    cats = kept.where(F.col("kind") == "category").select("value", "count")
    tags = kept.where(F.col("kind") == "tag").select("value", "count")
    folded = C.fold_rare(f, category_col, cats)
    cur = C.keep_tags(folded, id_col, tags_col, tags, drop_empty=drop_wo_tag, out_col="tags")
    # the ids are read for the cut keys, the rows once to be written
    sizes = dev_sizes or {"train": 10000, "val": 5000, "test": 5000}
    split = C.split_by_keys(materialize(cur), id_col, seed, val_frac, test_frac, sizes)
    S.write_splits(split, os.path.join(out_path, "splits"))
    written = split.sparkSession.read.parquet(os.path.join(out_path, "splits"))
    S.write_splits(written.where("dev").drop("dev"), os.path.join(out_path, "dev"))
    written = written.drop("dev")
    dic = materialize(conditioning_dictionary(cats, tags))
    S.write_dictionary(dic.where(F.col("kind") == "category"), os.path.join(out_path, "included_categories"),
                       with_counts=False)
    S.write_dictionary(dic.where(F.col("kind") == "tag"), os.path.join(out_path, "included_tags"))
    return {"curated": written, "dictionary": dic, "categories": cats, "tags": tags}


def profile_corpus(records: DataFrame, length_col: str, category_col: str, tags_col: str, seq_col: str,
                   min_len: int = 50, max_len: int = 256, bin_width: int = 50) -> dict:
    """Length distribution (all / short), category and tag counts after
    the length filter, symbol histogram of the sequences."""
    from ..operators.ranking import exact_quantiles

    f = C.length_filter(records, length_col, min_len, max_len)
    hist = records.groupBy((F.floor(F.col(length_col) / bin_width) * bin_width).cast("long").alias("bin_start")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return {
        "length_histogram": hist,
        "length_quantiles": exact_quantiles(records, length_col, [0.1, 0.25, 0.5, 0.75, 0.9]),
        "category_counts": C.value_counts(f, category_col),
        "tag_counts": C.occurrence_counts(C.drop_untagged(f, tags_col), tags_col),
        "symbols": B.symbol_histogram(f, seq_col),
    }


def encode_corpus_job(curated: DataFrame, dictionary: DataFrame, id_col: str, seq_col: str, category_col: str,
                      tags_col: str, **kw) -> DataFrame:
    """C4: token ids and conditioning ids for every curated row."""
    return encode_curated(curated, id_col, seq_col, category_col, tags_col, dictionary, **kw)


def make_batches(encoded: DataFrame, batch_size: int = 64, mode: str = "next_token", seed: int = 0,
                 epoch: int = 0) -> DataFrame:
    """Per-epoch seeded shuffle, consecutive batches, padded collation."""
    return collate(assign_batches(encoded, "id", batch_size, seed, epoch), "batch_id", mode=mode)


def random_substitution_runs(sequences: DataFrame, out_path: str, percent: float = 0.1, replicates: int = 1,
                             seed: int = 0, id_col: str = "id", seq_col: str = "sequence") -> DataFrame:
    """Substitution replicates written as ``run=rand_<pct>_<r>`` pair tables."""
    subs = random_substitution(sequences, id_col, seq_col, percent, replicates, seed)
    runs = subs.withColumn("run", F.concat(F.lit(f"rand_{int(round(percent * 100))}_"),
                                           F.col("replicate").cast("string")))
    S.write_pairs(runs, out_path)
    return S.read_runs(sequences.sparkSession, out_path)


def token_baseline(train: DataFrame, test: DataFrame, seq_col: str = "sequence", kind: str = "empirical",
                   modes=("nll", "as_logits")) -> DataFrame:
    """Uniform or empirical (unigram) token model scored on ``test``."""
    test_counts = materialize(B.target_token_counts(test, seq_col))
    if kind == "uniform":
        probs = B.uniform_probs(train.sparkSession)
    else:
        probs = B.unigram_probs(materialize(B.target_token_counts(train, seq_col)))
    return B.cross_entropies(test_counts, probs, modes)


def manifold_pr(reference: DataFrame, subject: DataFrame, k: int = 3, reference_manifold: DataFrame | None = None,
                align_key: str | None = None) -> DataFrame:
    """Precision, recall and realism of ``subject`` against ``reference``.
    Pass a saved ``reference_manifold`` (S11) to skip recomputing it."""
    mr = reference_manifold if reference_manifold is not None else M.compute_manifold(reference, k)
    ms = M.compute_manifold(subject, k)
    pr = M.precision_recall(mr, ms)
    if align_key:
        re = M.realism_aligned(mr.join(reference.select("id", align_key), "id"), subject, align_key, align_key)
    else:
        re = M.realism(mr, subject).agg(F.max("realism").alias("realism"))
    return pr.unionByName(re.select(F.lit(None).cast("double").alias("precision"),
                                    F.lit(None).cast("double").alias("recall"), "realism"),
                          allowMissingColumns=True).agg(F.max("precision").alias("precision"),
                                                        F.max("recall").alias("recall"),
                                                        F.max("realism").alias("realism"))


def class_index(pairs: DataFrame, tag_ids, id_col: str = "id", tags_col: str = "tags") -> DataFrame:
    """``(class_id, id)`` rows whose tag-id set contains each class id.
    ``tag_ids``: numbers, or a DataFrame with a column ``class_id``."""
    from ..functions.arrays import id_set

    spark = pairs.sparkSession
    classes = sized(tag_ids) if isinstance(tag_ids, DataFrame) else spark.createDataFrame([(int(t),) for t in tag_ids], "class_id int")
    ids = (pairs.select(F.col(id_col), F.explode_outer(id_set(tags_col)).alias("class_id"))
           .where(F.col("class_id").isNotNull()))
    return ids.join(classes, "class_id")


def knn_two_class(reference: DataFrame, subject: DataFrame, class0_ids: DataFrame, class1_ids: DataFrame,
                  k: int = 5, weights: str = "uniform") -> dict:
    """Fit on the labelled reference rows, predict the same rows of
    ``subject``; returns the report and the average precisions."""
    lab = class_union(reference.join(class0_ids, "id", "left_semi"), reference.join(class1_ids, "id", "left_semi"))
    ev = class_union(subject.join(class0_ids, "id", "left_semi"), subject.join(class1_ids, "id", "left_semi"))
    votes = predict(neighbour_votes(subject.select("id", "embedding"), lab, k=k, weights=weights))
    rows = materialize(ev.select("id", "y").join(votes, "id"))
    report = classification_report(rows, "y", "pred")
    aps = [average_precision(rows.select("y", F.col(f"p{c}").alias("score")), "y", "score", positive=c)
           .withColumn("name", F.lit(str(c))) for c in (0, 1)]
    ap = aps[0].unionByName(aps[1])
    ap = ap.unionByName(ap.agg(F.avg("avg_prec").alias("avg_prec")).withColumn("name", F.lit("macro avg")))
    return {"report": report, "average_precision": ap}


def pool_embeddings(token_vectors: DataFrame, group_col: str, vec_col: str, how: str = "masked_mean",
                    mask_col: str | None = None) -> DataFrame:
    """C11: mean or masked mean of token vectors per row -> ``(group, embedding)``."""
    pooled = (masked_mean_pool(token_vectors, group_col, vec_col, mask_col) if how == "masked_mean"
              else mean_pool(token_vectors, group_col, vec_col))
    return to_vectors(pooled, group_col)


def mask_corpus(encoded: DataFrame, ids_col: str = "sequence", floor: float | None = 0.05, p: float | None = None,
                steps: int | None = None, min_p: float = 0.0, seed: int = 0) -> DataFrame:
    """Random masking with a per-row rate, a given rate, or a schedule."""
    if steps:
        return mask_schedule(encoded, "id", ids_col, steps=steps, min_p=min_p, seed=seed)
    return random_mask(encoded, "id", ids_col, seed=seed, p=p, floor=floor if floor is not None else 0.0)




def embed_pairs(pairs: DataFrame, make_model, dim: int, use_generated: bool = True, spaced_input: bool = True,
                id_col: str = "id", batch_size: int = 32, cap: int | None = None) -> DataFrame:
    """C11: pick the generated or the original string of a pair table (P12),
    optionally put spaces between characters (F4), keep the first ``cap``
    rows by id when asked (P11, the cap is the feature), and run the user's
    model in Arrow batches on the executors (X4).  Returns ``(id, embedding)``."""
    from ..functions.vocab import spaced
    from ..operators.pooling import embed

    col = "gen" if use_generated else "orig"
    d = pairs.select(F.col(id_col).alias("id"), F.col(col).alias("_s"))
    if cap is not None:
        d = d.orderBy("id").limit(cap)
    if spaced_input:
        d = d.withColumn("_s", spaced(F.col("_s")))
    return embed(d, "_s", make_model, dim=dim, batch_size=batch_size).select("id", "embedding")
