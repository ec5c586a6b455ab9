"""Token-frequency baselines (C7): symbol histogram (A5), unigram fit (A7),
uniform model (A8), corpus cross-entropy and perplexity (A9, F24)."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import PAD, STOP, SYMBOL_TO_ID, UNK, VOCAB_SIZE

ALPHABET = string.ascii_uppercase


#: A string goes to Python in pieces of at most so many code points, and so many pieces are counted at once.
PIECE, PIECES = 1024, 1024


def _count_symbols(batches):
    """Per partition: code-point counts of all strings, by numpy over a bounded number of code points at a time."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, PIECES):
            text = "".join(v for v in batch.column(0).slice(at, PIECES).to_pylist() if v)
            c = np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
            if len(c) > len(total):
                c[:len(total)] += total
                total = c
            else:
                total[:len(c)] += c
    nz = np.nonzero(total)[0]
    yield pa.RecordBatch.from_pydict({"symbol": [chr(int(x)) for x in nz], "count": pa.array(total[nz], pa.int64())}, schema=pa.schema([("symbol", pa.string()), ("count", pa.int64())]))


def symbol_histogram(df: DataFrame, seq_col: str) -> DataFrame:
    """A5: exact ``(symbol, count)`` of every character of a string column.

    Each task counts its rows' code points with vectorised bincounts over
    Arrow batches and emits one row per distinct symbol; the partial counts
    are summed by a (tiny) shuffle.  No per-character rows are created, and
    long strings are cut, so memory doesn't grow with the rows of a batch."""
    pieces = F.explode(F.regexp_extract_all(F.col(seq_col), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    part = df.select(pieces.alias("s")).mapInArrow(_count_symbols, "symbol string, count long")
    return part.groupBy("symbol").agg(F.sum("count").cast("long").alias("count"))


def symbol_histogram_alphabet(df: DataFrame, seq_col: str, alphabet: str = ALPHABET) -> DataFrame:
    """A5, JVM-only variant for a fixed alphabet: per-symbol counts from string
    length differences, summed with one partial aggregation; anything outside
    the alphabet is reported as ``other``."""
    s = F.coalesce(F.col(seq_col), F.lit(""))
    aggs = [F.sum(F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))).alias(f"_c{i}")
            for i, ch in enumerate(alphabet)]
    aggs.append(F.sum(F.length(s)).alias("_len"))
    one = df.agg(*aggs)
    other = F.col("_len") - sum((F.col(f"_c{i}") for i in range(len(alphabet))), F.lit(0))
    pairs = [F.struct(F.lit(ch).alias("symbol"), F.col(f"_c{i}").cast("long").alias("count"))
             for i, ch in enumerate(alphabet)]
    pairs.append(F.struct(F.lit("other").alias("symbol"), other.cast("long").alias("count")))
    return one.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*").where(F.col("count") > 0)


def _symbol_ids(hist: DataFrame, mode: str = "unk") -> DataFrame:
    spark = hist.sparkSession
    rows = [(s, i) for s, i in SYMBOL_TO_ID.items()]
    m = spark.createDataFrame(rows, "symbol string, token_id int")
    j = hist.join(F.broadcast(m), "symbol", "left")
    if mode == "strict":
        j = j.withColumn("token_id", F.when(F.col("token_id").isNull(),
                                            F.raise_error(F.concat(F.lit("unknown symbol "), F.col("symbol"))))
                         .otherwise(F.col("token_id")))
    return j.withColumn("token_id", F.coalesce(F.col("token_id"), F.lit(UNK)))


def target_token_counts(df: DataFrame, seq_col: str, mode: str = "unk") -> DataFrame:
    """``(token_id, count)`` of the next-token targets ``seq + [stop]`` of a
    corpus: symbol counts mapped to ids plus one stop token per row."""
    hist = _symbol_ids(symbol_histogram(df, seq_col), mode)
    sym = hist.groupBy("token_id").agg(F.sum("count").alias("count"))
    stops = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(STOP).alias("token_id"), "count")
    return sym.unionByName(stops).groupBy("token_id").agg(F.sum("count").cast("long").alias("count"))


def array_token_counts(df: DataFrame, ids_col: str) -> DataFrame:
    """A6 / A7 on id arrays (e.g. padded ``y_seq``): explode + count."""
    return (df.select(F.explode_outer(F.col(ids_col)).alias("token_id")).where(F.col("token_id").isNotNull())
            .groupBy("token_id").agg(F.count(F.lit(1)).alias("count")))


def unigram_probs(counts: DataFrame, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Pad count forced to 0, normalised over all other tokens.  The table
    is bounded by the vocabulary, so its normalising window is tiny."""
    spark = counts.sparkSession
    vocab = spark.range(vocab_size).select(F.col("id").cast("int").alias("token_id"))
    c = vocab.join(counts, "token_id", "left").select(
        "token_id", F.when(F.col("token_id") == PAD, 0).otherwise(F.coalesce(F.col("count"), F.lit(0)))
        .cast("double").alias("c"))
    return c.select("token_id", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias("p"))


def uniform_probs(spark, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """1/(V-1) for every non-pad token, 0 for pad."""
    return spark.range(vocab_size).select(
        F.col("id").cast("int").alias("token_id"),
        F.when(F.col("id") == PAD, 0.0).otherwise(1.0 / (vocab_size - 1)).alias("p"))


def cross_entropy(eval_counts: DataFrame, probs: DataFrame, mode: str = "nll") -> DataFrame:
    """A9 + F24: corpus token-weighted loss and ``exp(loss)``, pad ignored.

    ``nll``: -sum c*ln p / sum c (proper).  ``as_logits``: the reference
    feeds probabilities as logits, loss = LSE(p) - p_y (Q5)."""
    return cross_entropies(eval_counts, probs, (mode,))


def cross_entropies(eval_counts: DataFrame, probs: DataFrame, modes=("nll", "as_logits")) -> DataFrame:
    """Several loss modes from one aggregate over the (vocabulary-bounded)
    count table: ``(mode, loss, perplexity)`` rows."""
    pr = probs.withColumn("lse", F.log(F.sum(F.exp("p")).over(Window.partitionBy())))
    ev = eval_counts.where((F.col("token_id") != PAD) & (F.col("count") > 0))
    j = ev.join(F.broadcast(pr), "token_id", "left")
    # an unseen token (or one that the table lacks) has log probability -inf and makes the loss infinite
    p = F.coalesce(F.col("p"), F.lit(0.0))
    minus_inf = F.lit(float("-inf"))
    terms = {"nll": F.when(p > 0, F.log(p)).otherwise(minus_inf),
             "as_logits": p - F.coalesce(F.col("lse"), F.max("lse").over(Window.partitionBy()))}
    for m in modes:
        if m not in terms:
            raise ValueError(m)
    j = j.select("count", *[terms[m].alias(f"_t_{m}") for m in modes])
    one = j.agg(*[(-F.sum(F.col("count") * F.col(f"_t_{m}")) / F.sum("count")).alias(f"_l_{m}") for m in modes])
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"_l_{m}").alias("loss")) for m in modes])
    out = one.select(F.explode(rows).alias("_r")).select("_r.mode", "_r.loss")
    return out.withColumn("perplexity", F.exp("loss"))
