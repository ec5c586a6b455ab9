"""Sources and sinks (S1-S13).  Explicit schemas everywhere, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import int_list_literal, list_repr, quoted_tokens, to_list_literal

ENTRY_SCHEMA = (
    "_id string, name string, "
    "property array<struct<_type: string, _value: string>>, "
    "representativeMember struct<sequence: struct<_VALUE: string, _length: long>>"
)

RECORD_SCHEMA = ("cluster_id string, cluster_name string, cluster_size long, common_taxon string, "
                 "property_tags array<string>, sequence string, sequence_length int")

CSV_RECORD_SCHEMA = ("cluster_id string, cluster_name string, cluster_size long, common_taxon string, "
                     "property_tags string, last_line_num long, sequence string, sequence_length int")

# One set of options for all CSV files with a header: quotes are doubled, and values may hold line breaks.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}

# Property keys that become columns of their own.
POPPED_KEYS = ("member count", "common taxon", "common taxon ID")


def read_entries(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """XML records cut at ``<entry>`` and parsed by Spark's XML source."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(ENTRY_SCHEMA).load(path)


def property_map(prop_col: str = "property", last_wins: bool = True):
    """(type, value) pairs -> map.  ``last_wins`` keeps the last value of a
    repeated key at the key's first-seen position (the reference's dict
    behaviour, Q1).  The fold runs inside the row, no session conf needed."""
    pairs = F.col(prop_col)
    if not last_wins:
        raise ValueError("use property_values(..., last_wins=False) to keep every value")

    def step(acc, p):
        seen = F.map_contains_key(acc, p["_type"])
        replaced = F.transform_values(acc, lambda k, v: F.when(k == p["_type"], p["_value"]).otherwise(v))
        appended = F.map_concat(acc, F.create_map(p["_type"], p["_value"]))
        return F.when(seen, replaced).otherwise(appended)

    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<_type:string,_value:string>>")), empty, step)


def flatten_entries(entries: DataFrame, last_wins: bool = True) -> DataFrame:
    """P1-P4 (+P14 provenance: the file, and the offset of the split that was
    read): nested entry -> flat record row."""
    seq = F.col("representativeMember.sequence")
    props = entries.withColumn("_m", property_map("property"))
    if last_wins:
        rest = F.map_values(F.map_filter("_m", lambda k, v: ~k.isin(*POPPED_KEYS)))
    else:
        rest = F.transform(F.filter("property", lambda p: ~p["_type"].isin(*POPPED_KEYS)), lambda p: p["_value"])
    return props.select(
        F.col("_id").alias("cluster_id"),
        F.col("name").alias("cluster_name"),
        F.col("_m")["member count"].cast("long").alias("cluster_size"),
        F.col("_m")["common taxon"].alias("common_taxon"),
        rest.alias("property_tags"),
        seq["_VALUE"].alias("sequence"),
        seq["_length"].cast("int").alias("sequence_length"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_offset"),
    )


def read_csv_by_name(spark: SparkSession, path: str, schema: str, unnamed_first: str | None = None) -> DataFrame:
    """CSV files with a header, their columns taken by name and cast to the
    schema; raises if one is missing.  ``unnamed_first`` names a first column
    without a name."""
    raw = spark.read.options(**CSV_OPTIONS).csv(path)
    if unnamed_first:
        raw = raw.withColumnRenamed(raw.columns[0], unnamed_first)
    wanted = T.StructType.fromDDL(schema)
    if missing := [f.name for f in wanted if f.name not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def read_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Parallel scan of many part files; CSV carries the list repr of the
    tags (parsed with F1), Parquet the native array."""
    if fmt == "parquet":
        return spark.read.schema(RECORD_SCHEMA).parquet(path)
    raw = read_csv_by_name(spark, path, RECORD_SCHEMA.replace("property_tags array<string>", "property_tags string"))
    return raw.withColumn("property_tags", quoted_tokens("property_tags"))


def read_curated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: CSV whose first (unnamed) column is the saved row index -> ``id``."""
    return read_csv_by_name(spark, path, "id long, " + schema, unnamed_first="id")


def numbered_lines(spark: SparkSession, path: str, number: str = "line") -> DataFrame:
    """Lines of text files with their 1-based number in the order of the files (by name) and within them.

    Files are read in splits as usual.  Lines are counted by split, the counts summed up over the splits before, and
    only then are lines numbered within their split; no task reads more than a split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    in_split = lines.withColumn("_o", F.monotonically_increasing_id())
    per_split = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each split of the files
    before = per_split.select(F.col("_f").alias("_f2"), F.col("_b").alias("_b2"), (F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_o"))
    numbered = in_split.withColumn("_own", own).join(before, (F.col("_f") == F.col("_f2")) & (F.col("_b") == F.col("_b2")))
    return numbered.select("value", (F.col("_before") + F.col("_own")).alias(number))


def read_dictionary(spark: SparkSession, path: str, with_counts: bool | None = None, start: int = 1) -> DataFrame:
    """Headerless dictionary CSV of one column (value) or two (value,
    count): ``(value, count, idx)``, where ``idx`` is the place in the files,
    from ``start`` on.  ``with_counts`` is found out from the first line if it
    is not given; ``count`` is null in files of one column.  A value can't
    hold a line break."""
    lines = numbered_lines(spark, path)
    if with_counts is None:
        first = lines.where("line = 1").select(F.from_csv("value", "a string, b string, c string").alias("v")).select("v.b").first()
        with_counts = first is not None and first[0] is not None
    parsed = F.from_csv("value", "value string, count long" if with_counts else "value string")
    d = lines.select(parsed.alias("v"), (F.col("line") + F.lit(start - 1)).cast("int").alias("idx"))
    return d.select("v.value", (F.col("v.count") if with_counts else F.lit(None).cast("long")).alias("count"), "idx")


def write_records(df: DataFrame, path: str, rows_per_file: int = 100000, fmt: str = "parquet",
                  mode: str = "overwrite") -> None:
    """Chunked part files (``maxRecordsPerFile``); the last chunk is
    whatever remains.  CSV output renders arrays as list literals."""
    w = df.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if fmt == "parquet":
        w.parquet(path)
    else:
        out = df
        for name, typ in df.dtypes:
            if typ == "array<string>":
                out = out.withColumn(name, list_repr(F.col(name)))
            elif typ.startswith("array"):
                out = out.withColumn(name, to_list_literal(F.col(name)))
        out.write.mode(mode).options(**CSV_OPTIONS).option("maxRecordsPerFile", rows_per_file).csv(path)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One output directory per split (``split=train/...``)."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_dictionary(dictionary: DataFrame, path: str, with_counts: bool = True, mode: str = "overwrite") -> None:
    """Headerless dictionary, index order.  The dictionary is already
    aggregated and thresholded (bounded by total/min_count), so one ordered
    file is safe."""
    cols = ["value", "count"] if with_counts else ["value"]
    dictionary.orderBy("idx").select(*cols).coalesce(1).write.mode(mode).option("header", False).csv(path)


# Column names of the generated-pair CSV format, in file order.
PAIR_CSV_SCHEMA = "orig_protein_string string, orig_protein_tags string, gen_protein_string string"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Generated-pair CSV with or without the tags column (null then);
    the int-list literal becomes array<int>."""
    raw = spark.read.options(**CSV_OPTIONS).csv(path)
    tags = int_list_literal("orig_protein_tags") if "orig_protein_tags" in raw.columns else F.lit(None).cast("array<int>")
    return raw.select(F.col("orig_protein_string").alias("orig"), tags.alias("tags"),
                      F.col("gen_protein_string").alias("gen"))


def write_pairs(df: DataFrame, path: str, run_col: str = "run", mode: str = "overwrite") -> None:
    """Pair tables of every run under ``run=<name>`` directories;
    reading the root back gives a ``run`` column with partition pruning."""
    df.write.mode(mode).partitionBy(run_col).parquet(path)


def read_runs(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Run registry by partition discovery; ``run`` filters prune."""
    d = spark.read.parquet(path)
    return d.where(F.col("run") == run) if run is not None else d


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(id long, embedding array<float>)`` Parquet."""
    df.select(F.col("id").cast("long"), F.col("embedding").cast("array<float>")).write.mode(mode).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, embedding array<float>").parquet(path)


def write_manifold(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(id, embedding, radius)``; reused across runs instead of being
    recomputed."""
    df.select("id", "embedding", "radius").write.mode(mode).parquet(path)


def read_manifold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, embedding array<float>, radius double").parquet(path)


def write_metrics(df: DataFrame, path: str, keys=("emb", "pooling", "k", "run"), mode: str = "append") -> None:
    """Metric rows as JSON under key-partitioned folders."""
    df.write.mode(mode).partitionBy(*[k for k in keys if k in df.columns]).json(path)
