"""Lists mapped within their rows (F8, F18, F19): the results of explode, join and regroup, without its shuffles."""
import pytest
from pyspark.sql import functions as F

from seqframe.operators import curate as C
from seqframe.operators import dictionary as D
from seqframe.operators.encode import conditioning_ids, encode_curated

ROWS = [(1, ["b", "x", "a", "b"]), (2, None), (3, []), (4, ["x", "y"]), (5, ["c", None, "a"]), (6, [None])]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(ROWS, "id long, tags array<string>").repartition(3)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("a", 7), ("b", 5), ("c", 9)], "value string, idx int")


def by_id(df, col):
    return sorted((r["id"], r[col]) for r in df.collect())


def explodes(df):
    return "posexplode" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("drop_empty", [True, False])
def test_tags_are_kept_within_rows(lists, words, drop_empty):
    plain = C.keep_tags(lists, "id", "tags", words, drop_empty)
    fast = C.keep_tags(lists, "id", "tags", words, drop_empty, unique_ids=True)
    assert by_id(fast, "tags") == by_id(plain, "tags")
    assert by_id(fast.where("id = 1"), "tags") == [(1, ["b", "a", "b"])]
    assert fast.schema["tags"].dataType == plain.schema["tags"].dataType


def test_lookup_within_rows(lists, words):
    plain = D.lookup(lists, "id", "tags", words, "ids", strict=False)
    fast = D.lookup(lists, "id", "tags", words, "ids", strict=False, unique_ids=True)
    assert by_id(fast, "ids") == by_id(plain, "ids")
    assert fast.columns == plain.columns
    with pytest.raises(Exception, match="unknown dictionary value: x"):
        D.lookup(lists.where("id = 1"), "id", "tags", words, "ids", unique_ids=True).collect()


@pytest.mark.parametrize("drop_untagged", [True, False])
def test_curated_rows_are_encoded_without_shuffling_tags(spark, words, drop_untagged):
    many = spark.range(400).select("id", F.lit("k").alias("category"), F.lit("ACD").alias("sequence"),
                                   F.array_repeat(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")), 50).alias("tags"))
    dic = words.withColumn("kind", F.lit("tag")).unionByName(spark.createDataFrame([("root", 1, "category")], "value string, idx int, kind string"))
    one = [encode_curated(many, "id", "sequence", "category", "tags", dic, shuffle=False, drop_untagged=drop_untagged, unique_ids=u) for u in (False, True)]
    assert by_id(one[1], "conditioning_tags") == by_id(one[0], "conditioning_tags")
    assert [explodes(x) for x in one] == [True, False]


def test_large_or_ambiguous_dictionaries_are_joined(spark, lists, words, monkeypatch):
    assert D.list_mapping(words.unionByName(words)) is None
    monkeypatch.setattr(D, "HELD_VALUES", 2)
    assert D.list_mapping(words) is None
    assert by_id(C.keep_tags(lists, "id", "tags", words, unique_ids=True), "tags") == [(1, ["b", "a", "b"]), (5, ["c", "a"])]
    none = spark.createDataFrame([], words.schema)
    assert by_id(C.keep_tags(lists, "id", "tags", none, drop_empty=False, unique_ids=True), "tags") == [(i, []) for i in range(1, 7)]


def test_unique_ids(spark):
    assert D.has_unique_ids(spark.range(5), "id")
    assert not D.has_unique_ids(spark.createDataFrame([(1,), (1,)], "id long"), "id")
    assert not D.has_unique_ids(spark.createDataFrame([(1,), (None,)], "id long"), "id")


def test_empty_conditioning_gets_the_root(spark):
    rows = spark.createDataFrame([(1, [4, 5]), (2, [])], "id long, tags array<int>")
    out = rows.select("id", conditioning_ids(F.lit(3), F.col("tags"), F.col("id"), F.lit(9), 1.0, 0.0, 1, False).alias("ids"))
    assert by_id(out, "ids") == [(1, [4, 5]), (2, [9])]
