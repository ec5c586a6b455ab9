"""Column functions: hash draws, vocabulary, arrays, text (FIXTURES X4, X6, X9)."""
import hashlib
import math

from pyspark.sql import functions as F

from seqframe.functions import arrays as A
from seqframe.functions import text as T
from seqframe.functions import vocab as V
from seqframe.functions.random import hash_uniform


def py_u(*parts):
    key = "|".join(str(p) for p in parts)
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2 ** 32


def test_hash_uniform_matches_fixture_and_python(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (5, 3)], "id long, i int")
    got = df.select(hash_uniform(F.lit(7), F.col("id"), F.col("i")).alias("u")).collect()
    assert got[0].u == 0.4169508325867355
    assert got[1].u == 0.1324845878407359
    assert got[2].u == py_u(7, 5, 3)


def test_encode_and_decode(spark):
    df = spark.createDataFrame([("AAC",), ("AX",), ("BZUO",), ("",), ("J",)], "s string")
    ids = [r.ids for r in df.select(V.encode("s").alias("ids")).collect()]
    assert ids == [[1, 1, 2], [1, 21], [21, 21, 21, 21], [], [21]]
    arr = spark.createDataFrame([([22, 1, 21, 22, 5],)], "a array<int>")
    r = arr.select(V.decode_after_start("a").alias("d"), V.decode_after_start("a", compat=True).alias("c"),
                   V.decode_drop_pads(F.array_remove("a", 22)).alias("p"),
                   V.decode_drop_specials("a").alias("s")).first()
    assert (r.d, r.c) == ("AX", "AO")
    assert r.s == "AXF"


def test_strict_encode_raises_on_unknown(spark):
    import pytest

    df = spark.createDataFrame([("AJ",)], "s string")
    with pytest.raises(Exception):
        df.select(V.assert_encoded(V.encode("s", "strict"))).collect()


def test_encode_decode_identity_on_standard_symbols(spark):
    df = spark.createDataFrame([(V.STANDARD,), (V.STANDARD[::-1],)], "s string")
    r = df.select("s", V.decode_ids(V.encode("s")).alias("back")).collect()
    assert all(x.s == x.back for x in r)


def test_collation_arrays(spark):
    df = spark.createDataFrame([([1, 1, 2],), ([1, 21],)], "seq array<int>")
    r = df.select(A.next_token_x("seq", F.lit(3)).alias("x"), A.stop_appended("seq", F.lit(3)).alias("y")).collect()
    assert [x.x for x in r] == [[22, 1, 1, 2], [22, 1, 21, 0]]
    assert [x.y for x in r] == [[1, 1, 2, 22], [1, 21, 22, 0]]
    m = df.select(A.nonzero_mask(A.stop_appended("seq", F.lit(3))).alias("m")).collect()
    assert [x.m for x in m] == [[True] * 4, [True, True, True, False]]


def test_hash_shuffle_is_permutation_and_repeatable(spark):
    df = spark.createDataFrame([(1, list(range(20)))], "id long, a array<int>")
    a = df.select(A.hash_shuffle("a", F.lit(3), F.col("id")).alias("s")).first().s
    b = df.repartition(4).select(A.hash_shuffle("a", F.lit(3), F.col("id")).alias("s")).first().s
    assert sorted(a) == list(range(20)) and a == b and a != list(range(20))


def test_text_helpers(spark):
    df = spark.createDataFrame([("['GO:1', 'GO:2']", "a  b", "Hé llo-World")], "r string, t string, x string")
    r = df.select(T.quoted_tokens("r").alias("q"), T.split_tags("t").alias("s"), T.words("x").alias("w"),
                  T.letters("x").alias("l"), V.spaced(F.lit("ABC")).alias("sp")).first()
    assert r.q == ["GO:1", "GO:2"] and r.s == ["a", "b"]
    assert r.w == ["h", "llo", "world"] and r.l == "HLLOWORLD" and r.sp == "A B C"


def test_list_literals(spark):
    df = spark.createDataFrame([("[1, 2, 3]", ["a", "b"])], "s string, t array<string>")
    r = df.select(T.int_list_literal("s").alias("i"), T.list_repr("t").alias("r")).first()
    assert r.i == [1, 2, 3] and r.r == "['a', 'b']"
    assert df.select(T.quoted_tokens(T.list_repr("t")).alias("b")).first().b == ["a", "b"]


def test_vector_distance(spark):
    from seqframe.functions.vectors import in_ball, l2_distance

    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(l2_distance("a", "b").alias("d"), in_ball("a", F.lit(5.0), "b").alias("inside")).first()
    assert math.isclose(r.d, 5.0) and r.inside is False
