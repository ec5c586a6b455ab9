"""Quality rules by distribution divergence, in built-in functions only.

A document is compared to the reference of its language: the histogram of
character classes and that of the language's common words, both taken from
all documents.  The Jensen-Shannon distance of either must stay below a
limit; a document too short for a histogram to mean anything is not judged
by it.  Base rules look at the number of words and at repeated 5-word windows.

Cases: a null or empty text has no words (``base_failed``); every language has
a reference of its own, however rare it is; documents of a null language, or of
one with too little text for a reference, are not judged by distance
(``js_chars`` and ``js_words`` are 0); repeated rows are judged alike; an
empty table gives an empty result; other columns are kept or ignored whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqframe.llm.common import fresh, shared_path, words_of

#: Character classes in order: lower-case letters, what separates words, and these, each of which takes what the earlier ones left;
#: the last takes the rest.
CLASSES = ("[^\\x00-\\x7F]+", "[A-Z]+", "[.,;:!?'\"()-]+", "[0-9]+")
PLAIN = r"[a-z\x20\x09-\x0D]+"
N_CLASSES = len(CLASSES) + 3
#: Fixed value of the contract; none of them is in a class but the last.
SYMBOLS = "[^#*$%&|<>]+"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    #: a common word has this share of its language's words, so there are at most 1 / share of them
    common_share: float = 0.004
    common_words: int = 24
    chars_distance: float = 0.30
    chars_at_least: int = 200
    words_distance: float = 0.52
    words_at_least: int = 40
    #: a reference holds this many times the characters or words that a document must have
    reference_times: int = 25


def _with_classes(df: DataFrame, text: str, word_chars: str, out: str, symbols: str) -> DataFrame:
    """Adds the array of counts by class, and the number of symbols; each step is a projection of its own, so that no replacement runs
    twice, and the first one leaves little to the others."""
    counts, left = [], text
    for i, pattern in enumerate((PLAIN, *CLASSES)):
        rest, n = f"{out}_rest{i}", f"{out}_n{i}"
        df = df.withColumn(rest, F.regexp_replace(F.col(left), pattern, ""))
        df = df.withColumn(n, (F.char_length(left) - F.char_length(rest)).cast("long"))
        if left != text:
            df = df.drop(left)
        counts.append(n)
        left = rest
    spaces = (F.char_length(text) - F.col(word_chars)).cast("long")
    df = df.withColumn(out, F.array(F.col(counts[0]) - spaces, spaces, *counts[1:], F.char_length(left).cast("long")))
    return df.withColumn(symbols, F.char_length(F.regexp_replace(left, SYMBOLS, ""))).drop(*counts, left)


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of two distributions given as equally long lists of shares."""
    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(F.lit(0.0), _total([half(a, b) + half(b, a) for a, b in zip(p, q, strict=True)]) / 2))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row for each language (``ref_lang``): ``ref_words``, ``ref_shares`` (of these words, then of all other words),
    ``ref_classes`` (shares of the character classes); shares are null where a language has too few words or characters."""
    spark = docs.sparkSession
    n, k = N_CLASSES, rules.common_words
    base = docs.select(F.col(lang).cast("string").alias("l"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("l is not null").withColumn("w", words_of("t"))
    base = _with_classes(base.withColumn("wc", F.char_length(F.array_join("w", ""))), "t", "wc", "k", "sy")
    # counts of classes and of all words ride along with the words, under names with a space, which no word has
    item = lambda w, n: F.struct(w.alias("w"), n.cast("long").alias("n"))
    extra = [item(F.lit(f" {i}"), F.col("k")[i]) for i in range(n)] + [item(F.lit(" words"), F.size("w"))]
    base = base.withColumn("lw", words_of(F.lower("t"))).select("l", F.explode(F.concat(F.transform("lw", lambda x: item(x, F.lit(1))), F.array(*extra))).alias("x"))
    # read twice; with the sizes known, Spark picks the kind of join: there is a row of totals for each language, however many there are
    path = shared_path(spark, "language-words")
    base.groupBy("l", F.col("x.w").alias("w")).agg(F.sum("x.n").alias("n")).write.parquet(f"{path}/counts")
    counts = spark.read.schema("l string, w string, n long").parquet(f"{path}/counts")
    totals = counts.where(F.col("w").startswith(" ")).groupBy(F.col("l").alias("l2")).agg(
        *[F.coalesce(F.sum(F.when(F.col("w") == f" {i}", F.col("n"))), F.lit(0)).alias(f"k{i}") for i in range(n)], F.sum(F.when(F.col("w") == " words", F.col("n"))).alias("total"))
    totals.write.parquet(f"{path}/totals")
    totals = spark.read.schema(totals.schema).parquet(f"{path}/totals")

    # a word below the share can't be common: few words of a language are left when those of a language come together
    enough = F.col("total") >= rules.reference_times * rules.words_at_least
    common = counts.where(~F.col("w").startswith(" ")).join(totals.select("l2", "total"), F.col("l") == F.col("l2")).where((F.col("n") >= rules.common_share * F.col("total")) & enough)
    common = (common.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))).where(F.col("r") <= k)
              .groupBy("l").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n", "total"))).alias("c")))
    share = [F.coalesce(F.get("c.n", F.lit(i)) / F.get("c.total", F.lit(0)), F.lit(0.0)) for i in range(k)]
    words = common.select("l", F.col("c.w").alias("ref_words"), F.array(*share).alias("s")).select(
        "l", "ref_words", F.concat("s", F.array(F.lit(1.0) - _total([F.col("s")[i] for i in range(k)]))).alias("ref_shares"))

    whole = _total([F.col(f"k{i}") for i in range(n)])
    classes = totals.select("l2", F.when(whole >= rules.reference_times * rules.chars_at_least, F.array(*[F.col(f"k{i}") / whole for i in range(n)])).alias("ref_classes"), enough.alias("enough"))
    # a language of enough words, none of them common, has shares all the same
    return classes.join(words, F.col("l") == F.col("l2"), "left").select(
        F.col("l2").alias("ref_lang"),
        F.coalesce("ref_words", F.array().cast("array<string>")).alias("ref_words"),
        F.coalesce("ref_shares", F.when(F.col("enough"), F.array(*[F.lit(0.0)] * k, F.lit(1.0)))).alias("ref_shares"), "ref_classes")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules(), verdict: str = "verdict") -> DataFrame:
    """``docs`` with a struct column ``verdict``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, js_chars, js_words, kept."""
    refs = language_references(docs, text, lang, rules)
    t, w, n, h, s, ref, pre, p, k = fresh(docs, "qr_t", "qr_w", "qr_n", "qr_h", "qr_s", "qr_ref", "qr_", "qr_p", "qr_k")
    key = fresh(docs, "qr_l")[0]
    # from a file Spark knows the size, and picks the kind of join by it: there is a row for each language, however many there are
    path = shared_path(docs.sparkSession, "language-references")
    refs.write.parquet(path)
    refs = docs.sparkSession.read.schema(refs.schema).parquet(path)
    refs = refs.select(F.col("ref_lang").alias(f"{ref}_l"), F.struct("ref_words", "ref_shares", "ref_classes").alias(ref))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(key, F.col(lang).cast("string"))
    df = df.join(refs, F.col(key) == F.col(f"{ref}_l"), "left").drop(f"{ref}_l", key)
    df = df.withColumn(w, words_of(F.col(t))).withColumn(n, F.size(w))

    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(f"{pre}lines", lines)
    df = df.withColumn(f"{pre}dup", F.size(f"{pre}lines") - F.size(F.array_distinct(f"{pre}lines"))).drop(f"{pre}lines")

    # repeated windows: hash every window; only a text with equal hashes sorts them to find their positions.  The hashes of the words come
    # out of a generator, or they would be worked out again for every window
    df = df.withColumn(h, F.explode_outer(F.array(F.transform(w, lambda x: F.xxhash64(x)))))
    window = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + j) for j in range(1, rules.window)]))
    df = df.withColumn(f"{h}_w", F.slice(window, F.lit(1), F.greatest(F.size(h) - (rules.window - 1), F.lit(0)))).drop(h).withColumnRenamed(f"{h}_w", h)
    df = df.withColumn(f"{h}_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    pairs = F.zip_with(f"{h}_sorted", F.slice(F.col(f"{h}_sorted"), F.lit(2), F.size(f"{h}_sorted")),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn(f"{h}_at", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    steps = F.zip_with(f"{h}_at", F.slice(F.col(f"{h}_at"), F.lit(2), F.size(f"{h}_at")), lambda a, b: F.least(F.lit(rules.window), b - a))
    df = df.withColumn(f"{pre}rep", F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, x: acc + x), F.lit(0))).drop(h, f"{h}_sorted", f"{h}_at")

    # common words: a letter for each word that may be one by its size, then the letters are counted
    df = df.withColumn(f"{ref}_w", F.struct(F.col(f"{ref}.ref_words").alias("w"), F.array_max(F.transform(f"{ref}.ref_words", lambda x: F.octet_length(x))).alias("longest")))
    df = df.withColumn(f"{ref}_w", F.explode_outer(F.array(f"{ref}_w")))
    letter = lambda x: F.substring(F.lit("_" + LETTERS), F.array_position(F.col(f"{ref}_w.w"), F.lower(x)).cast("int") + 1, F.lit(1))
    # in lower case other letters than ASCII may take fewer bytes
    may_be = lambda x: (F.octet_length(x) <= F.col(f"{ref}_w.longest")) | (F.char_length(x) < F.octet_length(x))
    df = df.withColumn(s, F.array_join(F.transform(F.col(w), lambda x: F.when(may_be(x), letter(x))), "")).drop(f"{ref}_w")
    df = df.withColumn(p, F.array(*[(F.length(s) - F.length(F.replace(F.col(s), F.lit(x), F.lit("")))).cast("long") for x in LETTERS[: rules.common_words]])).drop(s)

    df = df.withColumn(f"{pre}wc", F.char_length(F.array_join(w, ""))).drop(w)
    df = _with_classes(df, t, f"{pre}wc", k, f"{pre}sym")

    chars, many = F.char_length(t), F.col(n)
    own_words = [F.col(p)[i] / F.greatest(many, F.lit(1)) for i in range(rules.common_words)]
    own_words.append(F.greatest(F.lit(0.0), 1 - _total(own_words)))
    own_chars = [F.col(k)[i] / F.greatest(chars, F.lit(1)) for i in range(N_CLASSES)]
    # 0 without a reference, since greatest() passes over nulls
    df = df.withColumn(f"{pre}jc", js_distance(own_chars, [F.col(f"{ref}.ref_classes")[i] for i in range(len(own_chars))]))
    df = df.withColumn(f"{pre}jw", js_distance(own_words, [F.col(f"{ref}.ref_shares")[i] for i in range(len(own_words))]))
    base_failed = (many < rules.min_words) | (100 * F.col(f"{pre}rep").cast("long") > rules.repeat_percent * many.cast("long"))
    odd_chars = F.coalesce((chars >= rules.chars_at_least) & (F.col(f"{pre}jc") > rules.chars_distance), F.lit(False))
    odd_words = F.coalesce((many >= rules.words_at_least) & (F.col(f"{pre}jw") > rules.words_distance), F.lit(False))
    found = F.struct(many.cast("long").alias("n_words"), F.col(f"{pre}wc").cast("long").alias("word_chars"), F.col(f"{pre}sym").cast("long").alias("n_symbols"),
                     F.col(f"{pre}dup").cast("long").alias("n_dup_lines"), F.col(f"{pre}rep").cast("long").alias("n_repeat_words"), base_failed.alias("base_failed"),
                     F.col(f"{pre}jc").alias("js_chars"), F.col(f"{pre}jw").alias("js_words"), (~base_failed & ~odd_chars & ~odd_words).alias("kept"))
    # generated, so that a filter on the verdict is not pushed below and worked out twice
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode_outer(F.array(found)).alias(verdict))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    name = fresh(docs, "verdict")[0]
    return quality_rules(docs, verdict=name, **options).where(F.col(name)["kept"]).drop(name)
