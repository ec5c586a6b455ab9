"""String / list-literal helpers (F1-F3, F23) and the stand-in derivations
that turn a text table into records (category, tags, sequence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted_tokens(list_repr) -> Column:
    """every single-quoted token of a Python list repr, ``'(.*?)'``."""
    return F.regexp_extract_all(_col(list_repr), F.lit("'(.*?)'"), 1)


def split_tags(tags) -> Column:
    """space-delimited tags -> array, empties ignored."""
    return F.filter(F.split(_col(tags), " "), lambda t: t != F.lit(""))


def join_tags(tags) -> Column:
    """array -> space-joined string."""
    return F.array_join(_col(tags), " ")


def int_list_literal(s) -> Column:
    """``[1, 2, 3]`` -> array<int>."""
    return F.from_json(_col(s), "array<int>")


def list_repr(arr) -> Column:
    """array<string> -> Python list repr ``['a', 'b']`` (the reference's CSV
    form, read back by :func:`quoted_tokens`)."""
    a = _col(arr)
    return F.when(F.size(a) == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']")))


def to_list_literal(arr) -> Column:
    """array -> JSON list literal."""
    return F.to_json(_col(arr))


# Stand-in derivations used when a text table plays the role of records.
def words(text) -> Column:
    """Lower-case ASCII words: the tag list of a text row."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z]+"), 0)


def letters(text) -> Column:
    """Upper-cased ASCII letters only: the symbol sequence of a text row."""
    return F.upper(F.regexp_replace(_col(text), "[^A-Za-z]", ""))


def has_words(text) -> Column:
    """Same truth value as ``size(words(text)) > 0``, without building the list."""
    return F.coalesce(F.lower(_col(text)).rlike("[a-z]"), F.lit(False))
