"""In-row array expressions: padding, next-token pairs, masks, reversal,
hash-ordered shuffles (F9, F11-F14, U2).  All run inside one row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .random import hash_order, hash_uniform
from .vocab import PAD, STOP


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_right(arr, length, value: int = PAD) -> Column:
    """right-pad an int array with ``value`` up to ``length``."""
    a = _col(arr)
    n = _col(length) if not isinstance(length, int) else F.lit(length)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0))))


def nonzero_mask(arr) -> Column:
    """Boolean mask ``x != 0``."""
    return F.transform(_col(arr), lambda x: x != F.lit(PAD))


def next_token_x(seq, pad_to) -> Column:
    """F13 input: ``[22] + seq`` padded to ``pad_to + 1``."""
    return pad_right(F.concat(F.array(F.lit(STOP)), _col(seq)), _col(pad_to) + 1)


def stop_appended(seq, pad_to) -> Column:
    """F13 target / F14 sequence: ``seq + [22]`` padded to ``pad_to + 1``."""
    return pad_right(F.concat(_col(seq), F.array(F.lit(STOP))), _col(pad_to) + 1)


def maybe_reverse(arr, *key, p: float = 0.5) -> Column:
    """reverse with probability ``p`` (hash draw over ``key``)."""
    return F.when(hash_uniform(*key) > F.lit(1.0 - p), F.reverse(_col(arr))).otherwise(_col(arr))


def hash_shuffle(arr, *key) -> Column:
    """permute an array by md5 of (key, position) - repeatable."""
    tagged = F.transform(_col(arr), lambda x, i: F.struct(hash_order(*key, i).alias("h"), x.alias("v")))
    return F.transform(F.sort_array(tagged), lambda s: s["v"])


def id_set(arr) -> Column:
    """List -> set of ids minus padding 0 (sorted for a stable form)."""
    return F.array_sort(F.array_remove(F.array_distinct(_col(arr)), PAD))
