"""Symbol vocabulary and the encode / decode column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's token ids).
# pad 0; A 1, C 2, D 3, E 4, F 5, G 6, H 7, I 8, K 9, L 10, M 11, N 12, P 13,
# Q 14, R 15, S 16, T 17, V 18, W 19, Y 20; X 21 and B, Z, U, O also 21;
# start/stop 22; mask 23.
PAD = 0
UNK = 21
STOP = 22
MASK = 23
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "BZUO"
# ---------------------------------------------------------------------------

VOCAB_SIZE = 23  # pad + 20 standard + unknown + start/stop (mask is extra)

SYMBOL_TO_ID = {s: i + 1 for i, s in enumerate(STANDARD)}
SYMBOL_TO_ID["X"] = UNK
for _s in AMBIGUOUS:
    SYMBOL_TO_ID[_s] = UNK

# decode: 21 -> X by default; compat mode reproduces the inverted-dict quirk
ID_TO_SYMBOL = {i + 1: s for i, s in enumerate(STANDARD)}
ID_TO_SYMBOL[UNK] = "X"
ID_TO_SYMBOL_COMPAT = dict(ID_TO_SYMBOL)
ID_TO_SYMBOL_COMPAT[UNK] = "O"

# valid substitutes for random substitution: 20 standard symbols + X
SUBSTITUTES = STANDARD + "X"


def _map_literal(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def symbol_map() -> Column:
    return _map_literal(SYMBOL_TO_ID)


def id_map(compat: bool = False) -> Column:
    return _map_literal(ID_TO_SYMBOL_COMPAT if compat else ID_TO_SYMBOL)


def chars(seq) -> Column:
    """String -> array of single characters (empty string -> empty array)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.filter(F.split(s, ""), lambda c: c != F.lit(""))


def encode(seq, mode: str = "unk") -> Column:
    """Characters -> token ids.  ``unk``: unknown symbols -> 21.
    ``strict``: unknown symbols -> null (``assert_encoded`` raises on them)."""
    m = symbol_map()
    if mode == "unk":
        return F.transform(chars(seq), lambda c: F.coalesce(F.element_at(m, c), F.lit(UNK)))
    if mode == "strict":
        return F.transform(chars(seq), lambda c: F.element_at(m, c))
    raise ValueError(f"unknown encode mode {mode!r}")


def assert_encoded(ids: Column) -> Column:
    """Raise at run time if an id array holds a null (strict-mode miss)."""
    return F.when(F.exists(ids, lambda x: x.isNull()), F.raise_error(F.lit("unknown symbol in sequence"))).otherwise(ids)


def decode_ids(ids: Column, compat: bool = False) -> Column:
    """Ids -> string, symbols only (ids outside 1..21 are skipped)."""
    m = id_map(compat)
    return F.array_join(F.transform(ids, lambda x: F.element_at(m, x)), "")


def _until_stop(ids: Column) -> Column:
    pos = F.array_position(ids, F.lit(STOP))
    return F.when(pos > 0, F.slice(ids, 1, pos - 1)).otherwise(ids)


def decode_after_start(ids: Column, compat: bool = False) -> Column:
    """skip the first (start) token, stop at the first stop token."""
    rest = F.when(F.size(ids) > 1, F.slice(ids, 2, F.size(ids))).otherwise(F.array().cast("array<int>"))
    return decode_ids(_until_stop(rest), compat)


def decode_drop_pads(ids: Column, compat: bool = False) -> Column:
    """stop at the first stop token, drop pads."""
    return decode_ids(F.array_remove(_until_stop(ids), PAD), compat)


def decode_drop_specials(ids: Column, compat: bool = False) -> Column:
    """F8: drop every pad and stop token."""
    return decode_ids(F.filter(ids, lambda x: ~x.isin(PAD, STOP)), compat)


def spaced(seq) -> Column:
    """put a space between characters."""
    return F.array_join(chars(seq), " ")
