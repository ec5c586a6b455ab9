"""Repeatable randomness: every random draw is a hash of row keys.

A draw depends only on (seed, key parts), never on partitioning, task order
or retries, so re-executed tasks and streams reproduce the same values, and
DuckDB can compute the identical number:
``(('0x' || substr(md5(concat_ws('|', ...)), 1, 8))::BIGINT) / 4294967296.0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash_key(*parts) -> Column:
    """``seed|id|i`` style key; ints are rendered in plain decimal."""
    return F.concat_ws("|", *[_c(p).cast("string") for p in parts])


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5 of the joined key."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def hash_order(*parts) -> Column:
    """Order key (hex md5 string); sorts like the uniform but keeps all bits."""
    return F.md5(hash_key(*parts))


def gumbel(*parts) -> Column:
    """Gumbel(0,1) noise from a hash draw, for Gumbel-max sampling."""
    u = hash_uniform(*parts)
    # keep u strictly inside (0,1)
    u = F.least(F.greatest(u, F.lit(1.0 / TWO_POW_32)), F.lit(1.0 - 1.0 / TWO_POW_32))
    return -F.log(-F.log(u))
