"""Seeded, engine-independent randomness.

Every random decision (shuffles, splits, random replies, id bases, draws) is a
pure function of a seed and a key through ``md5``, so reruns, retried tasks and
other engines (any SQL engine with ``md5``) give the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["seeded_md5", "seeded_u32", "seeded_fraction", "seeded_int"]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def seeded_md5(seed, *keys) -> Column:
    """``md5('<seed>:<k1>:<k2>...')`` as a hex string."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def seeded_u32(seed, *keys) -> Column:
    """First 32 bits of the seeded md5 as a non-negative BIGINT."""
    return F.conv(F.substring(seeded_md5(seed, *keys), 1, 8), 16, 10).cast("bigint")


def seeded_fraction(seed, *keys) -> Column:
    """Uniform value in [0, 1) derived from the seeded md5."""
    return seeded_u32(seed, *keys) / F.lit(4294967296.0)


def seeded_int(seed, lo: int, hi: int, *keys) -> Column:
    """Uniform integer in [lo, hi] (both ends included)."""
    return F.lit(lo) + F.pmod(seeded_u32(seed, *keys), F.lit(hi - lo + 1))
