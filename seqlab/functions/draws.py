"""Repeatable randomness: every draw is a function of ids and a seed, so retried tasks agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = float(1 << 48)


def draw_key(seed: int, *parts: Column) -> Column:
    """md5 of the seed and ids: a sort key that is the same in every engine and on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of :func:`draw_key`."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 12), 16, 10).cast("double") / UNIT


def hash_bucket(key: Column) -> Column:
    """The first three hex digits: 4096 even slices of the key order."""
    return F.substring(key, 1, 3)
