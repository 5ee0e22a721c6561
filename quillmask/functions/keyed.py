"""Randomness that depends on a key, never on partitioning: the same seed, scope and identity draw the same value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: int, scope: str, *identity: Column, attempt: int = 0) -> Column:
    return F.xxhash64(F.lit(f"{seed}|{scope}|{attempt}"), *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])


def uniform(seed: int, scope: str, *identity: Column, attempt: int = 0) -> Column:
    """In [0, 1)."""
    return F.shiftrightunsigned(key_hash(seed, scope, *identity, attempt=attempt), 11).cast("double") / F.lit(float(1 << 53))


def integer(seed: int, scope: str, low: int | Column, high: int | Column, *identity: Column) -> Column:
    """In low..high."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(uniform(seed, scope, *identity) * (high - low + 1))).cast("long")


def pick(seed: int, scope: str, values: list[str], *identity: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), integer(seed, scope, 0, len(values) - 1, *identity).cast("int"))


def weighted_pick(seed: int, scope: str, values: list[tuple[str, float]], *identity: Column) -> Column:
    total, at = sum(w for _, w in values), 0.0
    u, out = uniform(seed, scope, *identity) * F.lit(float(total)), None
    for value, weight in values[:-1]:
        at += weight
        out = F.when(u < at, value) if out is None else out.when(u < at, value)
    return F.lit(values[-1][0]) if out is None else out.otherwise(values[-1][0])
