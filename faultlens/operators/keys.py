"""Joins on keys in which NULL is an ordinary value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` that also joins NULL keys with one another, so
    that what was grouped by a key finds its rows again. Spark plans it as the same
    hash or merge join. Keys keep the names and places they have in ``left``; full
    and right joins are not meant."""
    named = {c: f"_same_{c}" for c in on}
    other = right.select(*(F.col(f"`{c}`").alias(named.get(c, c)) for c in right.columns))
    joined = left.join(other, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{s}`")) for c, s in named.items()], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*named.values())
