"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpoint_dir, components, done, read, remove, spread, tables, written

__all__ = ["checkpoint_dir", "components", "done", "edit_within", "pairs_within", "read", "remove", "spread", "tables", "written"]


def pairs_within(groups: DataFrame, key: str, group: str, out_a: str, out_b: str) -> DataFrame:
    """Every unordered pair of distinct keys of one group, the smaller key first.

    The result itself is quadratic in the group; a group is spread over tasks by the equi-join, which
    adaptive execution splits where one group is hot.
    """
    g = groups.select(F.col(group).alias("g"), F.col(key).alias("k")).where("g is not null and k is not null").distinct()
    return g.alias("l").join(g.alias("r"), F.expr("l.g = r.g and l.k < r.k")).select(
        F.col("l.k").alias(out_a), F.col("r.k").alias(out_b))


def edit_within(x: Column, y: Column, k: int) -> Column:
    """Banded edit distance, at most k (the band of width 2k+1 is the engine's own)."""
    return F.levenshtein(x, y, k) >= 0
