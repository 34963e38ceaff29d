"""Joins of a large table with one row per key, where a key may hold any share of the large table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.storage import Workspace

#: Rows of a small side that are broadcast; beyond it the join is a shuffle with hot keys apart.
BROADCAST_ROWS = 50_000


def partitions_of(df: DataFrame) -> int:
    """The partitions of a shuffle of this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def counted(big: DataFrame, on: str | list[str]) -> DataFrame:
    """(on, size): the rows of each key, with partial sums."""
    on = [on] if isinstance(on, str) else on
    return big.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("size"))


def lookup_hot(big: DataFrame, small: DataFrame, on: str | list[str]) -> DataFrame:
    """Inner join of `big` with the one row that `small` has for each key; `size` of `small` says how many rows of `big` the key has.

    A key is hot if it holds more rows than an even share of a partition, so there are no more hot keys than
    partitions: their rows of `small` are broadcast, whatever the sizes of the tables, and only the other
    rows are shuffled. `big` is read three times: pass a written table. Null keys match nothing.
    """
    share = big.agg((F.count(F.lit(1)) / F.lit(partitions_of(big))).alias("n")).scalar()
    is_hot = F.col("size") > share
    hot = F.broadcast(small.where(is_hot).drop("size"))
    cold = big.join(F.broadcast(small.where(is_hot).select(*([on] if isinstance(on, str) else on))), on, "left_anti")
    return cold.join(small.where(~is_hot).drop("size"), on).unionByName(big.join(hot, on))


def lookup(big: DataFrame, small: DataFrame, on: str | list[str], written: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join with the one row of each key: broadcast after a check of its rows, else `lookup_hot`.

    For the latter `big` is written first, unless it is a table already (`written`).
    """
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), on)
    if not written:
        big = Workspace(big.sparkSession, "lookup").cut(big, "big")
    return lookup_hot(big, small.join(counted(big, on), on), on)
