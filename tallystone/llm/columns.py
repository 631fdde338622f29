"""Column names that can't clash with a table's own, and rows taken out of a table by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import cut

#: Keys to take out are sent to every task up to so many rows (16 bytes each); more of them are met by a shuffle.
BROADCAST_ROWS = 1_000_000


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with its columns but ``keep`` renamed by position."""
    return docs.toDF(*(c if c in keep else f"column_{i}" for i, c in enumerate(docs.columns)))


def restored(rows: DataFrame, docs: DataFrame, *keep: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` from what ``numbered`` gave, under their own names, and those of ``also``."""
    return rows.select(*(F.col(c if c in keep else f"column_{i}").alias(c) for i, c in enumerate(docs.columns)), *also)


def without(rows: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """The rows that meet none of ``gone``, a table of keys; few keys leave the rows where they are."""
    keys = cut(gone.repartition(gone.sparkSession.sparkContext.defaultParallelism))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, "left_anti")
