"""Reliable checkpoints for operators that go round and round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


#: Rows of a checkpoint file, where the number of rows is known.
FILE_ROWS = 200_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and read it from there.

    A folder is made only where none is set and all runs on one machine. ``rows``, an upper bound of the rows, keeps a
    small table from being written as one file a shuffle partition.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallystone-checkpoints-"))
    return (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).checkpoint(eager=True)
