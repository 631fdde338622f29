"""Reliable checkpoints in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a checkpoint file, where the number of rows is known.
FILE_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; a local one is made only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallystone-checkpoints-"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    ``rows``, an upper bound of its rows, keeps a small table from being written as one file a shuffle partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a folder, not made yet, inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it from there, columns as needed."""
    path = f"{new_folder(df.sparkSession, 'tables')}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
