"""Where intermediate tables are kept: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The session's shared folder for intermediate tables.

    Where none is named, a temporary one is made on a local master (tests) alone: on a
    cluster a folder of one machine would lose what other machines write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if not own.isEmpty():
        return own.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder, and this is a cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: compressed and by columns, unlike a checkpoint, for what is large.

    The table stays there after the application, as that folder's scratch files do.
    """
    path = f"{scratch_folder(df.sparkSession)}/ledgerline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
