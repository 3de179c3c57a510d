"""Where results are written that later steps go on from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: spark.checkpoint.dir, or one of this machine in a local run.

    On a cluster without that setting it raises, as executors share no other folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            path = tempfile.mkdtemp(prefix="lodeway-")
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there."""
    folder(df.sparkSession)
    return df.checkpoint()
