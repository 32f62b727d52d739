"""Cutting lineage in storage that all executors share."""

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read from there.

    The folder must be one that every executor reaches, so on a cluster a session
    without the setting is an error.  A session whose driver is its only executor
    (a test) gets a temporary folder.  Spark removes checkpoints that are no longer
    referred to where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint()
