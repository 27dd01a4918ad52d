"""Intermediate tables that end a lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df`, checkpointed in the folder that driver and executors share.

    That folder is spark.checkpoint.dir; only a local session that has none gets one of its own, which ends with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if re.match(r"local(\[|$)", context.master) is None:
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="ledgerbeam-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
