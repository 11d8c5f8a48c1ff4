"""Tables computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Compute df once, in the shared folder of spark.checkpoint.dir, and forget how it was made.

    Only where that is unset and the master is local a folder of our own is used.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="thalweg-"))
    return df.checkpoint(eager=True)
