"""Plans that are computed once although later steps read them several times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def pinned(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder now; Spark deletes them once no plan reads them (if
    spark.cleaner.referenceTracking.cleanCheckpoints is set).

    The folder is the one that spark.checkpoint.dir names; only a local master without one gets a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and re.match(r"local(\[|$)", context.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
