"""Tables kept in the folder that driver and executors share, for loops that read them again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder of the session and read back: its lineage ends
    there, so a lost executor costs a read. Only a local master may leave the folder unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrasieve-"))
    return df.checkpoint()
