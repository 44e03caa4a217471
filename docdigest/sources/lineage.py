"""Cuts of long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's ``spark.checkpoint.dir``: what comes after a loop's round does not depend on executors that had its input.

    A local session without the setting gets a temporary folder; any other is refused, because executors do not share local folders.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not (sc.master or "").startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docdigest-rounds-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
