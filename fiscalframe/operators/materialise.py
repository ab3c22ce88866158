"""Computing a table once for several outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialise(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the cluster's checkpoint folder.

    For results that several outputs are written from: extraction then runs
    once, and a lost executor costs no recomputation.  The folder is that of
    spark.checkpoint.dir, or of the warehouse where that is unset.  Spark deletes
    the files when the table is no longer referred to, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as ``session.SETTINGS`` do.
    """
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None) or session.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        session.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
