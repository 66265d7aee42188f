"""Tables that a job writes between its steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Spark then removes what a query has shuffled as soon as it has run.
_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset on a master of one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """The same rows, written to the shared folder once, with the lineage cut: what is drawn or numbered stays as it is.

    With ``drop_shuffles``, what was shuffled for them is removed from the disks once they are written.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not drop_shuffles:
        return df.checkpoint()
    before = spark.conf.get(_DROPPED, None)
    spark.conf.set(_DROPPED, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, whose shuffles nothing else reads
    finally:
        spark.conf.unset(_DROPPED) if before is None else spark.conf.set(_DROPPED, before)
