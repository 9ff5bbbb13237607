"""The folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go: spark.checkpoint.dir of the session; one of our own only in local mode, where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()
