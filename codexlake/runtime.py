"""Session-level helpers: table loading, durable checkpoints, run-time size checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and everything runs on this
    machine, as in tests; a cluster without the setting is an error, since a machine-local
    folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    unset = context._jsc.sc().getCheckpointDir().isEmpty()
    if unset and not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if unset:
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"codexlake-checkpoints-{os.getuid()}"))
    return named or context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Unlike a cached or locally checkpointed table, the result survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the checkpoint files of a ``durable`` table that nothing reads any more."""
    plan = df._jdf.queryExecution().logical()
    path = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if path is not None and path.isDefined():
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path.get())
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
