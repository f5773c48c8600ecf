"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; where it is unset a local session gets a temporary folder, and a cluster an error, as executors would not share one."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="crestline-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ensure_checkpoint_dir settles on, for tables that are kept beside checkpoints."""
    ensure_checkpoint_dir(spark)
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def written(frame: DataFrame) -> DataFrame:
    """frame as a table in that folder, for loops: it is computed once, and unlike a checkpoint it does not carry over what
    the optimizer derived from earlier rounds, which doubles with every self-join.
    """
    path = f"{shared_folder(frame.sparkSession)}/rounds-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
