"""Tables written between stages, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode, where one machine does all."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagelens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/pagelens/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
