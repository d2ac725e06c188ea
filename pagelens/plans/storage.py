"""Tables written between the rounds of iterative plans, where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; without that setting a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagelens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut, lost executors do no harm."""
    path = f"{shared_folder(df.sparkSession)}/pagelens/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Buckets:
    """Tables in the shared folder that are bucketed alike by the same columns, so that joins on these need no shuffle; close() takes them out of the catalogue."""

    def __init__(self, spark: SparkSession, *columns: str) -> None:
        self.spark, self.columns, self.names = spark, columns, []
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, spread: bool = True) -> DataFrame:
        """df as such a table; with spread it is dealt by the columns first, which what comes from a join of these tables is already."""
        name = f"pagelens_{uuid.uuid4().hex}"
        rows = df.repartition(self.count, *self.columns) if spread else df
        rows.write.format("parquet").bucketBy(self.count, *self.columns).option("path", f"{shared_folder(self.spark)}/pagelens/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """The tables' files stay, so what has been read from them can still be computed."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        self.names.clear()
