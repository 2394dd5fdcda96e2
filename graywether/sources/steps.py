"""Steps of a job that are written as tables in a folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset.

    Unset and on a local master it is below the temporary folder. Unset on a cluster it is below the warehouse, if
    that is no file: path (each machine would write to its own disk); else it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/checkpoints"
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse.rstrip("/") + "/_steps"


class Workspace:
    """Written tables of one run of an operator; a written table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Write df as Parquet and return the table read back; the write's shuffle files go with its end, as nothing reads them
        again."""
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{table}")
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}")

    def drop(self, *tables: str) -> None:
        """Delete tables that nothing later reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
