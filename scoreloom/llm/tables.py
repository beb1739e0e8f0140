"""Tables between the steps of an operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scoreloom.session import reliable_checkpoints


class Workspace:
    """Parquet tables in the shared folder of checkpoints. A written table cuts the lineage as a checkpoint does, and is compressed."""

    def __init__(self, spark: SparkSession, name: str):
        reliable_checkpoints(spark)
        self._spark = spark
        self._folder = f"{spark._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table. The shuffles that made it are of no more use: a collection in the driver lets Spark's cleaner remove them."""
        path = f"{self._folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self._spark._jvm.System.gc()
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
