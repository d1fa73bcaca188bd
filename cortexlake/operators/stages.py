"""Results of a stage written to the folder that the whole cluster shares, so that later stages and lost executors read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session without it gets one in the warehouse, a local one a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cortexlake.stages.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="stages-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        spark.conf.set("cortexlake.stages.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage, and what is read twice is made once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
