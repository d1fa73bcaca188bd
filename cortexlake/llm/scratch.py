"""Intermediate tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of this session, for clear().
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cortexlake.scratch.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = tempfile.mkdtemp(prefix="cortexlake-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("cortexlake.scratch.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this session has written; results that were made from them must have been written before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        where.getFileSystem(conf).delete(where, True)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, written, with a number of its own for each row in ``_row``; ids may be null or repeat."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
