"""The catalogue of queries: a name, a plan over the tables of a folder, and the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3_600_000_000
#: The events as a timeline, and the embeddings as a 64-channel signal, in SQL.
E = "(SELECT user_id AS session, event_type AS code, epoch_us(ts) AS t, event_id, value, props FROM events)"
S = "(SELECT vec_id AS i, generate_subscripts(embedding, 1) AS ch, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings)"


class Tables:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def timeline(self) -> DataFrame:
        e = self.events
        epoch = "TIMESTAMP_NTZ" if dict(e.dtypes)["ts"] == "timestamp_ntz" else "TIMESTAMP"
        t = F.expr(f"timestampdiff(MICROSECOND, {epoch}'1970-01-01 00:00:00', ts)")
        return e.select(F.col("user_id").alias("session"), F.col("event_type").alias("code"), t.alias("t"), "event_id", "value", "props")

    @property
    def samples(self) -> DataFrame:
        """The signal with all channels of a sample in one row."""
        return self.embeddings.select(F.col("vec_id").alias("i"), F.col("embedding").alias("xs"))

    @property
    def signal(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("i"), "label", F.posexplode("embedding").alias("pos", "x")).select("i", (F.col("pos") + 1).alias("ch"), F.col("x").cast("double").alias("v"), "label")


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return plan

    return add
