"""Streams over the event table, run to their end; their batch twins are the SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.plans.views import table
from plotlens.session import shared_folder
from plotlens.streaming import offers as s

#: Events that a bucket of the change detection is made for, and the fewest buckets.
BUCKET_EVENTS, LEAST_BUCKETS = 8192, 64


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.select(F.col("event_type").alias("portal"), F.col("user_id").alias("offer"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now, into Parquet files of the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plotlens-stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = max(LEAST_BUCKETS, -(-table(spark, sf_dir, "events").count() // BUCKET_EVENTS))
    out = run_to_end(s.detect_changes(_stream(spark, sf_dir), unseen_days=400, buckets=buckets))
    return out.select("event_id", "change", "price", "previous")


def stream_without_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice in, once out."""
    rows = _stream(spark, sf_dir)
    twice = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return run_to_end(s.without_replays(twice)).groupBy("portal").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


QUERIES = {f.__name__: f for f in (stream_changes, stream_without_replays)}

SQL = {
    "stream_changes": """WITH x AS (SELECT event_id, value AS price, lag(value) OVER w AS previous, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN k = 1 THEN 'new' WHEN previous = price THEN 'unchanged' ELSE 'changed' END AS change, price, previous FROM x""",
    "stream_without_replays": "SELECT event_type AS portal, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
}
