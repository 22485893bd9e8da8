"""Alerts of saved filters on a stream of offers, each offer sent at most once to each filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.operators import filter_index
from plotlens.session import staged

LOG = "filter_id bigint, offer_id bigint, place int, send boolean, batch string"


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """What has been marked or sent, by batch; a row without an offer says that its filter has had its first run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LOG).parquet(path) if found else spark.createDataFrame([], LOG)


def sent(spark: SparkSession, path: str) -> DataFrame:
    """``(filter_id, offer_id, batch)`` of all alerts; who delivers them takes a batch at a time."""
    return log_of(spark, path).where("send").select("filter_id", "offer_id", "batch")


def alert_batches(path: str, filters: DataFrame, run: str, most: int = 10) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the alerts of a batch of offers to the log at ``path``.

    A batch matches all ``filters`` (a ``filter_table``) through their index and leaves out what batches before it have
    logged. It writes its own part of the log, named by the stream's ``run`` and its number, so a batch that is run again
    decides from the same log and replaces its own rows: nothing is sent twice, after a restart neither. A filter that
    the log doesn't know is on its first run: what it matches is marked and not sent, and it is known from then on, even
    if it matched nothing. A later run's name must sort behind those before it.
    """

    def write(offers: DataFrame, number: int) -> None:
        spark, batch = offers.sparkSession, f"{run}-{number:010d}"
        before = log_of(spark, path).where(F.col("batch") < batch)
        known = before.groupBy("filter_id").agg(F.lit(False).alias("first_run"))
        table = staged(filters.join(known, "filter_id", "left").fillna(True, ["first_run"]), "alert-filters")
        marks = table.where("first_run").select("filter_id", F.lit(None).cast("bigint").alias("offer_id"), F.lit(None).cast("int").alias("place"), F.lit(False).alias("send"))
        log = before.where("offer_id is not null")
        out = filter_index.matches(offers.dropDuplicates(["offer_id"]), table, log, most).unionByName(marks)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
