"""Rows of one small file are worked on by all cores."""

from pyspark.sql import functions as F

from plotlens.plans import scoring
from plotlens.session import dealt


def test_rows_of_one_file_are_dealt(spark, sf_dir):
    n = 4 * spark.sparkContext.defaultParallelism
    assert dealt(spark.range(5).coalesce(1), "id").rdd.getNumPartitions() == n
    tasks = scoring._features(spark, sf_dir).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
