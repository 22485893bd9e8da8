"""Offers that share a bucket of the change detection keep a state each."""

from pyspark.sql import functions as F

from plotlens.streaming import offers as streams

BIG = 2**53 + 1


def test_offers_of_one_bucket(spark, tmp_path):
    schema = "portal string, offer bigint, event_id bigint, t string, price double"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("p", BIG, 1, "2024-01-01", 5.0), ("p", None, 2, "2024-01-01", 1.0), (None, BIG, 3, "2024-01-01", None), ("p", BIG - 1, 4, "2024-01-01", 5.0)],
        [("p", BIG, 6, "2024-01-09", 6.0), ("p", BIG, 5, "2024-01-08", 5.0), (None, BIG, 7, "2024-01-09", None)],
        [("p", BIG, 8, "2024-03-01", 6.0)],
        [("p", None, 9, "2024-03-02", 1.0), ("p", BIG, 10, "2024-03-02", 7.0)],
    ]
    (tmp_path / "in").mkdir()
    stream = streams.detect_changes(spark.readStream.schema("portal string, offer bigint, event_id bigint, ts timestamp, price double").parquet(source), buckets=1)
    for rows in batches:
        spark.createDataFrame(rows, schema).select("portal", "offer", "event_id", F.to_timestamp("t").alias("ts"), "price").coalesce(1).write.mode("append").parquet(source)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(sink).collect()
    got = {r.event_id: (r.portal, r.offer, r.change, r.previous) for r in out if r.event_id}
    assert got[1] == ("p", BIG, "new", None) and got[2] == ("p", None, "new", None) and got[3] == (None, BIG, "new", None) and got[4] == ("p", BIG - 1, "new", None)
    assert got[5] == ("p", BIG, "unchanged", 5.0) and got[6] == ("p", BIG, "changed", 5.0) and got[7][2] == "unchanged"
    assert got[8][2:] == ("unchanged", 6.0) and got[9][2:] == ("reactivated", 1.0) and got[10][2:] == ("changed", 6.0)
    gone = sorted((str(r.portal), str(r.offer)) for r in out if r.change == "expired")
    assert gone == sorted([("p", "None"), ("None", str(BIG)), ("p", str(BIG - 1))])
