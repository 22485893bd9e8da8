"""Streams of offer observations: change detection with keyed state, windows, replay-safe loads, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "portal string, offer bigint, event_id bigint, ts timestamp, change string, price double, previous double"
#: The state of a bucket of offers: a list for each field.
BUCKET = "portal array<string>, offer array<string>, price array<double>, seen array<bigint>, active array<boolean>, expires array<bigint>"


def detect_changes(observations: DataFrame, unseen_days: int = 14, late: str = "1 day", buckets: int = 64) -> DataFrame:
    """Each observation as ``new``, ``changed``, ``unchanged`` or ``reactivated``, and ``expired`` for offers unseen too long.

    Reads ``portal, offer, event_id, ts, price``. The state of an offer is its last price and time.
    Rows of a batch are taken in event order; one older than the state is ``late`` and changes
    nothing. Expiry goes by event time, once the watermark has passed the last sight by so many days.

    Offers are kept in ``buckets`` by hash, as a call of Python for each costs far more than its rows. A task holds a
    bucket's state and its rows of a batch, so the number must follow the size; a checkpoint goes on with the one that it began with.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(p, o): r for p, o, *r in zip(*state.get)} if state.exists else {}
        watermark, out, met = state.getCurrentWatermarkMs(), [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            times = rows["ts"].astype("datetime64[ns]").astype("int64") // 1000
            for portal, offer, event, ts, at, cost in zip(rows["portal"], rows["offer"], rows["event_id"], rows["ts"], times.tolist(), rows["price"].tolist()):
                price, seen, active, _ = held.get((portal, offer), (None, None, True, None))
                if seen is not None and at < seen:
                    change = "late"
                elif seen is None:
                    change = "new"
                elif not active:
                    change = "reactivated"
                else:
                    change = "unchanged" if price == cost or (pd.isna(price) and pd.isna(cost)) else "changed"
                out.append((portal, offer, event, ts, change, cost, None if change == "new" else price))
                if change != "late":
                    price, seen, active = cost, at, True
                held[portal, offer] = price, seen, active, max(seen // 1000 + unseen_days * 86_400_000, watermark + 1)
                met.add((portal, offer))
        for (portal, offer), (price, seen, active, expires) in held.items():
            if active and expires < watermark and (portal, offer) not in met:
                out.append((portal, offer, None, pd.Timestamp(seen, unit="us"), "expired", price, price))
                held[portal, offer] = price, seen, False, expires
        state.update(tuple(map(list, zip(*[(*k, *v) for k, v in held.items()]))))
        if due := [expires for _, _, active, expires in held.values() if active]:
            state.setTimeoutTimestamp(max(min(due), watermark + 1))
        found = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])
        yield found.assign(offer=pd.array([None if o is None else int(o) for o in found["offer"]], "Int64"), event_id=found["event_id"].astype("Int64"))

    rows = observations.withWatermark("ts", late).withColumn("offer", F.col("offer").cast("string"))  # as text: a number beside a null would lose digits
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("portal", "offer"), F.lit(buckets))).groupBy("bucket")
    return keyed.applyInPandasWithState(update, CHANGES, BUCKET, "append", GroupStateTimeout.EventTimeTimeout)


def sliding_counts(observations: DataFrame, late: str = "1 day", width: str = "7 days", step: str = "1 day") -> DataFrame:
    """New observations of each portal in sliding windows of event time."""
    return observations.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "portal").agg(F.count("*").alias("n"))


def without_replays(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often its source sends it again within the watermark."""
    return observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sold_within(offers: DataFrame, sales: DataFrame, days: int = 200) -> DataFrame:
    """Offers with the later sale of their plot, as a join of two streams within an interval of event time."""
    a = offers.withWatermark("first_seen", "1 day").alias("a")
    b = sales.withWatermark("sold_at", "1 day").alias("b")
    return a.join(b, F.expr(f"a.parcel_ref = b.parcel_ref AND b.sold_at > a.first_seen AND b.sold_at <= a.first_seen + INTERVAL {days} DAYS"))


def upsert_batches(path: str, keys: list[str], at: str, run: str, buckets: int = 64):
    """A ``foreachBatch`` function that keeps the latest row of each key in a table that only grows.

    A batch appends its own latest rows, dealt into ``buckets`` by key, under the name of the stream's
    ``run`` and its number; nothing that is there is read or written again, and a batch that is run
    again replaces its own rows only. ``latest_state`` reads the table, ``compact`` makes it small.
    """

    def write(batch: DataFrame, number: int) -> None:
        dealt = _latest(batch, keys, at).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={run}-{number:010d}")

    return write


def _latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*")


def latest_state(spark: SparkSession, path: str, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key over all batches of all runs."""
    rows = spark.read.parquet(path)
    return _latest(rows.drop("batch", "bucket"), keys, at)


def compact(spark: SparkSession, path: str, into: str, keys: list[str], at: str, buckets: int = 64) -> None:
    """Write the state as the one batch of a new table, which later runs go on with."""
    dealt = latest_state(spark, path, keys, at).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{into}/batch=compact-{0:010d}")
