"""Tables that are written in batches (a keyed state, a rebuilt table, medians kept up to date), and what was imported."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.functions import price
from plotlens.operators import hierarchy, market, quality
from plotlens.operators.stored_quantiles import StoredQuantiles
from plotlens.plans import views as v
from plotlens.plans.market import SALES, _sales
from plotlens.session import shared_folder, staged
from plotlens.sources.keyed_table import KeyedTable

#: Values that a bucket of the stored medians is made for, and the fewest buckets.
BUCKET_VALUES, LEAST_BUCKETS = 250_000, 16
#: Ends of the first and of the second batch.
CUTS, SALE_CUTS = ("2024-01-11", "2024-01-21"), ("1997-01-01", "2001-07-01")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/plotlens-{name}-{uuid.uuid4().hex}"


def _batches(rows: DataFrame, at: str, cuts: tuple[str, str]) -> list[DataFrame]:
    first, second = (F.lit(c).cast("timestamp") for c in cuts)
    return [rows.where(F.col(at) < first), rows.where((F.col(at) >= first) & (F.col(at) < second)), rows.where(F.col(at) >= second)]


def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each key of the events after three batches, the second given twice: the last row, and the last known value."""
    events = v.table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("known"), F.col("ts").cast("timestamp").alias("ts"))
    table = KeyedTable(spark, _folder(spark, "state"), ["event_type", "user_id"], 16)
    one, two, three = _batches(events, "ts", CUTS)
    for number, batch in ((0, one), (1, two), (1, two), (2, three)):
        table.upsert(batch, at="ts", keep_known=True, run=("events", number))
    return table.read().select("event_type", "user_id", "known", F.col("ts").cast("timestamp_ntz").alias("ts"))


def rebuilt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers by municipality and kind of two runs: rows that the second doesn't renew go, unless somebody has looked at them."""
    offers = v.offers(spark, sf_dir).where("municipality is not null and purpose is not null")
    counts = lambda rows, run: rows.groupBy("municipality", "purpose").agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
    table = KeyedTable(spark, _folder(spark, "counts"), ["municipality", "purpose"], 16)
    table.upsert(counts(offers, 1).withColumn("looked_at", F.when(F.col("n") % 2 == 0, True)))
    table.rebuild(counts(offers.where("offer_id % 3 = 0"), 2), "run", F.lit(2), verdict="looked_at")
    return table.read()


def _buckets_for(values: int) -> int:
    """Buckets that follow the size: one is one task, whose memory must not grow with the table."""
    return max(LEAST_BUCKETS, -(-values // BUCKET_VALUES))


def stored_yearly_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly medians at three levels after three batches of sales, by the state that each batch brings up to date."""
    norm = price.normalised(F.col("price_m2"), F.col("area_m2").cast("double"))
    sales = staged(_sales(spark, sf_dir).select("municipality", "segment", "sale_date", F.year("sale_date").alias("year"), norm.alias("norm")), "yearly-sales")
    rows = hierarchy.at_levels(sales, "municipality")
    kept = StoredQuantiles(spark, _folder(spark, "medians"), ["level", "area", "segment", "year"], [0.5], _buckets_for(len(hierarchy.LEVELS) * sales.count()))
    for number, batch in enumerate(_batches(rows, "sale_date", SALE_CUTS)):
        kept.add(batch, "norm", ("sales", number))
    return kept.read().select("level", "area", "segment", "year", "n", F.round(F.col("q")[0], 6).alias("median"))


def thin_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.skipped_quarters(_sales(spark, sf_dir))


def imported_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.imported(v.transactions(spark, sf_dir))


def field_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose phone was to be stored as a hash, and was not for one in ten, and the length of their documents."""
    customers = v.table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(F.sha2("c_name", 256)).alias("phone_hash"))
    return quality.misfits(customers, hashes=("phone_hash",)).union(quality.misfits(v.table(spark, sf_dir, "documents"), packed=("text",)))


QUERIES = {f.__name__: f for f in (keyed_state, rebuilt_counts, stored_yearly_medians, thin_quarters, imported_sales, field_misfits)}

SQL = {
    "keyed_state": """WITH e AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN value END AS known FROM events)
SELECT event_type, user_id, last(known ORDER BY ts, known) FILTER (WHERE known IS NOT NULL) AS known, max(ts) AS ts
FROM e WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""",
    "rebuilt_counts": f"""WITH offers AS ({v.plain(v.OFFERS)}),
o AS (SELECT municipality, purpose, offer_id FROM offers WHERE municipality IS NOT NULL AND purpose IS NOT NULL),
runs AS (SELECT municipality, purpose, count(*) AS n1, count(*) FILTER (WHERE offer_id % 3 = 0) AS n2 FROM o GROUP BY ALL)
SELECT municipality, purpose, CASE WHEN n2 > 0 THEN n2 ELSE n1 END AS n, CASE WHEN n2 > 0 THEN 2 ELSE 1 END AS run, CASE WHEN n1 % 2 = 0 THEN true END AS looked_at
FROM runs WHERE n2 > 0 OR n1 % 2 = 0""",
    "stored_yearly_medians": f"WITH {SALES} SELECT level, area, segment, year(sale_date)::int AS year, count(*) AS n, round(median(norm), 6) AS median FROM levels WHERE area IS NOT NULL GROUP BY ALL",
    "thin_quarters": f"""WITH {SALES}, q AS (SELECT level, area, date_trunc('quarter', sale_date) AS quarter, count(*) AS n FROM levels WHERE area IS NOT NULL GROUP BY ALL)
SELECT level, area, count(*) AS quarters, count(*) FILTER (WHERE n < 5) AS skipped FROM q GROUP BY ALL""",
    "imported_sales": f"""WITH tx AS ({v.plain(v.TX)}),
m AS (SELECT sale_date, CASE WHEN regexp_matches(parcel_id, '^\\d{{6}}_\\d\\.') THEN substr(parcel_id, 1, 6) || substr(parcel_id, 8, 1) END AS municipality FROM tx),
l AS (SELECT CASE WHEN municipality IS NOT NULL THEN 'gmina' END AS level, municipality AS area, sale_date FROM m UNION ALL
  SELECT 'powiat', substr(municipality, 1, 4), sale_date FROM m WHERE municipality IS NOT NULL UNION ALL
  SELECT 'wojewodztwo', substr(municipality, 1, 2), sale_date FROM m WHERE municipality IS NOT NULL)
SELECT level, area, count(*) AS n, min(sale_date) AS first, max(sale_date) AS last FROM l GROUP BY ALL""",
    "field_misfits": """SELECT 'no_hash' AS rule, 'phone_hash' AS "column", count(*) FILTER (WHERE c_custkey % 10 = 0) AS n FROM customer
UNION ALL SELECT 'too_long', 'text', count(*) FILTER (WHERE length(text) > 2000) FROM documents""",
}
