"""Land-market views over the star-schema test tables, once for Spark and for any SQL engine.

The texts below are plain SQL in which table names stand in braces; they use integer arithmetic,
CASE and string functions only, so that Spark and the SQL side compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Valuation date of the views: the last shipping date of the test data.
AS_OF = "2001-11-04"

TX = """
SELECT concat_ws('-', cast(l.l_orderkey AS string), cast(l.l_linenumber AS string), cast(l.l_partkey AS string),
                 cast(l.l_suppkey AS string)) AS tx_id,
       concat(lpad(cast(2 * n.n_regionkey + 2 AS string), 2, '0'), lpad(cast(n.n_nationkey + 1 AS string), 2, '0'),
              lpad(cast(c.c_custkey % 8 + 1 AS string), 2, '0'), '_1.', lpad(cast(c.c_custkey % 40 AS string), 4, '0'), '.',
              cast(l.l_partkey AS string)) AS parcel_id,
       cast(l.l_shipdate AS date) AS sale_date,
       cast(floor(l.l_extendedprice * 100) AS bigint) AS price_grosze,
       cast(l.l_quantity * 100 AS int) AS area_m2,
       CASE p.p_type WHEN 'STANDARD' THEN 'budownictwoMieszkanioweJednorodzinne' WHEN 'ECONOMY' THEN 'teren rolniczy'
            WHEN 'MEDIUM' THEN 'terenZabudowyUslugowej' WHEN 'PROMO' THEN 'brakMPZPlubWZ'
            WHEN 'LARGE' THEN 'budownictwoMieszkanioweWielorodzinne' ELSE NULL END AS land_use,
       CASE WHEN l.l_linestatus = 'O' THEN 'gruntyRolne' ELSE 'grunty zabudowane i zurbanizowane' END AS register_use,
       CASE l.l_linenumber WHEN 7 THEN '1/2' WHEN 6 THEN NULL WHEN 5 THEN '1' ELSE '1/1' END AS share,
       CASE WHEN l.l_returnflag = 'R' THEN 'sprzedazPrzetargowa' WHEN l.l_returnflag = 'A' AND l.l_linenumber = 1 THEN NULL
            ELSE 'wolnyRynek' END AS trade,
       'nieruchomoscGruntowaNiezabudowana' AS estate,
       cast((c.c_custkey * 7919) % 100000 AS double) AS e,
       cast((c.c_custkey * 104729) % 100000 AS double) AS n
FROM {lineitem} l
JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {part} p ON p.p_partkey = l.l_partkey
"""

OFFERS = """
SELECT o.o_orderkey AS offer_id,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'alfa' WHEN '2' THEN 'beta' WHEN '3' THEN 'gamma' ELSE 'delta' END AS portal,
       cast(floor(o.o_totalprice * 10) AS bigint) AS price_grosze,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE cast(300 + (o.o_orderkey * 37) % 2700 AS int) END AS area_m2,
       cast(o.o_orderdate AS date) AS first_seen,
       concat(lpad(cast(2 * n.n_regionkey + 2 AS string), 2, '0'), lpad(cast(n.n_nationkey + 1 AS string), 2, '0'),
              lpad(cast(c.c_custkey % 8 + 1 AS string), 2, '0'), '1') AS municipality,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'dzialka budowlana' WHEN 'FURNITURE' THEN 'teren pod uslugi'
            WHEN 'HOUSEHOLD' THEN 'las i laka' WHEN 'MACHINERY' THEN 'teren przemyslowy' ELSE 'pole rolne' END AS purpose,
       cast((c.c_custkey * 7919) % 100000 + o.o_orderkey % 3 * 20 AS double) AS e,
       cast((c.c_custkey * 104729) % 100000 AS double) AS n,
       CASE WHEN o.o_orderkey % 13 = 0 THEN concat('2201', lpad(cast(c.c_custkey % 40 AS string), 4, '0')) ELSE NULL END AS parcel_ref,
       concat('Dzialka ', CASE c.c_custkey % 5 WHEN 0 THEN 'budowlana' WHEN 1 THEN 'rolna' WHEN 2 THEN 'letniskowa' WHEN 3 THEN 'lesna' ELSE 'siedliskowa' END,
              ' Osada', cast(c.c_custkey % 97 AS string)) AS title,
       o.o_orderstatus <> 'P' AS active
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

PLOTS = """
SELECT p_partkey AS offer_id,
       CASE p_partkey % 7 WHEN 0 THEN '12MN/U' WHEN 1 THEN 'ZL' ELSE NULL END AS local_symbol,
       CASE WHEN p_partkey % 7 IN (0, 1, 2) THEN true WHEN p_partkey % 7 = 3 THEN NULL ELSE false END AS local_plan,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 5 <> 1 END AS general_plan,
       CASE p_size % 8 WHEN 0 THEN 'SW' WHEN 1 THEN 'SJ' WHEN 2 THEN 'SZ' WHEN 3 THEN 'SU' WHEN 4 THEN 'SN' ELSE NULL END AS zone,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS infill,
       CASE WHEN p_partkey % 9 = 0 THEN true ELSE NULL END AS permit,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey * 1237) % 160000 END AS utility_cost,
       CASE p_partkey % 6 WHEN 0 THEN NULL ELSE cast(p_partkey % 3 AS int) END AS road,
       CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size * 0.7 END AS frontage,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 0.4 END AS slope,
       CASE WHEN p_size % 9 = 0 THEN NULL ELSE 0.3 + p_size * 0.01 END AS compactness,
       CASE p_partkey % 10 WHEN 0 THEN 'q10' WHEN 1 THEN 'q1' WHEN 2 THEN 'hWZ' WHEN 3 THEN 'q0_2' ELSE NULL END AS flood,
       p_partkey % 8 <> 7 AS flood_checked,
       CASE WHEN p_partkey % 12 = 0 THEN true ELSE NULL END AS protected,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE cast(5 + p_partkey % 60 AS double) END AS travel_min,
       CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE cast((p_partkey * 331) % 25000 AS double) END AS sea_m,
       CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE ((p_partkey * 17) % 40 - 10) / 100.0 END AS price_change,
       cast(400 + (p_partkey * 53) % 3000 AS double) AS area_m2,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE 0.2 + (p_size % 20) * 0.15 END AS intensity,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE cast(15 + p_size AS double) END AS footprint_pct,
       CASE WHEN p_size % 11 = 0 THEN NULL ELSE cast(p_size % 25 AS double) END AS height_m,
       CASE WHEN p_size % 2 = 0 THEN NULL ELSE cast(20 + p_size AS double) END AS green_pct,
       CASE WHEN p_type = 'SMALL' THEN 'grunty lesne' ELSE 'grunty rolne' END AS register_use,
       CASE WHEN p_size % 2 = 0 THEN false ELSE NULL END AS deforestable,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE cast(floor(p_retailprice * 100) * 130 AS bigint) END AS price_grosze
FROM {part}
"""

TARGETS = """
SELECT s_suppkey AS target_id,
       concat(lpad(cast(2 * n.n_regionkey + 2 AS string), 2, '0'), lpad(cast(n.n_nationkey + 1 AS string), 2, '0'),
              lpad(cast(s.s_suppkey % 8 + 1 AS string), 2, '0'), '_1.', lpad(cast(s.s_suppkey % 40 AS string), 4, '0'), '.',
              cast(s.s_suppkey AS string)) AS parcel_id,
       cast(500 + (s.s_suppkey * 97) % 3500 AS double) AS area_m2,
       cast((s.s_suppkey * 7919) % 100000 AS double) AS e,
       cast((s.s_suppkey * 104729) % 100000 AS double) AS n,
       CASE s.s_suppkey % 5 WHEN 0 THEN 'mieszkaniowa_jednorodzinna' WHEN 1 THEN 'rolna' WHEN 2 THEN 'budowlana_wz' WHEN 3 THEN 'lesna'
            ELSE 'uslugowa_produkcyjna' END AS segment,
       DATE '2001-11-04' AS as_of,
       cast(floor(abs(s.s_acctbal) * 1000) AS bigint) AS asking_grosze
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the views above over the tables of ``sf_dir``."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TX)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OFFERS)


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PLOTS)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TARGETS)


def plain(sql: str) -> str:
    """The view for an engine that has the tables under their own names."""
    return sql.format(**{t: t for t in TABLES})


def with_views(sql: str, **views: str) -> str:
    """``sql`` after CTEs of the named views."""
    return "WITH " + ", ".join(f"{name} AS ({plain(text)})" for name, text in views.items()) + ("\n, " if sql.lstrip().startswith("--") else "\n") + sql
