"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from plotlens.plans import registry
from plotlens.plans.views import TABLES

CHECKED = (
    "market_medians", "market_dynamics", "market_dynamics_shrunk", "market_trends", "offer_market", "comparable_levels", "value_by_medians", "nearest_sale",
    "composite_scores", "score_histogram", "duplicate_clusters", "saved_filter_counts", "indexed_filters", "price_history", "daily_windows", "merged_state", "rebuilt_pairs", "text_audit",
    "enrichment", "stored_parcels", "parcel_shapes", "text_values", "ad_pages", "page_details", "plot_numbers", "plot_kinds", "saved_offers", "health_report",
    "usable_spreads", "fitted_curves", "scrubbed_documents", "scrub_residue", "review_pairs", "offers_in_squares", "offers_in_long_zones", "offers_near_diagonals", "asking_spread", "weight_sensitivity", "market_history",
    "keyed_state", "rebuilt_counts", "stored_yearly_medians", "thin_quarters", "imported_sales", "field_misfits",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    places = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in places]) for r in want.fetchall())


def test_entry_and_names(spark):
    assert entry_points.entry(spark).count() >= 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
