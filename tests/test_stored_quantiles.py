"""Quantiles kept up to date against quantiles of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotlens.operators import stats
from plotlens.operators.stored_quantiles import StoredQuantiles
from plotlens.sources.keyed_table import KeyedTable

QS = [0.25, 0.5, 0.9]


def rows(spark, seed, n, groups="ab"):
    draw = np.random.default_rng(seed)
    values = [(str(draw.choice(list(groups))), float(np.round(draw.normal(10, 20), 1))) for _ in range(n)]
    return spark.createDataFrame([*values, (groups[0], None), (None, 1.0)], "g string, x double")


def listed(df):
    return {r["g"]: (r["n"], [round(x, 9) for x in r["q"]]) for r in df.collect()}


def test_batches_equal_a_full_run(spark, tmp_path, monkeypatch):
    kept = StoredQuantiles(spark, str(tmp_path / "q"), ["g"], QS, buckets=8)
    first, second = rows(spark, 1, 300), rows(spark, 2, 5, "bc")
    full = lambda df: listed(stats.quantiles(df.where("g is not null"), ["g"], "x", QS, "q"))
    kept.add(first, "x", ("day", 1))
    assert listed(kept.read()) == full(first)
    of_a = {r[0] for r in first.where("g = 'a'").select(kept.found.bucket()).distinct().collect()}
    before = kept.found.snapshot()["folders"]

    def stopped(self, *args, **more):
        raise KeyboardInterrupt

    upsert = KeyedTable.upsert
    calls = []
    monkeypatch.setattr(KeyedTable, "upsert", lambda self, *a, **m: stopped(self) if len(calls) else (calls.append(1), upsert(self, *a, **m))[1])
    with pytest.raises(KeyboardInterrupt):
        kept.add(second, "x", ("day", 2))  # stopped after the first table
    monkeypatch.setattr(KeyedTable, "upsert", upsert)
    kept.add(second, "x", ("day", 2))
    assert listed(kept.read()) == full(first.union(second))
    after = kept.found.snapshot()["folders"]
    assert all(before[str(b)] == after[str(b)] for b in of_a)  # no row of the batch is in group a
    kept.add(second, "x", ("day", 2))
    assert listed(kept.read()) == full(first.union(second))
    kept.remove(second.where("g = 'c'"), "x", ("day", 3))
    assert listed(kept.read()) == full(first.union(second.where("g = 'b'")))
    kept.add(first.limit(0), "x", ("day", 4))
    assert listed(kept.read()) == full(first.union(second.where("g = 'b'")))
