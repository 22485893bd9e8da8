"""The buckets of the stored medians follow the size of the table."""

from plotlens.plans import tables


def test_buckets_follow_the_size(spark, sf_dir, monkeypatch):
    assert tables._buckets_for(0) == 16 and tables._buckets_for(17 * tables.BUCKET_VALUES) == 17
    assert tables._buckets_for(1000 * tables.BUCKET_VALUES + 1) == 1001
    made = []
    monkeypatch.setattr(tables, "BUCKET_VALUES", 100)
    monkeypatch.setattr(tables, "StoredQuantiles", lambda *a: made.append(a[-1]) or (_ for _ in ()).throw(StopIteration))
    try:
        tables.stored_yearly_medians(spark, sf_dir)
    except StopIteration:
        pass
    assert made[0] > 16
