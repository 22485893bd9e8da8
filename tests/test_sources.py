"""Readers, page extraction, robots rules and streams on small inline fixtures."""

import json

from pyspark.sql import functions as F

from plotlens.sources import details, pages, registers
from plotlens.streaming import offers as streams

XML = """<FeatureCollection xmlns:ms="x"><ms:member><ms:dzialki><ms:iip_id>1</ms:iip_id><ms:id_dzialki>226101_1.0091.81/23</ms:id_dzialki>
<ms:data_trans>2024-09-09T00:00:00+0</ms:data_trans><ms:dzi_cena_brutto>0</ms:dzi_cena_brutto><ms:tran_cena_brutto>3 874 500</ms:tran_cena_brutto>
<ms:pow_gruntu>151</ms:pow_gruntu><ms:udzial>1/1</ms:udzial><ms:geometria>20 10 20 30 40 30</ms:geometria></ms:dzialki></ms:member></FeatureCollection>"""


def test_sales_from_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    r = registers.read_sales(spark, str(tmp_path / "a.xml")).first()
    assert (r.id_dzialki, str(r.sale_date), r.price_grosze, r.area_m2) == ("226101_1.0091.81/23", "2024-09-09", 387_450_000, 151)
    assert [(p.e, p.n) for p in r.ring] == [(10, 20), (30, 20), (30, 40), (10, 20)]


def test_lookups(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("0\n226101_1.0091.81/23|Gdansk|\n")
    (tmp_path / "none.txt").write_text("-1 brak\n")
    rows = registers.read_lookups(spark, str(tmp_path), ("parcel_id", "name", "region")).collect()
    assert [(r.parcel_id, r.name, r.region) for r in rows] == [("226101_1.0091.81/23", "Gdansk", None)]


def test_embedded_offers(spark):
    tree = {"@graph": [{"@type": "ItemList", "x": [{"@type": ["Offer"], "url": "u1", "price": 5}, {"@type": "Offer", "url": "u1"}, {"@type": "Offer", "url": "u2", "name": "n"}]}]}
    html = f'<html><script type="application/ld+json">{json.dumps(tree)}</script><script type="application/ld+json">broken</script></html>'
    rows = pages.embedded_offers(spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id bigint, html string")).collect()
    assert sorted((r.page_id, r.url) for r in rows) == [(1, "u1"), (1, "u2")]


def test_robots(spark):
    text = ["User-agent: *", "Disallow: /private", "Allow: /private/open*", "", "User-agent: bot", "Disallow: /*.pdf$", "# end"]
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(text)], "site string, line_no int, line string")
    rules = pages.robots_rules(lines)
    urls = spark.createDataFrame([("s", p) for p in ("/private/x", "/private/open/1", "/a.pdf", "/a.pdf?x")] + [("t", "/x")], "site string, path string")
    allowed = lambda agent: {(r.site, r.path): r.allowed for r in pages.admissible(urls, rules, agent).collect()}
    assert allowed("other") == {("s", "/private/x"): False, ("s", "/private/open/1"): True, ("s", "/a.pdf"): True, ("s", "/a.pdf?x"): True, ("t", "/x"): True}
    assert allowed("Bot")["s", "/private/x"] and not allowed("Bot")["s", "/a.pdf"] and allowed("Bot")["s", "/a.pdf?x"]


def test_keyed_state(spark, tmp_path):
    path, other = str(tmp_path / "t"), str(tmp_path / "u")
    write = lambda run: streams.upsert_batches(path, ["k"], "at", run, buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "k int, x string, at int")
    state = lambda p: sorted(tuple(r) for r in streams.latest_state(spark, p, ["k"], "at").collect())
    write("a")(batch([(1, "a", 1), (1, "b", 2)]), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        write("a")(batch([(2, "c", 3)]), 1)
    assert state(path) == [(1, "b", 2), (2, "c", 3)]
    write("b")(batch([(1, "late", 1), (3, "d", 9)]), 0)  # a new checkpoint starts at 0 and keeps what is there
    assert state(path) == [(1, "b", 2), (2, "c", 3), (3, "d", 9)]
    streams.compact(spark, path, other, ["k"], "at")
    assert state(other) == state(path)


def test_expiry_and_late_rows(spark, tmp_path):
    schema = "portal string, offer bigint, event_id bigint, ts timestamp, price double"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    batches = [[("p", 1, 1, "2024-01-01", 5.0)], [("p", 2, 2, "2024-03-01", 7.0)], [("p", 2, 3, "2024-02-29 12:00:00", 9.0), ("p", 1, 4, "2024-03-02", 5.0)], [("p", 2, 5, "2024-03-03", 8.0)]]
    stream = streams.detect_changes(spark.readStream.schema(schema).parquet(source))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "portal string, offer bigint, event_id bigint, t string, price double").select("portal", "offer", "event_id", F.to_timestamp("t").alias("ts"), "price").coalesce(1).write.mode("append").parquet(source)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.offer, r.event_id): r.change for r in spark.read.parquet(sink).collect()}
    assert got[1, 1] == "new" and got[2, 2] == "new" and got[2, 3] == "late" and got[2, 5] == "changed"
    assert got[1, None] == "expired" and got[1, 4] == "reactivated"


def test_centre_of_a_map_in_a_flattened_state(spark):
    page = lambda state: f'<script id="__NUXT_DATA__" type="x">{state}</script>'
    states = [
        '[{"northeast":2},{"center":3,"zoom":5},{"latitude":5,"longitude":6},{"latitude":6,"longitude":7},0,12,54.25,18.5]',  # a corner first
        '[{"center":1,"zoom":0},{"latitude":2,"longitude":3},"54.1",18.2,{"center":5,"zoom":0},{"latitude":3,"longitude":6},50]',  # degrees as text are none
        '[{"center":9,"zoom":0},{"center":true,"zoom":0},{"center":4},0,{"latitude":5,"longitude":5},7]', "[broken", '{"center":1}',
    ]
    rows = spark.createDataFrame([*enumerate(map(page, states)), (9, None)], "page_id bigint, html string")
    got = {r.page_id: (r.lat, r.lon) for r in details.details(rows).collect()}
    assert got == {0: (54.25, 18.5), 1: (18.2, 50.0), **{i: (None, None) for i in (2, 3, 4, 9)}}
