"""Rules on inline rows: what is expected is written out here, not taken from a twin."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marketlens.functions import display, geo, geometry, scoring, text
from marketlens.operators import joins, merge, planning, validity, windows
from marketlens.sources import html, snapshots
from marketlens.streaming import events


def column(spark, rows, schema, c):
    return [r.x for r in spark.createDataFrame(rows, schema).select(c.alias("x")).collect()]


def test_suspicious_prices(spark):
    rows = [(100, 100, 1), (99, 100, 1), (86, 100, 1), (85, 100, 7), (85, 100, 8), (50, 100, None), (None, 100, 1), (10, 0, 1), (0, 100, 1)]
    got = column(spark, rows, "p int, low int, d int", scoring.scam_level(F.col("p"), F.col("low"), F.col("d")))
    assert got == [None, "medium", "medium", "high", "medium", "medium", None, None, None]


def test_kind_of_deal(spark):
    rows = [("sale", 1, []), (None, 2_999_999, ["s"]), (None, 3_000_000, ["s"]), (None, 90_000_000, ["r"]), (None, 4_000_000, []), (None, 5_000_000, []), (None, None, [])]
    c = scoring.deal_of(F.col("e"), F.col("p"), F.col("k"), ("r",), ("s",), 3_000_000, 5_000_000)
    assert column(spark, rows, "e string, p long, k array<string>", c) == ["sale", "rent", "sale", "rent", "rent", "sale", "sale"]


def test_new_buildings(spark):
    rows = [("novostroiki", 1990, None), (None, 2000, None), (None, 1999, None), (None, None, "complex"), (None, None, None)]
    df = spark.createDataFrame(rows, "category string, year_built int, user_type string").withColumns({c: F.lit(None).cast("int") for c in ("floor", "total_floors", "price")} | {"building_type": F.lit(None).cast("string")})
    assert [r.x for r in df.select(scoring.derived(2001)["is_new_building"].alias("x")).collect()] == [1, 1, 0, 1, 0]


def test_names_of_complexes(spark):
    rows = [("ЖК \u201cХан-Тенгри\u201d",), ("Жилой комплекс: Alma/City [2]",), ("мкр. Аксай\u20144",), ("Клубный дом  A.B",), (None,)]
    assert column(spark, rows, "n string", text.complex_name("n")) == ["хан тенгри", "alma city 2", "аксай 4", "a b", None]


def test_points_on_borders(spark):
    ring = "array(named_struct('lat', 0D, 'lon', 0D), named_struct('lat', 0D, 'lon', 2D), named_struct('lat', 2D, 'lon', 2D), named_struct('lat', 2D, 'lon', 0D))"
    rows = [(1.0, 1.0), (0.0, 1.0), (2.0, 1.0), (1.0, 0.0), (1.0, 2.0), (3.0, 1.0)]
    got = column(spark, rows, "lat double, lon double", geo.in_ring(F.col("lat"), F.col("lon"), F.expr(ring)))
    assert got == [True, True, False, True, False, False]  # a ray to greater longitude: south and west borders belong


def test_challenges_are_not_policies(spark):
    rows = [('<p class="g-recaptcha-policy">protected by reCAPTCHA</p>',), ('<div class="g-recaptcha" data-sitekey="x">',), ("Checking your BROWSER",)]
    assert column(spark, rows, "h string", html.is_challenge(F.col("h"))) == [False, True, True]


def test_gaps_within_an_hour(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["2024-01-01 10:02:00", "2024-01-01 10:50:00", "2024-01-01 11:10:00", "2024-01-01 14:00:00"])], "run_id long, t string")
    rows = rows.select("run_id", F.col("t").cast("timestamp_ntz").alias("started_at"), F.col("t").cast("timestamp_ntz").alias("ts"))
    for found in (planning.data_gaps(rows, 0.4), events.gaps(events.slots(rows, 0.4), 0.4)):
        assert sorted((r.gap_end - r.gap_start) // 60_000_000 for r in found.collect()) == [48, 170]


def test_cursors_stop_at_failures(spark):
    rows = [("a", 90, 1, True, 0, False), ("a", 80, 2, False, 3, False), ("a", 70, 3, True, 0, False), ("a", 60, 4, False, 1, False), ("a", 50, 5, True, 0, False)]
    rows += [("b", 9, 1, False, 2, False), ("b", 8, 2, True, 0, False), ("c", 99, 1, False, 1, True), ("c", 7, 2, True, 0, False), ("c", 98, 3, True, 0, True), ("d", 5, 1, None, None, None)]
    visits = spark.createDataFrame(rows, "shard string, id long, visit int, ok boolean, attempts int, fresh boolean")
    assert {r.shard: r.cursor for r in windows.cursors(visits).collect()} == {"a": 70, "c": 7}
    assert windows.cursors(visits.where("false")).count() == 0


def test_ties_are_decided(spark):
    rows = spark.createDataFrame([("k", 1, i) for i in range(9)], "key string, at int, v int")
    assert [r.v for r in merge.keep_last(rows, 2, "at", "key").collect()] == [8, 7]
    stored = spark.createDataFrame([("a", 1, 1)], "key string, at int, v int")
    assert {(r.key, r.v) for r in merge.insert_or_ignore(stored, rows.repartition(3), "key").collect()} == {("a", 1), ("k", 0)}


def test_places_far_and_near(spark):
    points = spark.createDataFrame([(1, 43.2, 76.9), (2, 43.9, 77.9), (3, None, 76.0), (4, 45.0, 70.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([(0, 43.201, 76.9), (0, 43.25, 76.95), (1, 44.5, 79.0)], "kind int, lat double, lon double")
    km = lambda a, b, c, d: spark.range(1).select(F.round(geo.plane_km(*map(F.lit, (a, b, c, d))), 6).alias("x")).first().x
    found = {(r.id, r.kind): r.km for r in joins.nearest_places(points, places).collect()}
    assert set(found) == {(i, k) for i in (1, 2, 4) for k in (0, 1)}
    at = {1: (43.2, 76.9), 2: (43.9, 77.9), 4: (45.0, 70.0)}
    for (i, k), got in found.items():
        assert got == min(km(*at[i], lat, lon) for kind, lat, lon in ((0, 43.201, 76.9), (0, 43.25, 76.95), (1, 44.5, 79.0)) if kind == k)


def test_moments_and_subjects(spark):
    rows = [("2024-01-01T00:00:00",), ("2024-01-01T05:00:00+05:00",), ("2024-01-01T00:00:00Z",), ("soon",), (None,)]
    assert column(spark, rows, "t string", display.moment("t")) == [1704067200, 1704067200, 1704067200, None, None]
    rows = [("10.0.0.1",), ("::ffff:10.0.0.1",), ("2001:DB8::1",), ("1:2:3:4:5:6:7:8",), ("::1",), ("x",)]
    assert column(spark, rows, "i string", display.ip_subject(F.col("i"))) == ["10.0.0.1", "10.0.0.1", "2001:db8:0:0::/64", "1:2:3:4::/64", "0:0:0:0::/64", None]


def test_rings_and_snapshots(spark, tmp_path):
    square = [{"lat": a, "lon": b} for a, b in ((0, 0), (0, 1), (1, 1), (0, 0))]
    doc = json.dumps({"elements": [{"type": "way", "id": 5, "geometry": square, "tags": {"name": "park"}}, {"type": "way", "id": 6, "geometry": square[:2]}, {"type": "node", "id": 7, "lat": 1.0, "lon": 2.0}]})
    out = spark.createDataFrame([(doc,), ("{",), (None,)], "j string").select(geometry.ways(F.col("j")).alias("w"), geometry.points(F.col("j")).alias("p")).collect()
    assert [(w.id, w.name, len(w.ring)) for w in out[0].w] == [(5, "park", 4)] and [p.id for p in out[0].p] == [7]
    assert out[1].w == out[2].w == []
    assert snapshots.read_snapshot(spark, str(tmp_path / "none"), "a int") is None
    assert snapshots.read_snapshot(spark, str(tmp_path / "none"), "a int", "empty").count() == 0
    (tmp_path / "s.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in snapshots.read_snapshot(spark, str(tmp_path / "s.json"), "a int").collect()) == [1, 2]


def test_masks_events_and_phases(spark):
    """Rows written out from the rules: two digits at most are shown, a delisting is silent only if it was noticed late."""
    assert column(spark, [("-100123456789",), ("7",), ("chat",), (None,)], "c string", display.masked(F.col("c"))) == ["***89", "***7", "***", "***"]
    rows = [(100, 90, True, None), (100, 100, True, None), (100, 90, False, 3), (100, 90, False, 8), (100, 100, False, None), (None, 90, True, None)]
    event = display.event_text(F.col("old"), F.col("new"), F.col("active"), F.col("lag"))
    assert column(spark, rows, "old long, new long, active boolean, lag int", event) == ["price 100 -> 90 (-10 %)", None, "off the market", None, "off the market", None]
    names = [("alma city 5",), ("alatau city 2 0",), ("alatau city iv",), ("city 2 3 4",), ("mix",), ("7",), ("alma civic",)]
    assert column(spark, names, "n string", text.without_phase(F.col("n"))) == ["alma city", "alatau city", "alatau city", "city 2", "mix", "7", "alma civic"]


def test_records_of_pages(spark):
    """Attributes in any order and quotes; what scripts, styles and comments hold is no tag; a card without a price stays."""
    page = """<!doctype html><HTML data-x='a > b' lang='kk'><head><meta name=v content="1"><meta content=x charset=utf-8>
    <title> One
    two </title><script>var a = "<p><h1>no</h1>";</script></head><body><!-- <p> --><div id=a class='ad'>Buy</div><h1 class="t">Head <b>line</b></h1>
    <p>x<p lang="a" lang="b">y <a title='q' href='/1'>l</a><a name=n>m</a><A HREF=/2>k</A><div class="ad">Other</div>"""
    out = spark.createDataFrame([(page,), ("",), (None,)], "h string").select(html.typed(F.col("h")).alias("r")).collect()
    r = out[0].r
    assert (r.lang, r.charset, r.title, r.heading, r.paragraphs, list(r.links), r.by_class) == ("kk", "utf-8", "One two", "Head", 2, ["/1", "/2"], {"ad": "Buy", "t": "Head"})
    assert (out[1].r.paragraphs, list(out[1].r.links), out[2].r.paragraphs) == (0, [], None)
    card = '<div class="card" data-id="{0}"><a href="/a/show/{0}">x</a>{1}</div>'
    cards = card.format(111, '<b class="price">45 000 000</b>') + card.format(222, '<b class="price">ask</b>') + card.format(333, "") + '<div class="card" data-id="9"></div>'
    assert column(spark, [(cards,)], "h string", html.card_prices(F.col("h"))) == [{111: 45_000_000, 222: None, 333: None}]


def test_gate_against_history(spark):
    """10.5 is within 0.5 of the best of the last four (10.0), 10.61 isn't; a best of 20 lets pass 21.2; older ones don't count."""
    def ok(value, before):
        new = spark.createDataFrame([(value,)], "mape double")
        return validity.gate_history(new, spark.createDataFrame(list(enumerate(before)), "k int, mape double"), "k").first().ok

    assert ok(10.5, [12.0, 10.0, 11.0, 10.4]) and not ok(10.61, [12.0, 10.0, 11.0, 10.4]) and ok(21.2, [20.0]) and not ok(21.3, [20.0])
    assert ok(10.61, [10.0, 12.0, 11.0, 10.4, 13.0]) and ok(99.0, []) and not ok(None, [10.0])
