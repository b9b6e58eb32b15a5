"""Edge cases of the operators on tiny frames: empty tables, nulls, ties and exact bounds."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marketlens.functions import geo, text
from marketlens.operators import asof, filters, joins, merge, quantiles, stats, validity, windows
from marketlens.sources import html, snapshots
from marketlens.streaming import events

MARKET = "id long, price long, area double, rooms int, district string, category string, is_active int"


@pytest.fixture(scope="module")
def market(spark):
    rows = [(i, 50_000_000 + i * 1_000_000, 50.0 + i, 1 + i % 3, "ab"[i % 2], "novostroiki" if i % 2 else None, 1) for i in range(10)]
    return spark.createDataFrame(rows, MARKET)


def test_market_fixture(market):
    assert stats.totals(market).first().total == 10
    assert {r.district for r in stats.by_group(market, "district").collect()} == {"a", "b"}
    assert sum(r.n for r in stats.price_histogram(market).collect()) == 10
    bins = stats.unit_price_histogram(market).collect()
    assert len(bins) == 38 and sum(r.n for r in bins) == 10
    assert {r.kind: r.n for r in stats.category_split(market).collect()} == {"new": 5, "other": 5}


def test_empty_market(spark):
    empty = spark.createDataFrame([], MARKET)
    assert stats.totals(empty).first().asDict() == {"total": 0, "median_price": 0, "median_ppsm": 0}
    assert stats.by_group(empty, "district").count() == 0
    assert sum(r.n for r in stats.price_histogram(empty).collect()) == 0
    assert stats.unit_price_histogram(empty).count() == 0


def test_histogram_bounds(spark):
    rows = spark.createDataFrame([(1, 20_000_000, 50.0, 1, "a", None, 1), (2, 10_000_000_000, 50.0, 1, "a", None, 1)], MARKET)
    counts = {r.low: r.n for r in stats.price_histogram(rows).collect()}
    assert counts[20] == 1 and sum(counts.values()) == 1  # left-closed; the last edge and beyond are dropped


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1001])
def test_exact_medians_equal_the_built_in(spark, n):
    rows = spark.range(n).selectExpr("if(id % 3 = 0, null, id % 2) as k", "hash(id) % 500 as v").unionByName(spark.range(n).selectExpr("7 as k", "5 as v"))
    for accuracy in (10, 100):
        got = {r.k: (r.n, r.median) for r in quantiles.exact_medians(rows, ("k",), "v", accuracy).collect()}
        assert got == {r.k: (r.n, r.m) for r in rows.groupBy("k").agg(F.count("v").alias("n"), F.median("v").alias("m")).collect()}


def test_exact_medians_when_sketches_come_out_different(spark, monkeypatch):
    """A sketch made anew may have other bounds; some made here hold the median and some don't."""
    import random

    real = F.percentile_approx
    shifted = F.udf(lambda q, by: [x + random.randint(-by, by) for x in q] if q else q, "array<double>").asNondeterministic()
    rows = spark.range(2001).selectExpr("id % 2 as k", "cast((id * 7919) % 2001 as double) as v")
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    for by in (100, 100, 900, 900):
        monkeypatch.setattr(F, "percentile_approx", lambda c, p, a, by=by: shifted(real(c, p, a), F.lit(by)))
        assert {r.k: r.median for r in quantiles.exact_medians(rows, ("k",), "v", 20).collect()} == want


def test_quantiles_between_equal_values_are_the_value(spark, monkeypatch):
    from marketlens.operators import windows

    monkeypatch.setattr(quantiles, "ONE_TASK", -1)
    n, v = 3, 27 / 7
    part = (n - 1) * 0.2 % 1
    assert v * (1 - part) + v * part < v
    assert {r.quintile for r in windows.quintiles(spark.createDataFrame([(v,)] * n, "v double"), "v").collect()} == {1}


def test_flat_unit_prices(spark):
    rows = spark.createDataFrame([(i, 100_000, 50.0, 1, "a", None, 1) for i in range(3)], MARKET)
    assert sum(r.n for r in stats.unit_price_histogram(rows).collect()) == 3


def test_heatmap(spark):
    schema = "price long, area double, lat double, lon double, is_active int"
    rows = spark.createDataFrame([(50_000_000, 50.0, 43.2, 76.9, 1), (60_000_000, 50.0, 43.2003, 76.9003, 1), (60_000_000, 50.0, 43.3, 76.8, 1), (60_000_000, 50.0, None, None, 1)], schema)
    assert [(r.n, r.ppsm) for r in stats.heatmap(rows).collect()] == [(2, 1_100_000.0)]


def _log(spark, points):
    rows = [(i, p, dt.datetime.fromisoformat(d), k) for k, (i, p, d) in enumerate(points)]
    return spark.createDataFrame(rows, "listing_id long, price long, observed_at timestamp_ntz, seq int")


def test_last_price_is_strictly_before(spark):
    log = _log(spark, [(1, 100, "2024-01-01"), (1, 110, "2024-01-10"), (1, 120, "2024-01-20"), (2, 500, "2024-01-05")])
    assert {r.listing_id: r.price for r in asof.last_price(log, "2024-01-15").collect()} == {1: 110, 2: 500}
    assert {r.listing_id: r.price for r in asof.last_price(log, "2024-01-10").collect()} == {1: 100, 2: 500}


def test_change_log(spark):
    log = _log(spark, [(1, 100, "2024-01-01"), (1, 100, "2024-01-02"), (1, 200, "2024-01-03"), (1, 199, "2024-01-04")])
    assert [(r.price, r.jump) for r in asof.change_log(log).orderBy("seq").collect()] == [(100, False), (200, True), (199, False)]


def test_upsert_rules(spark):
    stored = spark.createDataFrame([(1, 10, "a", 1), (2, 20, "b", 2)], "id long, price long, district string, rooms int")
    batch = spark.createDataFrame([(1, None, None, 9), (3, 30, "c", 3)], "id long, price long, district string, rooms int")
    out = {r.id: (r.price, r.district, r.rooms) for r in merge.upsert(stored, batch, "id", ("price",), ("rooms",)).collect()}
    assert out == {1: (None, "a", 1), 2: (20, "b", 2), 3: (30, "c", 3)}


def test_quarantine_keeps_raw_coordinates(spark):
    rows = spark.createDataFrame([(1, 100, 50.0, 10.0, 77.0)], "id long, price long, area double, lat double, lon double")
    clean, bad = merge.quarantine(rows)
    assert clean.first().price is None and clean.first().lat == 10.0
    assert {(r.field, r.raw_value) for r in bad.collect()} == {("price", 100.0), ("lat", 10.0)}


def test_relistings(spark):
    schema = "id long, price long, last_seen int, fp string"
    rows = spark.createDataFrame([(1, 100, 1, "x"), (2, 101, 5, "x"), (3, 150, 2, "x"), (4, None, 9, "x"), (5, None, 1, "y"), (6, 10, 0, "y"), (7, 1, 1, None), (8, 1, 1, None)], schema)
    kept = {r.id for r in windows.dedup_relistings(rows).collect()}
    assert kept == {2, 3, 5, 7, 8}  # unpriced rows of x go; y has one priced row, so its freshest stays


def test_price_chain_links_neighbours(spark):
    rows = spark.createDataFrame([(i, p, "x") for i, p in enumerate([100, 102, 104, 120])], "id long, price long, fp string")
    assert [r.cluster for r in windows.price_clusters(rows).orderBy("id").collect()] == [0, 0, 0, 1]


def test_quotas_add_up(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "shard string, stock long")
    out = {r.shard: r.quota for r in windows.largest_remainder(rows, 10).collect()}
    assert out == {"a": 4, "b": 3, "c": 3}
    plan = spark.createDataFrame([("a", 10, 2), ("b", 1, 5), ("c", 1, 1)], "shard string, quota long, capacity long")
    assert {r.shard: r.quota for r in windows.redistribute(plan).collect()} == {"a": 2, "b": 5, "c": 1}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 32])
def test_rotation_visits_all(n):
    step = windows.rotation_step(n)
    assert len({step * k % n for k in range(n)}) == n


def test_variation_distance(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    b = spark.createDataFrame([("1",), ("2",), (None,)], "x string")
    c = spark.createDataFrame([("7",)], "x string")
    assert validity.variation_distance(a, b, ("x",)).first().tvd == 0
    assert validity.variation_distance(a, c, ("x",)).first().tvd == 1


def test_cluster_interval_is_wider_than_rows(spark):
    rows = spark.range(2000).selectExpr("id", "id % 200 as cluster", "0.1 + (hash(id % 200) % 100) / 1000.0 + (hash(id) % 100) / 10000.0 as ape")
    grouped = validity.cluster_bootstrap(rows, "cluster", "ape", reps=200).first()
    single = validity.cluster_bootstrap(rows, "id", "ape", reps=200).first()
    assert grouped.low <= grouped.mean <= grouped.high
    assert grouped.high - grouped.low > single.high - single.low
    assert validity.cluster_bootstrap(rows.where("cluster < 5"), "cluster", "ape", reps=20).first().low is None


def test_flat_trend(spark):
    rows = spark.createDataFrame([(t, 5.0) for t in range(4)], "t int, y double")
    assert validity.trend_line(rows, "t", "y").first().slope == 0.0


def test_polygon_with_hole(spark):
    ring = lambda a, b: [Row(lat=a, lon=a), Row(lat=a, lon=b), Row(lat=b, lon=b), Row(lat=b, lon=a)]
    zones = spark.createDataFrame([(1, "z", [ring(0.0, 10.0)], [ring(4.0, 6.0)])], "ord int, name string, outer array<array<struct<lat: double, lon: double>>>, inner array<array<struct<lat: double, lon: double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 1.0), (4, None, 1.0)], "id long, lat double, lon double")
    assert {r.id: r.zone for r in joins.zone_of(points, zones).collect()} == {1: "z", 2: None, 3: None, 4: None}


def test_neighbours_leave_out_the_point_itself(spark):
    rows = spark.createDataFrame([(i, 43.25, 76.9, v) for i, v in enumerate([1.0, 2.0, 3.0, 100.0])], "id long, lat double, lon double, value double")
    assert joins.neighbours(rows.where("id = 3"), rows).first().value == 2.0
    assert joins.neighbours(rows.where("id = 3"), rows.where("id < 2")).first().value is None


def test_complex_record_is_taken_whole(spark):
    rows = spark.createDataFrame([(1, "Sky 2"), (2, "Sky 3")], "id long, name string")
    dim = spark.createDataFrame([(1, "sky", 5.0), (2, "sky 2", None)], "complex_id long, name_norm string, score double")
    out = {r.id: r.complex_score for r in joins.complex_lookup(rows, dim, "name", ("score",)).collect()}
    assert out == {1: None, 2: 5.0}


def test_hex_cells_tile(spark):
    points = spark.range(400).selectExpr("43.2 + id * 0.0003 as lat", "76.9 + id * 0.0002 as lon")
    cells = points.select(geo.hex_cell(F.col("lat"), F.col("lon"), 0.5).alias("c")).distinct().count()
    assert 10 < cells < 60


def test_text_functions(spark):
    row = spark.range(1).select(text.count_of(F.lit("нет")).alias("none"), text.count_of(F.lit("2.0")).alias("two"), text.count_of(F.lit("many")).alias("junk"), F.size(text.params(F.lit("{broken"))).alias("broken"), text.category(F.lit("  A  B ")).alias("cat"), text.room_share(F.lit("ПОДСЕЛение")).alias("share")).first()
    assert row.asDict() == {"none": 0, "two": 2, "junk": None, "broken": 0, "cat": "a b", "share": True}


def test_guarded_delisting(spark):
    rows = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1 + (i > 1))) for i in range(10)], "id long, is_active int, last_seen timestamp_ntz")
    assert filters.delist_guarded(rows, "2024-01-04 12:00:00").where("gone").count() == 2
    assert filters.delist_guarded(rows, "2024-02-04").where("gone").count() == 0  # too many at once


def test_page_parts(spark):
    page = '<h1>A <b>b</b></h1><script>window.data = {"a": "}"};x</script><dl><dt data-name="floor">f</dt></dl><p>one two</p>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    out = {r.page_id: r for r in html.details(pages).collect()}
    assert (out[1].heading, out[1].n_words, out[1].data, out[1].params) == ("A b", 2, '{"a": "}"}', {"floor": "f"})
    assert out[2].heading is None and out[3].paragraphs == 0


def test_snapshots(spark, tmp_path):
    assert snapshots.read_json_lines(spark, str(tmp_path / "none")) is None
    (tmp_path / "h.jsonl").write_text('{"ts": "2024-01-01T00:00:00", "model": "a", "mape": 1.5}\n{bad\n\n')
    rows = snapshots.read_json_lines(spark, str(tmp_path / "h.jsonl"))
    assert [r.mape for r in rows.collect()] == [1.5]
    snapshots.append_metrics(rows, str(tmp_path / "out"))
    snapshots.append_metrics(rows, str(tmp_path / "out"))
    assert snapshots.last_rows(snapshots.read_json_lines(spark, str(tmp_path / "out")), 5).count() == 2
    (tmp_path / "state.json").write_text('{"c": {"1": {"since": "x", "price": 5}}}')
    assert [(r.chat, r.item, r.price) for r in snapshots.read_state(spark, str(tmp_path / "state.json")).collect()] == [("c", "1", 5)]


def test_rate_limit_counts_accepted_only(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, s), "k") for i, s in enumerate([0, 1, 2, 11, 12])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user string").coalesce(1).write.parquet(str(tmp_path / "e"))
    out = events.drain(events.rate_limited(events.source(spark, str(tmp_path / "e")), "user", 2, 10.5))
    assert {r.id: r.accepted for r in out.collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}
