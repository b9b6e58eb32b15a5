"""Neighbours, analogues and subscriptions against plain searches, and on crowded spots and keys."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marketlens.functions import geo
from marketlens.operators import joins, near

POINT = "id long, lat double, lon double, value double"


def plane(spark, rows):
    x, y = geo.project_km(F.col("lat"), F.col("lon"))
    return {r.id: (r.x, r.y) for r in spark.createDataFrame(rows, POINT).select("id", x.alias("x"), y.alias("y")).collect()}


def plain(spark, points, refs, k, radius, least=3):
    at, place = plane(spark, points), plane(spark, refs)
    out = {}
    for i, lat, lon, _ in points:
        if lat is None or lon is None:
            out[i] = (0, None)
            continue
        x, y = at[i]
        near_ = sorted((math.hypot(place[j][0] - x, place[j][1] - y), j, v) for j, a, b, v in refs if a is not None and b is not None and v is not None and j != i)
        values = [v for d, _, v in near_ if d <= radius][:k]
        out[i] = (len(values), round(statistics.median(values), 4) if len(values) >= least else None)
    return out


def scattered(seed: int) -> list[tuple]:
    """Points at very different densities: a field, a town, a house with many on one spot, pairs at the same distance, gaps."""
    rng = random.Random(seed)
    rows = [(43.2 + rng.uniform(-0.05, 0.05), 76.9 + rng.uniform(-0.05, 0.05)) for _ in range(150)]
    rows += [(43.21 + rng.gauss(0, 1e-4), 76.91 + rng.gauss(0, 1e-4)) for _ in range(120)]
    rows += [(43.21, 76.91)] * 40 + [(43.22, 76.92 + s * 1e-4 * (i // 2)) for i in range(12) for s in (-1, 1)]
    rows += [(43.23 + i * 1e-9, 76.93) for i in range(80)] + [(None, 76.9), (43.2, None), (44.9, 79.9)]
    return [(i, a, b, float(rng.randrange(1000)) if rng.random() > 0.05 else None) for i, (a, b) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "k", "radius"), [(1, 3, 1.0), (2, 15, 0.3), (3, 1, 2.0)])
def test_neighbours_equal_plain_ones(spark, seed, k, radius):
    rows = scattered(seed)
    df = spark.createDataFrame(rows, POINT)
    out = {r.id: (r.n, r.value) for r in joins.neighbours(df.drop("value"), df, k, radius).collect()}
    want = plain(spark, rows, rows, k, radius)
    assert {i: n for i, (n, _) in out.items()} == {i: n for i, (n, _) in want.items()}
    assert all(out[i][1] == want[i][1] or abs(out[i][1] - want[i][1]) < 1e-3 for i in want)


def test_crowded_spots(spark, monkeypatch):
    """100,000 points on one spot and as many on a short line meet few references each."""
    met = []
    nearest = near.nearest

    def counted(places, spots, k, radius):
        out = nearest(places, spots, k, radius)
        met.append((places.count(), spots.count()))
        return out

    monkeypatch.setattr(near, "nearest", counted)
    spot = spark.range(100_000).select("id", F.lit(43.2).alias("lat"), F.lit(76.9).alias("lon"), (F.col("id") % 7).cast("double").alias("value"))
    out = joins.neighbours(spot.drop("value"), spot, k=15)
    assert out.where("n = 15").count() == 100_000 and met[-1] == (1, 1)
    line = spark.range(20_000).select("id", (F.lit(43.2) + F.col("id") * 1e-6).alias("lat"), F.lit(76.9).alias("lon"), F.col("id").cast("double").alias("value"))
    one = spark.createDataFrame([(-1, 43.21, 76.9), (-2, 43.2, 76.9)], "id long, lat double, lon double")
    got = {r.id: r.value for r in joins.neighbours(one, line, k=5).collect()}
    assert got == {-1: 10_000.0, -2: 2.0}


ROWS = "id long, district string, rooms int, area double, floor int, year_built int, is_active int, price long"


def test_analogues_equal_plain_ones(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, 0.0, 30.0, 33.3, 40.0, 60.0, 80.0, 100.0, rng.uniform(25, 150)]), rng.choice([None, 1, 2, 5, 9]), rng.choice([None, 1960, 1985, 2010]), rng.choice([0, 1, 1]), rng.choice([None, 0, 100])) for i in range(400)]
    rows += [(500 + i, "a", 1, 50.0, 3, 2000, 1, 100) for i in range(30)] + [(600, "z", 9, 50.0, 3, 2000, 1, 100)]

    def distance(a, b):
        part = lambda x, y, s: 1.5**2 if x is None or y is None else ((y - x) / s) ** 2
        return round(math.sqrt(((b[3] - a[3]) / (a[3] * 0.25)) ** 2 + 0.5 * part(a[4], b[4], 5) + 0.5 * part(a[5], b[5], 10)), 6)

    pool = [b for b in rows if b[6] == 1 and (b[7] or 0) > 0 and (b[3] or 0) > 0 and b[2] is not None]
    want = []
    for a in rows:
        if (a[3] or 0) > 0 and a[2] is not None:
            found = sorted((-(b[1] is not None and a[1] == b[1]), distance(a, b), b[0]) for b in pool if b[2] == a[2] and b[0] != a[0] and a[3] * 0.75 <= b[3] <= a[3] * 1.25)[:5]
            want += [(a[0], b, -same, d, r + 1) for r, (same, d, b) in enumerate(found)]
    df = spark.createDataFrame(rows, ROWS)
    out = [(r.id, r.analogue, r.same_district, r.distance, r.rank) for r in joins.analogues(df, df, 5).collect()]
    close = lambda rows: sorted((i, r, s, round(d, 5)) for i, _, s, d, r in rows)
    assert close(out) == close(want)
    assert len(set(out) ^ set(want)) < 0.02 * len(want)  # sums may be rounded the other way in the sixth place


def test_filters_without_fields(spark):
    """A filter that all listings match: each task keeps its best rows, and the plan says so."""
    listings = spark.range(50_000).select("id", (F.col("id") * 7919 % 50_000).alias("diff"), F.lit(10).alias("price"), F.lit("a").alias("district"), F.lit(1).alias("rooms")).repartition(6)
    filters = spark.createDataFrame([(1, None, None, None), (2, None, None, None), (3, "b", None, None)], "chat long, district string, rooms int, max_price int")
    best = [r.id for r in listings.orderBy("diff", "id").limit(8).collect()]
    sent = spark.createDataFrame([(2, i) for i in best[:3]], "chat long, id long")
    out = joins.subscription_matches(listings, filters, sent, 5)
    got = {}
    for r in out.collect():
        got.setdefault(r.chat, []).append((r.rank, r.id))
    assert {c: [i for _, i in sorted(x)] for c, x in got.items()} == {1: best[:5], 2: best[3:8]}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def crowd(spark, monkeypatch):
    """Centroids or places at very different densities with many on one spot, points likewise, and the sizes of what is dealt to cells."""
    rng = random.Random(11)
    at = lambda n, wide: [(43.2 + rng.uniform(-wide, wide), 76.9 + rng.uniform(-wide, wide)) for _ in range(n)]
    spots = at(60, 0.2) + at(120, 0.004) + at(120, 0.0001) + [(43.2, 76.9)] * 2000
    points = at(60, 0.25) + at(60, 0.004) + at(30, 0.0001) + [(43.21, 76.91)] * 500 + [(None, 76.9)]
    sizes, around = [], joins._around

    def counted(rows, size):
        out = around(rows, size)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(joins, "_around", counted)
    places = spark.createDataFrame([(i, f"c{i}", i % 3, *x) for i, x in enumerate(spots)], "ord long, label string, kind int, lat double, lon double")
    return spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id long, lat double, lon double"), places, sizes


def test_centroids_on_crowded_spots(spark, monkeypatch):
    points, places, sizes = crowd(spark, monkeypatch)
    got = {r.id: r.label for r in joins.nearest_centroid(points, places, 1.2).collect()}
    monkeypatch.undo()
    km = F.round(geo.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("c.lat"), F.col("c.lon")), 9)
    pairs = points.alias("p").crossJoin(places.alias("c")).select("p.id", "c.label", "c.ord", km.alias("km")).where("km <= 1.2")
    want = {r.id: r.label for r in pairs.groupBy("id").agg(F.min_by("label", F.struct("km", -F.col("ord"))).alias("label")).collect()}
    assert got == {i: want.get(i) for i in range(points.count())}
    assert max(sizes) <= 9 * 301


def test_places_on_crowded_spots(spark, monkeypatch):
    points, places, sizes = crowd(spark, monkeypatch)
    got = {(r.id, r.kind): r.km for r in joins.nearest_places(points, places).collect()}
    monkeypatch.undo()
    km = geo.plane_km(F.col("p.lat"), F.col("p.lon"), F.col("c.lat"), F.col("c.lon"))
    pairs = points.where("lat is not null").alias("p").crossJoin(places.alias("c")).select("p.id", "c.kind", km.alias("km"))
    assert got == {(r.id, r.kind): r.km for r in pairs.groupBy("id", "kind").agg(F.round(F.min("km"), 6).alias("km")).collect()}
    assert max(sizes) <= 9 * 303


def test_what_a_chat_has_got_counts_for_itself(spark, monkeypatch):
    """Chats of one filter of which one has got much that doesn't match: the filter keeps few rows; fields of equal numbers stay apart."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([1, 2, 3, 90]), i * 7919 % 300) for i in range(300)]
    listings = spark.createDataFrame(rows, "id long, district string, rooms int, price int, diff int")
    wishes = [(c, *f) for c, f in enumerate([("a", 1, None), ("a", 1, None), (None, 2, None), (None, None, 2), (None, None, None), ("b", None, 2)] * 2)]
    filters = spark.createDataFrame(wishes, "chat long, district string, rooms int, max_price int")
    got = {(0, i) for i in range(1000, 3000)} | {(0, i) for i in range(0, 300, 3)} | {(4, i) for i in range(150)} | {(9, i) for i in range(0, 300, 2)}
    most, best = [], joins._best

    def counted(*args):
        most.append({r.district: r._most for r in args[4].where("rooms = 1").collect()})
        return best(*args)

    monkeypatch.setattr(joins, "_best", counted)
    out = joins.subscription_matches(listings, filters, spark.createDataFrame(sorted(got), "chat long, id long"), 5).collect()
    want = set()
    for c, d, r, m in wishes:
        match = sorted((x[4], x[0]) for x in rows if (d is None or d == x[1]) and (r is None or r == x[2]) and (m is None or x[3] <= m) and (c, x[0]) not in got)
        want |= {(c, i, e, n + 1) for n, (e, i) in enumerate(match[:5])}
    assert {(r.chat, r.id, r.diff, r.rank) for r in out} == want
    assert most == [{"a": 5 + len([x for x in rows if x[1] == "a" and x[2] == 1 and x[0] % 3 == 0])}]


def test_analogues_of_targets_alike_are_looked_for_once(spark, monkeypatch):
    """Many targets of a few kinds; stored tables with many rows are joined by a shuffle however small their files are."""
    rows = spark.range(3000).selectExpr("id", "'a' as district", "1 as rooms", "40.0 + id % 4 as area", "cast(id % 2 as int) as floor", "cast(null as int) as year_built", "1 as is_active", "100L as price")
    stored, plans, stage = {}, [], joins.stage

    def counted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = stage(df, name)
        stored.setdefault(name, out.count())
        return out

    monkeypatch.setattr(joins, "stage", counted)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10, raising=False)
    got = {}
    for r in joins.analogues(rows, rows, 5).collect():
        got.setdefault(r.id, []).append((r.rank, r.analogue, r.distance))
    ids = {i: [j for j in range(40) if j % 4 == i % 4 and j != i][:5] for i in range(3000)}
    assert {i: [(n, j) for n, j in enumerate(x, 1)] for i, x in ids.items()} == {i: [(n, j) for n, j, _ in sorted(x)] for i, x in got.items()}
    assert stored["targets"] == 4 and any("strategy=merge" in p for p in plans)
