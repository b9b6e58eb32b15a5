"""Planning, tracking and reports over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions import text
from marketlens.scratch import folder
from marketlens.sources import snapshots
from marketlens.operators import planning as p, stats

L, H, R = t.listings, t.history, t.runs
_L, _R, _H = t.sql("listing"), t.sql("run"), t.sql("history")


def _grid(s, d):
    return p.shard_grid(t.read(s, d, "nation").select(F.col("n_name").alias("district"))).select("shard", p.shard_district(F.col("shard")).alias("district"))




def _events(s, d):
    """One tracked price a lot and chat: the greatest."""
    rows = H(s, d).groupBy((F.col("seq") % 40).alias("chat"), F.col("listing_id").alias("id")).agg(F.max("price").alias("price"))
    return p.tracked_events(rows, L(s, d), t.NOW)


def _capped(s, d):
    rows = H(s, d).groupBy((F.col("seq") % 40).alias("chat"), F.col("listing_id").alias("id")).agg(F.min("observed_at").alias("since"))
    return p.capped(rows).select("chat", "id")


def _delivered(s, d):
    turns = t.read(s, d, "conversations")
    lots = turns.select(F.col("conv_id").alias("id"), F.col("turn").alias("chat")).distinct()
    return p.delivered(lots, turns.where("role = 'user' or turn < 2").select(F.col("conv_id").alias("id"), F.col("turn").alias("chat")))


def _contributions(s, d):
    rows = t.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), (F.col("l_partkey") % 7).cast("string")).alias("feature")).agg(F.sum(F.expr("cast(l_quantity as long) - 25")).alias("value"))
    groups = s.createDataFrame([("f0", "place"), ("f1", "place"), ("f2", "house")], "feature string, group string")
    return p.fold_contributions(rows, groups)


def _replies(s, d):
    e = t.read(s, d, "events").select((F.col("event_id") % 7000).alias("id"), F.array("event_type", F.lit("other")).alias("flags"))
    return p.valid_replies(e.dropDuplicates(["id", "flags"]), L(s, d).select("id"), ("view", "click", "error")).select("id", F.array_join("flags", ",").alias("flags"))


def _filled(s, d):
    typical = p.typical(L(s, d), ("building_type", "category"), ("ceiling", "year_built"))
    return p.fill_typical(L(s, d).select("id", "building_type", "category", "ceiling", F.col("year_built").cast("double").alias("year_built")), typical)


def _bars(s, d):
    rows = stats.by_group(L(s, d), "district").select("district", "median_ppsm")
    return p.bars(rows, "median_ppsm", 300_000.0)


def _numbers(s, d):
    e = t.read(s, d, "events")
    return e.select("event_id", text.comma_decimal(F.col("value")).alias("text"), text.plural(F.col("event_id"), "lot", "lots", "lots.").alias("word"))


def _recent_runs(s, d):
    """The newest runs of sales; a run without a deal is one of sales."""
    rows = R(s, d).where("coalesce(deal, 'sale') = 'sale'")
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(30).select("run_id", "shard", "found")


def _complexes(s, d):
    """The snapshot of complexes, written and read again."""
    path = folder(s, "complexes")
    snapshots.write_snapshot(QUERIES["complex_best_filled"](s, d), path)
    return snapshots.read_snapshot(s, path, "complex_name string, id long, filled int", lines=True)


QUERIES = {
    "plan_recent_runs": _recent_runs,
    "complex_snapshot": _complexes,
    "plan_shard_grid": _grid,
    "plan_timings": lambda s, d: p.timings(R(s, d), "shard"),
    "plan_freshness": lambda s, d: p.freshness(R(s, d), L(s, d), "sale"),
    "plan_freshness_without_runs": lambda s, d: p.freshness(R(s, d).where("run_id < 0"), L(s, d), "rent"),
    "plan_observation_gap": lambda s, d: p.observation_gap(L(s, d), "2002-01-01 00:00:00"),
    "plan_cap_hits": lambda s, d: p.cap_hits(R(s, d), "shard", F.lit(10)),
    "plan_degradation": lambda s, d: p.degradation(R(s, d), "shard"),
    "plan_zero_details": lambda s, d: p.zero_details(R(s, d).withColumn("found", F.expr("case when run_id % 50 = 0 then 0 else found end"))),
    "plan_data_gaps": lambda s, d: p.data_gaps(R(s, d), 0.4),
    "plan_budget": lambda s, d: p.budget_split(R(s, d).groupBy("shard").agg(F.sum("found").alias("stock")), 3400),
    "report_invariants": lambda s, d: p.invariants(L(s, d), H(s, d)),
    "report_activity": lambda s, d: p.activity(t.read(s, d, "events"), "2024-01-25 00:00:00", "user_id", "ts"),
    "report_busiest_hours": lambda s, d: p.busiest(t.read(s, d, "events"), "ts"),
    "report_bars": _bars,
    "report_numbers": _numbers,
    "track_events": _events,
    "track_capped": _capped,
    "track_delivered": _delivered,
    "feature_contributions": _contributions,
    "feature_replies": _replies,
    "feature_filled": _filled,
    "complex_best_filled": lambda s, d: p.best_filled(L(s, d).where("complex_name is not null").select("id", "complex_name", "area", "year_built", "ceiling"), "complex_name", ("area", "year_built", "ceiling"), "id").select("complex_name", "id", "filled"),
    "zone_upper_medians": lambda s, d: p.upper_median(L(s, d).where("microdistrict is not null"), "microdistrict", "lat", "lon"),
}

_BEST = f"{_L}, f AS (SELECT complex_name, id, (area IS NOT NULL)::INT + (year_built IS NOT NULL)::INT + (ceiling IS NOT NULL)::INT AS filled FROM listing WHERE complex_name IS NOT NULL) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY complex_name ORDER BY filled DESC, id) = 1"
ORACLES = {
    "plan_recent_runs": f"{_R} SELECT run_id, shard, found FROM run WHERE coalesce(deal, 'sale') = 'sale' ORDER BY started_at DESC, run_id DESC LIMIT 30",
    "complex_snapshot": _BEST,
    "plan_shard_grid": "SELECT concat(n_name, ' ', g) AS shard, n_name AS district FROM nation, unnest(['1', '2', '3', '4+']) u(g)",
    "plan_timings": f"""{_R}, k AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY started_at DESC, run_id DESC) AS r FROM run WHERE requests > 0)
SELECT shard, round(greatest(median(search_seconds / requests - 4), 0.1e0), 4) AS overhead, CAST(trunc(median(found)) AS BIGINT) AS inflow FROM k WHERE r <= 7 GROUP BY shard""",
    "plan_freshness": f"{_R} SELECT CAST(floor((epoch_us(started_at) + floor(search_seconds * 1000000)) / 1000000) AS BIGINT) AS observed_at FROM run WHERE coalesce(deal, 'sale') = 'sale' ORDER BY started_at DESC, run_id DESC LIMIT 1",
    "plan_freshness_without_runs": f"{_L} SELECT CAST(floor(epoch_us(max(last_seen)) / 1000000) AS BIGINT) AS observed_at FROM listing WHERE source <> 'user' AND deal = 'rent'",
    "plan_observation_gap": f"{_L}, m AS (SELECT (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(max(last_seen))) / 86400000000 AS g FROM listing WHERE is_active = 1 AND source <> 'user') SELECT round(g, 4) AS gap_days, g > 2.5e0 AS recovery FROM m",
    "plan_cap_hits": f"{_R}, k AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY run_id DESC) AS r FROM run) SELECT shard, count(*) FILTER (quota >= 10 AND backlog > 0) AS hits, count(*) FILTER (quota >= 10 AND backlog > 0) = 3 AS alarm FROM k WHERE r <= 3 GROUP BY shard",
    "plan_degradation": f"{_R}, k AS (SELECT shard, run_id, found, median(found) OVER (PARTITION BY shard ORDER BY run_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS u FROM run) SELECT shard, run_id, found, round(u, 4) AS usual FROM k WHERE found < 0.5e0 * u",
    "plan_zero_details": f"{_R} SELECT run_id, shard FROM run WHERE quota > 0 AND (run_id % 50 = 0 OR found = 0) AND banned = 0",
    "plan_data_gaps": "WITH g AS (SELECT lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap_start, epoch_us(ts) AS gap_end FROM events) SELECT gap_start, gap_end FROM g WHERE gap_end - gap_start > 1440000000",
    "plan_budget": f"{_R}, s AS (SELECT shard, CAST(sum(found) AS BIGINT) AS stock FROM run GROUP BY 1) SELECT shard, stock, CAST(greatest(floor(stock * 3060 / sum(stock) OVER ()), 1) AS BIGINT) AS requests FROM s",
    "report_invariants": f"""{t.sql("listing", "history")} SELECT 'rows' AS name, count(*) AS value, count(*) > 0 AS ok FROM listing UNION ALL SELECT 'points', count(*), count(*) > 0 FROM history UNION ALL SELECT 'bad_prices', count(*), count(*) = 0 FROM listing WHERE price <= 0
UNION ALL SELECT 'active_and_gone', count(*), count(*) = 0 FROM listing WHERE is_active = 1 AND delisted_at IS NOT NULL UNION ALL SELECT 'seen_backwards', count(*), count(*) = 0 FROM listing WHERE last_seen < first_seen UNION ALL SELECT 'empty_points', count(*), count(*) = 0 FROM history WHERE price IS NULL""",
    "report_activity": "SELECT " + ", ".join(f"count(*) FILTER (ts >= TIMESTAMP '2024-01-25' - INTERVAL {n} DAY) AS events_{n}, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-25' - INTERVAL {n} DAY) AS users_{n}" for n in (1, 7, 30)) + " FROM events WHERE ts < TIMESTAMP '2024-01-25'",
    "report_busiest_hours": "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 3",
    "report_bars": f"{_L}, d AS (SELECT district, CAST(trunc(median(price / area)) AS BIGINT) AS median_ppsm FROM listing WHERE is_active = 1 AND price > 0 AND area > 0 AND district IS NOT NULL GROUP BY 1) SELECT *, CAST(floor(median_ppsm * 100.0e0 / max(median_ppsm) OVER () + 0.5e0) AS BIGINT) AS bar, CAST(floor((median_ppsm - 300000) * 100.0e0 / 300000 + 0.5e0) AS BIGINT) AS delta_pct FROM d",
    "report_numbers": "SELECT event_id, concat(CAST(CAST(round_even(round(value * 100) / 10, 0) AS BIGINT) // 10 AS VARCHAR), ',', CAST(CAST(round_even(round(value * 100) / 10, 0) AS BIGINT) % 10 AS VARCHAR)) AS text, CASE WHEN event_id % 100 BETWEEN 11 AND 14 THEN 'lots.' WHEN event_id % 10 = 1 THEN 'lot' WHEN event_id % 10 BETWEEN 2 AND 4 THEN 'lots' ELSE 'lots.' END AS word FROM events",
    "track_events": f"""{t.sql("listing", "history")}, k AS (SELECT seq % 40 AS chat, listing_id AS id, max(price) AS price FROM history GROUP BY 1, 2), j AS (SELECT k.*, l.price AS now_, CASE WHEN l.is_active IS NULL THEN 'unknown' WHEN l.is_active = 0 AND l.delisted_at IS NOT NULL AND NOT (epoch_us(l.delisted_at) - epoch_us(l.last_seen) > 604800000000) THEN 'gone'
WHEN l.price < k.price THEN 'cheaper' WHEN l.price > k.price THEN 'dearer' END AS event FROM k LEFT JOIN listing l ON l.id = k.id) SELECT chat, id, event, round_even((now_ - price) * 100.0e0 / nullif(price, 0), 1) + 0 AS change_pct FROM j WHERE event IS NOT NULL""",
    "track_capped": f"{_H}, k AS (SELECT seq % 40 AS chat, listing_id AS id, min(observed_at) AS since FROM history GROUP BY 1, 2) SELECT chat, id FROM k QUALIFY row_number() OVER (PARTITION BY chat ORDER BY since, id) <= 10",
    "track_delivered": "WITH l AS (SELECT DISTINCT conv_id AS id, turn AS chat FROM conversations), g AS (SELECT DISTINCT conv_id AS id, turn AS chat FROM conversations WHERE role = 'user' OR turn < 2) SELECT l.id, count(*) AS wanted, count(g.id) AS got, count(*) = count(g.id) AS done FROM l LEFT JOIN g USING (id, chat) GROUP BY l.id",
    "feature_contributions": """WITH r AS (SELECT l_orderkey AS id, l_partkey % 7 AS f, CAST(sum(CAST(l_quantity AS BIGINT) - 25) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT id, CASE WHEN f IN (0, 1) THEN 'place' WHEN f = 2 THEN 'house' ELSE concat('f', CAST(f AS VARCHAR)) END AS "group", CAST(sum(v) AS BIGINT) AS value FROM r GROUP BY 1, 2 HAVING sum(v) <> 0)
SELECT id, "group", value, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, "group") AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, "group") <= 5""",
    "feature_replies": f"""{_L}, e AS (SELECT DISTINCT event_id % 7000 AS id, event_type AS f FROM events), o AS (SELECT id, min(f) AS f FROM e GROUP BY 1 HAVING count(*) = 1)
SELECT id, CASE WHEN f IN ('view', 'click', 'error') THEN f ELSE '' END AS flags FROM o WHERE id IN (SELECT id FROM listing)""",
    "feature_filled": f"""{_L}, b AS (SELECT building_type AS v FROM listing WHERE building_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), c AS (SELECT category AS v FROM listing WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), m AS (SELECT round(median(ceiling), 4) AS ce, round(median(year_built), 4) AS y FROM listing)
SELECT id, coalesce(building_type, b.v) AS building_type, coalesce(category, c.v) AS category, coalesce(ceiling, ce) AS ceiling, coalesce(CAST(year_built AS DOUBLE), y) AS year_built FROM listing, b, c, m""",
    "complex_best_filled": _BEST,
    "zone_upper_medians": f"""{_L}, a AS (SELECT microdistrict, list_sort(list(lat)) AS a, list_sort(list(lon)) AS o FROM listing WHERE microdistrict IS NOT NULL AND lat IS NOT NULL GROUP BY 1) SELECT microdistrict, a[len(a) // 2 + 1] AS lat, len(a) AS n_lat, o[len(o) // 2 + 1] AS lon, len(o) AS n_lon FROM a""",
}
