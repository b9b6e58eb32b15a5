"""Merges, change logs and as-of lookups over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import tables as t
from marketlens.operators import asof, merge

L, H, P, R = t.listings, t.history, t.predictions, t.runs
_L, _H, _R = t.sql("listing"), t.sql("history"), t.sql("run")


def _batch(s, d):
    """A second reading of every third listing, with gaps."""
    rows = L(s, d).where("id % 3 = 0")
    return rows.select("id", F.expr("CASE WHEN id % 2 = 0 THEN price + 1000 END").alias("price"), F.expr("CASE WHEN id % 5 > 0 THEN 'x' || district END").alias("district"), F.expr("id % 4").cast("int").alias("rooms"))


_BATCH = "batch AS (SELECT id, CASE WHEN id % 2 = 0 THEN price + 1000 END AS price, CASE WHEN id % 5 > 0 THEN 'x' || district END AS district, CAST(id % 4 AS INTEGER) AS rooms FROM listing WHERE id % 3 = 0)"


def _stored(s, d):
    return L(s, d).where("id % 7 > 0").select("id", "price", "district", "rooms", "floor")


def _fold(s, d):
    rows = R(s, d).select("shard", F.col("run_id"), F.expr("CASE WHEN run_id % 3 = 0 THEN NULL ELSE stock END").alias("stock"), F.expr("CASE WHEN run_id % 2 = 0 THEN NULL ELSE quota END").alias("quota"))
    return merge.fold(rows, "shard", "run_id", ("quota",))


def _sightings(s, d):
    rows = L(s, d)
    out = merge.sight(rows.where("id % 5 > 0"), rows.where("id % 4 = 0"), t.NOW)
    return out.select("id", "price", "is_active", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), F.date_format("delisted_at", "yyyy-MM-dd").alias("delisted_at"))


def _merged_usage(s, d):
    per = lambda part: R(s, d).where(f"run_id % 2 = {part}").groupBy("shard").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("run_id") % 7)).alias("users"))
    return merge.max_merge(per(0), per(1), ("shard",), "n", "users").select("shard", "n", F.array_join(F.transform("users", lambda x: x.cast("string")), ",").alias("users"))


def _three_way(s, d):
    rows = L(s, d).select("id", "price")
    local = rows.where("id % 4 = 0").withColumn("price", F.col("price") + 1)
    return merge.three_way(rows.where("id % 3 > 0"), local, rows.where("id % 10 = 0"), "id")


def _monotone(s, d):
    rows = H(s, d)
    last = lambda r: rows.where(f"seq % 2 = {r}").groupBy("listing_id").agg(F.max("seq").alias("version"), F.max("price").alias("price"))
    return merge.monotone(last(0), last(1), "listing_id", "version")


def _intervals(s, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return asof.asof_interval(H(s, d)).select("listing_id", "price", day("valid_from"), day("valid_to"))


def _index_at(s, d):
    rows = L(s, d).where("price > 0 and area > 0")
    week = rows.groupBy(F.date_trunc("week", "first_seen").cast("timestamp_ntz").alias("week")).agg(F.count("*").cast("double").alias("value"))
    index = week.where("value >= 8").unionByName(s.range(1).select(F.lit(None).cast("timestamp_ntz").alias("week"), F.lit(-1.0).alias("value")))
    return asof.index_at(index, rows.select(F.col("id").alias("key"), F.col("first_seen").alias("at")))


def _snapshots(s, d):
    days = L(s, d).select(F.col("first_seen").cast("date").alias("day")).distinct()
    return merge.keep_snapshots(days, "2001-08-02", 60).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


def _by_users(s, d):
    """What users say about every third listing, some of which are gone or not there."""
    stored = L(s, d).where("id % 7 > 0").select("id", "price", "district", "rooms", "title", "source", "is_active", "last_seen")
    entries = L(s, d).where("id % 3 = 0").select("id", (F.col("price") + 9).alias("price"), F.when(F.col("id") % 5 > 0, F.lit("told")).alias("district"), F.lit(1).alias("is_active"))
    return merge.upsert_user(stored, entries, t.NOW).select("id", "price", "district", "rooms", "title", "source", "is_active", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


def _in_order(s, d):
    """Each listing's price points, oldest first."""
    place = F.row_number().over(Window.partitionBy("listing_id").orderBy("observed_at", "seq"))
    return H(s, d).select("listing_id", place.alias("place"), "price", F.date_format("observed_at", "yyyy-MM-dd").alias("day")).orderBy("listing_id", "place")


QUERIES = {
    "merge_user": _by_users,
    "log_in_order": _in_order,
    "merge_upsert": lambda s, d: merge.upsert(_stored(s, d), _batch(s, d), "id", ("price",), ("rooms",)),
    "merge_fold": _fold,
    "merge_sightings": _sightings,
    "contract_clean": lambda s, d: merge.quarantine(L(s, d))[0].select("id", "price", "area"),
    "contract_anomalies": lambda s, d: merge.quarantine(L(s, d))[1],
    "log_changes": lambda s, d: asof.change_log(H(s, d)),
    "log_backfill": lambda s, d: asof.backfill_first_points(L(s, d), H(s, d).where("listing_id % 3 = 0")),
    "cohort_initial": lambda s, d: merge.initial_cohort(L(s, d), 30).select("id", "first_seen_cohort"),
    "cohort_gap": lambda s, d: merge.gap_cohort(L(s, d), "1999-03-01", "1999-04-01").select("id", "first_seen_cohort"),
    "merge_replace_by_key": lambda s, d: merge.replace_by_key(R(s, d).select("shard", "run_id", "stock"), "shard", order=("run_id",)),
    "merge_insert_or_ignore": lambda s, d: merge.insert_or_ignore(L(s, d).where("id % 2 = 0").select("id", "price"), L(s, d).where("id % 3 = 0").select("id", (F.col("price") + 5).alias("price")), "id"),
    "merge_ban_streaks": lambda s, d: merge.streaks(R(s, d).select("shard", "run_id", "banned", "quota"), "shard", "run_id", F.col("quota") == 0).select("shard", "run_id", "streak"),
    "merge_keep_last": lambda s, d: merge.keep_last(R(s, d).select("shard", "run_id", "found"), 7, "run_id", "shard"),
    "merge_three_way": _three_way,
    "merge_usage_max": _merged_usage,
    "merge_monotone": _monotone,
    "snapshots_kept": _snapshots,
    "asof_last_price": lambda s, d: asof.last_price(H(s, d), "1999-06-01 00:00:00"),
    "asof_intervals": _intervals,
    "asof_index": _index_at,
}

ORACLES = {
    "merge_user": f"""{_L}, o AS (SELECT id, price, district, rooms, title, source, is_active, last_seen FROM listing WHERE id % 7 > 0), n AS (SELECT id, price + 9 AS price, CASE WHEN id % 5 > 0 THEN 'told' END AS district FROM listing WHERE id % 3 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.price ELSE o.price END AS price, coalesce(n.district, o.district) AS district, o.rooms, o.title, CASE WHEN o.id IS NULL THEN 'user' ELSE o.source END AS source, CASE WHEN o.id IS NULL THEN 1 ELSE o.is_active END AS is_active,
strftime(CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{t.NOW}' ELSE o.last_seen END, '%Y-%m-%d') AS last_seen FROM o FULL JOIN n ON o.id = n.id""",
    "log_in_order": f"{_H} SELECT listing_id, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS INTEGER) AS place, price, strftime(observed_at, '%Y-%m-%d') AS day FROM history",
    "merge_upsert": f"""{_L}, {_BATCH}, stored AS (SELECT id, price, district, rooms, floor FROM listing WHERE id % 7 > 0)
SELECT coalesce(b.id, s.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.price ELSE s.price END AS price, coalesce(b.district, s.district) AS district, CASE WHEN s.id IS NOT NULL THEN s.rooms ELSE b.rooms END AS rooms, s.floor FROM stored s FULL JOIN batch b ON s.id = b.id""",
    "merge_fold": f"""{_R}, r AS (SELECT shard, run_id, CASE WHEN run_id % 3 = 0 THEN NULL ELSE stock END AS stock, CASE WHEN run_id % 2 = 0 THEN NULL ELSE quota END AS quota FROM run),
k AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY run_id DESC) AS rn FROM r)
SELECT shard, arg_max(stock, run_id) FILTER (stock IS NOT NULL) AS stock, max(quota) FILTER (rn = 1) AS quota, max(run_id) AS run_id FROM k GROUP BY shard""",
    "merge_sightings": f"""{_L}, o AS (SELECT * FROM listing WHERE id % 5 > 0), n AS (SELECT id, price FROM listing WHERE id % 4 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.price ELSE n.price END AS price, CASE WHEN n.id IS NOT NULL THEN 1 ELSE o.is_active END AS is_active,
strftime(CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{t.NOW}' ELSE o.last_seen END, '%Y-%m-%d') AS last_seen, strftime(CASE WHEN n.id IS NULL THEN o.delisted_at END, '%Y-%m-%d') AS delisted_at FROM o FULL JOIN n ON o.id = n.id""",
    "contract_clean": f"{_L} SELECT id, CASE WHEN price BETWEEN 500000 AND 45000000 THEN price END AS price, CASE WHEN area BETWEEN 22 AND 125 THEN area END AS area FROM listing",
    "contract_anomalies": f"""{_L} SELECT id AS listing_id, 'price' AS field, 'out of bounds' AS reason, round(CAST(price AS DOUBLE), 4) AS raw_value FROM listing WHERE price NOT BETWEEN 500000 AND 45000000
UNION ALL SELECT id, 'area', 'out of bounds', round(area, 4) FROM listing WHERE area NOT BETWEEN 22 AND 125 UNION ALL SELECT id, 'lat', 'out of bounds', round(lat, 4) FROM listing WHERE lat NOT BETWEEN 43.11e0 AND 43.38e0
UNION ALL SELECT id, 'lon', 'out of bounds', round(lon, 4) FROM listing WHERE lon NOT BETWEEN 76.71e0 AND 77.19e0 UNION ALL SELECT id, 'price', 'missing', NULL FROM listing WHERE price IS NULL""",
    "log_changes": f"""{_H}, b AS (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY observed_at, seq) AS before FROM history WHERE price IS NOT NULL)
SELECT listing_id, seq, price, before, coalesce(abs(price - before) > 0.6e0 * before, FALSE) AS jump FROM b WHERE before IS NULL OR price <> before""",
    "log_backfill": f"{t.sql('listing', 'history')} SELECT id AS listing_id, price, strftime(first_seen, '%Y-%m-%d') AS day FROM listing WHERE price IS NOT NULL AND source <> 'user' AND NOT EXISTS (SELECT 1 FROM history WHERE listing_id = id AND listing_id % 3 = 0)",
    "cohort_initial": f"{_L} SELECT id, coalesce(first_seen_cohort, CASE WHEN first_seen <= (SELECT min(first_seen) FROM listing) + INTERVAL 30 DAY THEN 'initial' END) AS first_seen_cohort FROM listing",
    "cohort_gap": f"{_L} SELECT id, coalesce(first_seen_cohort, CASE WHEN first_seen >= TIMESTAMP '1999-03-01' AND first_seen < TIMESTAMP '1999-04-01' THEN 'gap:1999-03-01' END) AS first_seen_cohort FROM listing",
    "merge_replace_by_key": f"{_R} SELECT shard, max(run_id) AS run_id, arg_max(stock, run_id) AS stock FROM run GROUP BY shard",
    "merge_insert_or_ignore": f"{_L} SELECT id, CASE WHEN id % 2 = 0 THEN price ELSE price + 5 END AS price FROM listing WHERE id % 2 = 0 OR id % 3 = 0",
    "merge_ban_streaks": f"""{_R}, i AS (SELECT *, sum(CASE WHEN quota = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY shard ORDER BY run_id) AS i FROM run)
SELECT shard, run_id, CAST(sum(CASE WHEN quota = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY shard, i ORDER BY run_id) AS BIGINT) AS streak FROM i""",
    "merge_keep_last": f"{_R} SELECT shard, run_id, found FROM run QUALIFY row_number() OVER (PARTITION BY shard ORDER BY run_id DESC) <= 7",
    "merge_three_way": f"{_L} SELECT id, CASE WHEN id % 4 = 0 THEN price + 1 ELSE price END AS price FROM listing WHERE (id % 3 > 0 OR id % 4 = 0) AND id % 10 > 0",
    "merge_usage_max": f"""{_R}, p AS (SELECT shard, run_id % 2 AS part, count(*) AS n FROM run GROUP BY 1, 2), u AS (SELECT DISTINCT shard, run_id % 7 AS u FROM run)
SELECT shard, max(n) AS n, (SELECT string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) FROM u WHERE u.shard = p.shard) AS users FROM p GROUP BY shard""",
    "merge_monotone": f"""{_H}, v AS (SELECT listing_id, seq % 2 AS part, max(seq) AS version, max(price) AS price FROM history GROUP BY 1, 2)
SELECT listing_id, version, price FROM v QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY version DESC, part) = 1""",
    "snapshots_kept": f"{_L} SELECT DISTINCT strftime(first_seen, '%Y-%m-%d') AS day FROM listing WHERE CAST(first_seen AS DATE) >= DATE '2001-08-02' - 60 OR dayofweek(first_seen) = 0",
    "asof_last_price": f"{_H} SELECT listing_id, price FROM history WHERE observed_at < TIMESTAMP '1999-06-01' QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, seq DESC) = 1",
    "asof_intervals": f"{_H} SELECT listing_id, price, strftime(observed_at, '%Y-%m-%d') AS valid_from, strftime(lead(observed_at) OVER (PARTITION BY listing_id ORDER BY observed_at, seq), '%Y-%m-%d') AS valid_to FROM history",
    "asof_index": f"""{_L}, r AS (SELECT * FROM listing WHERE price > 0 AND area > 0), w AS (SELECT CAST(date_trunc('week', first_seen) AS TIMESTAMP) AS week, CAST(count(*) AS DOUBLE) AS value FROM r GROUP BY 1 HAVING count(*) >= 8)
SELECT r.id AS key, coalesce(w.value, -1.0) AS value FROM r ASOF LEFT JOIN w ON date_trunc('week', r.first_seen) >= w.week""",
}
