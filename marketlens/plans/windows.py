"""Ordered logic over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens import tables as t
from marketlens.operators import windows as w

L, H, R = t.listings, t.history, t.runs
_L, _R = t.sql("listing"), t.sql("run")
_FP = "CASE WHEN area IS NOT NULL THEN concat_ws('|', coalesce(district, ''), CAST(rooms AS {text}), CAST(CAST(area AS INT) AS {text})) END"


def _keyed(s, d):
    return L(s, d).selectExpr("id", "price", "last_seen", _FP.format(text="STRING") + " AS fp")


_KEYED = f"{_L}, k AS (SELECT id, price, last_seen, {_FP.format(text='VARCHAR')} AS fp FROM listing)"
_CLUSTERS = """, g AS (SELECT *, CASE WHEN price > lag(price) OVER (PARTITION BY fp ORDER BY price, id) * 1.02e0 THEN 1 ELSE 0 END AS gap FROM {src}),
c AS (SELECT *, sum(gap) OVER (PARTITION BY fp ORDER BY price, id) AS cluster FROM g)"""


def _stocks(s, d):
    return R(s, d).groupBy("shard").agg(F.sum("found").alias("stock"))


def _plan(s, d):
    rows = R(s, d).groupBy("shard").agg(F.sum("quota").alias("quota"), F.max("stock").alias("m"))
    return w.redistribute(rows.select("shard", "quota", F.expr("cast(m % 700 + case when shard like 'view%' then 5000 else 0 end as long)").alias("capacity")), 1).select("shard", "quota", "capacity")


def _queue(s, d):
    return L(s, d).where("title is null or id % 9 = 0").selectExpr("concat(deal, ' ', cast(rooms as string)) as shard", "id", "first_seen")


def _cursors(s, d):
    return L(s, d).where("id < 12").selectExpr("concat(deal, ' ', cast(rooms as string)) as shard", "id * 900 as cursor").groupBy("shard").agg(F.max("cursor").alias("cursor"))


_QUEUE = "q AS (SELECT concat(deal, ' ', CAST(rooms AS VARCHAR)) AS shard, id, first_seen FROM listing WHERE title IS NULL OR id % 9 = 0), u AS (SELECT concat(deal, ' ', CAST(rooms AS VARCHAR)) AS shard, max(id * 900) AS cursor FROM listing WHERE id < 12 GROUP BY 1)"


def _best(s, d):
    rows = R(s, d).select(F.col("shard").alias("model"), "run_id", F.round("search_seconds", 2).alias("mape"))
    return w.running_best(rows, "run_id", "mape").select("model", "run_id", "mape", "best", "worse")


def _split(s, d):
    rows = L(s, d).select("id", F.col("first_seen").cast("date").alias("day"))
    train, test = w.time_split(rows)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count("*").alias("n"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first"))


def _rising(s, d):
    return w.rising(R(s, d).select("shard", "run_id", "backlog"), "shard", "run_id", "backlog")


def _rate_windows(s, d):
    """Events of a shard within an hour up to each."""
    seconds = F.unix_seconds(F.col("started_at").cast("timestamp"))
    hour = Window.partitionBy("shard").orderBy("s").rangeBetween(-3600, 0)
    return R(s, d).select("shard", "run_id", seconds.alias("s")).select("shard", "run_id", F.count("*").over(hour).alias("n"))


def _percentiles(s, d):
    """Nearest-rank percentiles by three index rules."""
    rows = R(s, d).select("shard", F.round("search_seconds", 2).alias("v"))
    lists = rows.groupBy("shard").agg(F.count("*").alias("n"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy("v")) - 1).join(lists, "shard")
    at = lambda i: F.max(F.when(F.col("r") == F.greatest(i, F.lit(0)), F.col("v")))
    n = F.col("n")
    return ranked.groupBy("shard").agg(at(F.bround((n - 1) * 0.5).cast("long")).alias("p50"), at(F.least(F.floor(n * 0.95).cast("long"), n - 1)).alias("p95"), at((F.floor(n * 0.99) - 1).cast("long")).alias("p99"))


def _reached(s, d):
    visits = R(s, d).selectExpr("shard", "run_id as id", "run_id as visit", "banned = 0 as ok", "requests % 5 as attempts", "quota = 0 as fresh")
    return w.cursors(visits)


def _rotation(s, d):
    """Where each shard comes in each day's pass: shards in order of their names, days as turns."""
    runs = R(s, d).select("shard", F.to_date("started_at").alias("day"))
    shards, days = runs.select("shard").distinct(), runs.select("day").distinct()  # both are short lists
    idx = shards.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("shard")) - 1)
    turn = days.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day")) - 1)
    out = w.rotated(runs.distinct().join(F.broadcast(idx), "shard").join(F.broadcast(turn), "day"), shards.count(), F.col("turn"))
    return out.select("shard", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("place").cast("long").alias("place"))


def _folds(s, d):
    """Test windows before the newest listing, with the listings that each has to learn from and to be judged on."""
    last = L(s, d).agg(F.max(F.to_date("first_seen")).alias("m")).first().m
    folds = w.folds(s, str(last), 4, 30, 2)
    day = F.to_date("first_seen")
    seen = L(s, d).select(day.alias("day")).groupBy("day").agg(F.count("*").alias("n")).join(F.broadcast(folds))  # four rows
    inside = (F.col("day") >= F.col("test_start")) & (F.col("day") < F.col("test_end"))
    total = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    out = seen.groupBy("fold", "test_start", "test_end", "train_end").agg(total(F.col("day") < F.col("train_end")).alias("n_train"), total(inside).alias("n_test"))
    return out.select("fold", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("test_start", "test_end", "train_end")), "n_train", "n_test")


#: A cap that lies within a day of the supplied listings, so that a day is taken in part.
_SPLIT = {"window": 14, "need": 0.003, "cap": 0.003, "least": 2, "bulk_least": 10_000}

QUERIES = {
    "window_recent_split": lambda s, d: w.recent_split(t.listings(s, d), **_SPLIT).select("id", "is_test"),
    "window_price_clusters": lambda s, d: w.price_clusters(_keyed(s, d).where("fp is not null")).select("id", "fp", "cluster"),
    "window_dedup_relistings": lambda s, d: w.dedup_relistings(_keyed(s, d)).select("id", "price", "fp"),
    "window_dedup_sizes": lambda s, d: w.dedup_sizes(_keyed(s, d)),
    "window_newest_streak": lambda s, d: w.newest_streak(R(s, d), "shard", "run_id", F.col("quota") > 0),
    "window_rising": _rising,
    "window_hysteresis": lambda s, d: w.hysteresis(R(s, d), "shard", "run_id", "backlog", 5000, 3000, "drain", "steady").select("shard", "run_id", "mode"),
    "window_circular": lambda s, d: w.circular_window(_queue(s, d), _cursors(s, d), 20),
    "window_fresh_first": lambda s, d: w.fresh_first(_queue(s, d), _cursors(s, d), 10, F.lit("2001-01-01").cast("timestamp_ntz")),
    "window_largest_remainder": lambda s, d: w.largest_remainder(_stocks(s, d), 1000),
    "window_redistribute": _plan,
    "window_rotation": _rotation,
    "window_running_best": _best,
    "window_cursors": _reached,
    "window_days_on_market": lambda s, d: w.days_on_market(L(s, d), t.NOW),
    "window_quintiles": lambda s, d: w.quintiles(L(s, d).select("id", "price"), "price").select("id", "quintile"),
    "window_folds": _folds,
    "window_time_split": _split,
    "window_rate": _rate_windows,
    "window_percentiles": _percentiles,
}

ORACLES = {
    "window_recent_split": t.sql("listing")
    + """, d AS (SELECT CAST(first_seen AS DATE) AS day, count(*) AS n FROM listing WHERE first_seen IS NOT NULL GROUP BY 1), w AS (SELECT sum(n) AS total FROM d),
e AS (SELECT *, greatest(1, floor(0.003e0 * total)) AS cap, sum(n) OVER (ORDER BY day DESC) AS upto, max(day) OVER () - day AS age FROM d, w),
f AS (SELECT *, least(greatest(2, ceil(0.003e0 * total)), cap) AS need FROM e), g AS (SELECT *, age <= 45 AND (age < 14 OR upto - n < need) AS open_ FROM f),
h AS (SELECT *, open_ AND upto <= cap AS fits, sum(CASE WHEN open_ AND upto <= cap THEN 0 ELSE 1 END) OVER (ORDER BY day DESC) AS misses FROM g),
k AS (SELECT day, total, CASE WHEN misses = 0 THEN n WHEN misses = 1 AND NOT fits AND open_ AND upto - n < need THEN cap - (upto - n) ELSE 0 END AS take FROM h),
m AS (SELECT day, take FROM k QUALIFY sum(take) OVER () >= least(2, greatest(1, total // 5)))
SELECT id, coalesce(row_number() OVER (PARTITION BY CAST(first_seen AS DATE) ORDER BY CAST(concat('0x', substr(md5(concat(id, '|42')), 1, 15)) AS BIGINT), id) <= take, FALSE) AS is_test FROM listing LEFT JOIN m ON day = CAST(first_seen AS DATE)""",
    "window_price_clusters": _KEYED + _CLUSTERS.format(src="(SELECT * FROM k WHERE fp IS NOT NULL AND price IS NOT NULL)") + " SELECT id, fp, CAST(cluster AS BIGINT) AS cluster FROM c",
    "window_dedup_relistings": _KEYED
    + ", n AS (SELECT *, count(price) OVER (PARTITION BY fp) AS priced FROM k WHERE fp IS NOT NULL)"
    + _CLUSTERS.format(src="(SELECT * FROM n WHERE priced >= 2 AND price IS NOT NULL)")
    + """, b AS (SELECT id, price, last_seen, fp, cluster FROM c UNION ALL SELECT id, price, last_seen, fp, 0 FROM n WHERE priced < 2)
SELECT id, price, fp FROM k WHERE fp IS NULL UNION ALL (SELECT id, price, fp FROM b QUALIFY row_number() OVER (PARTITION BY fp, cluster ORDER BY last_seen DESC, id DESC) = 1)""",
    "window_dedup_sizes": f"{_KEYED}, n AS (SELECT fp, count(*) AS n FROM k WHERE fp IS NOT NULL GROUP BY 1) SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS size, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM n GROUP BY 1",
    "window_newest_streak": f"{_R}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY run_id DESC) AS rn FROM run) SELECT shard, coalesce(min(rn) FILTER (quota <= 0), count(*) + 1) - 1 AS streak FROM r GROUP BY shard",
    "window_rising": f"""{_R}, r AS (SELECT shard, run_id, backlog, lag(backlog, 1) OVER v AS a, lag(backlog, 2) OVER v AS b, lag(backlog, 3) OVER v AS c FROM run WINDOW v AS (PARTITION BY shard ORDER BY run_id))
SELECT shard, run_id, backlog FROM r WHERE backlog > a AND a > b AND b > c""",
    "window_hysteresis": f"""{_R}, r AS (SELECT shard, run_id, CASE WHEN backlog >= 5000 THEN 'drain' WHEN backlog < 3000 THEN 'steady' END AS m FROM run)
SELECT shard, run_id, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY shard ORDER BY run_id), 'steady') AS mode FROM r""",
    "window_circular": f"{_L}, {_QUEUE}, r AS (SELECT q.shard, id, CAST(row_number() OVER (PARTITION BY q.shard ORDER BY coalesce(id < cursor, TRUE) DESC, id DESC) AS INTEGER) AS rank FROM q LEFT JOIN u ON q.shard = u.shard) SELECT * FROM r WHERE rank <= 20",
    "window_fresh_first": f"""{_L}, {_QUEUE}, j AS (SELECT q.*, cursor FROM q LEFT JOIN u ON q.shard = u.shard), f AS (SELECT shard, id, row_number() OVER (PARTITION BY shard ORDER BY id DESC) AS rank FROM j WHERE first_seen >= TIMESTAMP '2001-01-01' AND id > coalesce(cursor, 0) QUALIFY rank <= 5),
k AS (SELECT shard, count(*) AS taken FROM f GROUP BY 1), r AS (SELECT shard, id, row_number() OVER (PARTITION BY shard ORDER BY coalesce(id < cursor, TRUE) DESC, id DESC) AS rank FROM j WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.shard = j.shard AND f.id = j.id))
SELECT shard, id, 0 AS part, CAST(rank AS INTEGER) AS rank FROM f UNION ALL SELECT r.shard, r.id, 1, CAST(r.rank AS INTEGER) FROM r LEFT JOIN k ON r.shard = k.shard WHERE r.rank <= 10 - coalesce(taken, 0)""",
    "window_largest_remainder": f"""{_R}, s AS (SELECT shard, CAST(sum(found) AS BIGINT) AS stock FROM run GROUP BY 1), p AS (SELECT *, CAST(sum(stock) OVER () AS BIGINT) AS t FROM s), q AS (SELECT *, stock * 1000 // t AS q, stock * 1000 - (stock * 1000 // t) * t AS f FROM p)
SELECT shard, stock, q + CASE WHEN row_number() OVER (ORDER BY f DESC, stock DESC, shard) <= 1000 - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM q""",
    "window_redistribute": f"""{_R}, s AS (SELECT shard, CAST(sum(quota) AS BIGINT) AS quota, CAST(max(stock) % 700 + CASE WHEN shard LIKE 'view%' THEN 5000 ELSE 0 END AS BIGINT) AS capacity FROM run GROUP BY 1),
a AS (SELECT shard, capacity, least(quota, capacity) AS q, capacity - least(quota, capacity) AS room, CAST(sum(greatest(quota - capacity, 0)) OVER () AS BIGINT) AS left_ FROM s), b AS (SELECT *, CAST(sum(room) OVER () AS BIGINT) AS rooms FROM a),
c AS (SELECT *, least(left_, rooms) AS give, coalesce(least(left_, rooms) * room // nullif(rooms, 0), 0) AS g FROM b)
SELECT shard, capacity, CAST(q + g + CASE WHEN row_number() OVER (ORDER BY room DESC, shard) <= give - sum(g) OVER () AND room > g THEN 1 ELSE 0 END AS BIGINT) AS quota FROM c""",
    "window_rotation": f"""{_R}, r AS (SELECT DISTINCT shard, CAST(started_at AS DATE) AS day FROM run), i AS (SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT shard FROM r)), t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS turn FROM (SELECT DISTINCT day FROM r)),
c AS (SELECT s, row_number() OVER (ORDER BY abs(s - greatest(1, round_even(0.4e0 * n, 0))), s DESC) AS k FROM (SELECT max(n) AS n FROM i), unnest(range(1, n + 1)) u(s) WHERE gcd(s, n) = 1)
SELECT r.shard, strftime(r.day, '%Y-%m-%d') AS day, CAST(((idx - turn * (SELECT s FROM c WHERE k = 1)) % n + n) % n AS BIGINT) AS place FROM r JOIN i USING (shard) JOIN t USING (day)""",
    "window_cursors": f"""{_R}, p AS (SELECT shard, run_id, banned = 0 OR requests % 5 >= 3 AS passed FROM run WHERE quota <> 0),
b AS (SELECT shard, run_id, sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (PARTITION BY shard ORDER BY run_id) AS failed FROM p) SELECT shard, max(run_id) AS cursor FROM b WHERE failed = 0 GROUP BY shard""",
    "window_running_best": f"""{_R}, r AS (SELECT shard AS model, run_id, round(search_seconds, 2) AS mape FROM run), b AS (SELECT *, min(mape) OVER (PARTITION BY model ORDER BY run_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS best FROM r)
SELECT model, run_id, mape, best, coalesce(mape > best + greatest(0.5e0, best * 0.06e0), FALSE) AS worse FROM b""",
    "window_days_on_market": f"{_L} SELECT id, CAST(greatest(floor((epoch_us(CASE WHEN is_active = 1 THEN TIMESTAMP '{t.NOW}' ELSE coalesce(delisted_at, last_seen) END) - epoch_us(first_seen)) / 86400000000), 0) AS BIGINT) AS days FROM listing",
    "window_quintiles": f"{_L}, q AS (SELECT quantile_cont(price, [0.2, 0.4, 0.6, 0.8]) AS q FROM listing) SELECT id, CASE WHEN price IS NOT NULL THEN 1 + CAST(price > q[1] AS INTEGER) + CAST(price > q[2] AS INTEGER) + CAST(price > q[3] AS INTEGER) + CAST(price > q[4] AS INTEGER) END AS quintile FROM listing, q",
    "window_folds": f"""{_L}, x AS (SELECT CAST(first_seen AS DATE) AS day FROM listing), m AS (SELECT max(day) AS last FROM x), f AS (SELECT CAST(i AS INTEGER) AS fold, last - CAST((3 - i) * 30 + 30 AS INTEGER) AS test_start, last - CAST((3 - i) * 30 AS INTEGER) AS test_end, last - CAST((3 - i) * 30 + 32 AS INTEGER) AS train_end FROM range(4) r(i), m)
SELECT fold, strftime(test_start, '%Y-%m-%d') AS test_start, strftime(test_end, '%Y-%m-%d') AS test_end, strftime(train_end, '%Y-%m-%d') AS train_end, count(*) FILTER (day < train_end) AS n_train, count(*) FILTER (day >= test_start AND day < test_end) AS n_test FROM f, x GROUP BY ALL""",
    "window_time_split": f"""{_L}, d AS (SELECT CAST(first_seen AS DATE) AS day, count(*) AS n FROM listing GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY day DESC) AS s, sum(n) OVER () AS total FROM d)
SELECT CASE WHEN s <= 0.2e0 * total THEN 'test' ELSE 'train' END AS part, CAST(sum(n) AS BIGINT) AS n, strftime(min(day), '%Y-%m-%d') AS first FROM c GROUP BY 1""",
    "window_rate": f"{_R}, r AS (SELECT shard, run_id, CAST(floor(epoch_us(started_at) / 1000000) AS BIGINT) AS s FROM run) SELECT shard, run_id, count(*) OVER (PARTITION BY shard ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM r",
    "window_percentiles": f"""{_R}, r AS (SELECT shard, round(search_seconds, 2) AS v, row_number() OVER (PARTITION BY shard ORDER BY round(search_seconds, 2)) - 1 AS r, count(*) OVER (PARTITION BY shard) AS n FROM run)
SELECT shard, max(v) FILTER (r = CAST(round_even((n - 1) * 0.5e0, 0) AS BIGINT)) AS p50, max(v) FILTER (r = least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1)) AS p95, max(v) FILTER (r = greatest(CAST(floor(n * 0.99e0) - 1 AS BIGINT), 0)) AS p99 FROM r GROUP BY shard""",
}
