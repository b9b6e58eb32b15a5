"""Ordered logic: clusters, streaks, hysteresis, quotas and circular queues."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.operators.quantiles import summarise


def price_clusters(rows: DataFrame, key: str = "fp", tolerance: float = 0.02) -> DataFrame:
    """A cluster number for the priced rows of each key: a new one where a price is over 2 % above the one before."""
    order = Window.partitionBy(key).orderBy("price", "id")
    gap = F.col("price") > F.lag("price").over(order) * (1 + tolerance)
    flagged = rows.where(F.col("price").isNotNull()).withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
    return flagged.withColumn("cluster", F.sum("_new").over(order)).drop("_new")


def dedup_relistings(rows: DataFrame, key: str = "fp", order: tuple[str, ...] = ("last_seen", "id")) -> DataFrame:
    """One row for each flat and price level: the freshest of each (key, price cluster).

    Rows without a key stay. A key with fewer than two priced rows keeps its freshest row alone; with two or more, its
    unpriced rows go.
    """
    loose = rows.where(F.col(key).isNull())
    keyed = rows.where(F.col(key).isNotNull()).withColumn("_priced", F.count("price").over(Window.partitionBy(key)))
    few, many = keyed.where("_priced < 2").withColumn("cluster", F.lit(0).cast("long")), price_clusters(keyed.where("_priced >= 2"), key)
    both = few.unionByName(many)
    freshest = Window.partitionBy(key, "cluster").orderBy(*(F.desc(c) for c in order))
    kept = both.withColumn("_r", F.row_number().over(freshest)).where("_r = 1").select(*rows.columns)
    return loose.unionByName(kept)


def dedup_sizes(rows: DataFrame, key: str = "fp") -> DataFrame:
    """How many keys have 1, 2, 3-5, 6-10 and more rows, and how many rows those are."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").when(F.col("n") <= 10, "6-10").otherwise("11+")
    return sizes.groupBy(bucket.alias("size")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def newest_streak(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """For how many of its newest rows a key fulfils a condition without a break (of equally new ones a miss comes first)."""
    hit = F.coalesce(hit, F.lit(False))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), hit)))
    miss = F.min(F.when(~hit, F.col("_r")))
    return ranked.groupBy(key).agg((F.coalesce(miss, F.count("*") + 1) - 1).cast("long").alias("streak"))


def rising(rows: DataFrame, key: str, order: str, value: str, steps: int = 3) -> DataFrame:
    """Rows that end a run of so many rises in a row; equal moments are in the order of the value."""
    run = Window.partitionBy(key).orderBy(order, value)
    ups = [F.lag(value, i).over(run) > F.lag(value, i + 1).over(run) for i in range(1, steps)]
    up = F.col(value) > F.lag(value).over(run)
    for more in ups:
        up = up & more
    return rows.where("true").withColumn("_up", up).where("_up").drop("_up")


def hysteresis(rows: DataFrame, key: str, order: str, value: str, enter: float, leave: float, on: str, off: str) -> DataFrame:
    """A mode that turns on at ``enter`` or more, off below ``leave``, and else stays; off to begin with."""
    change = F.when(F.col(value) >= enter, on).when(F.col(value) < leave, off)
    run = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("mode", F.coalesce(F.last(change, ignorenulls=True).over(run), F.lit(off)))


def circular_window(rows: DataFrame, cursors: DataFrame, n: int) -> DataFrame:
    """The next n ids of each shard going down from its cursor, and on from the greatest."""
    joined = rows.join(cursors, "shard", "left")
    below = F.coalesce(F.col("id") < F.col("cursor"), F.lit(True))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(below), F.desc("id")))
    return joined.withColumn("rank", rank).where(F.col("rank") <= n).select("shard", "id", "rank")


def fresh_first(rows: DataFrame, cursors: DataFrame, n: int, since: Column) -> DataFrame:
    """Up to half of n from the newest ids above the cursor that are fresh, the rest from the circular window."""
    joined = rows.join(cursors, "shard", "left")
    fresh = joined.where((F.col("first_seen") >= since) & (F.col("id") > F.coalesce("cursor", F.lit(0))))
    top = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("id")))
    fresh = fresh.withColumn("rank", top).where(F.col("rank") <= n // 2).select("shard", "id", F.lit(0).alias("part"), "rank")
    taken = fresh.groupBy("shard").agg(F.count("*").alias("taken"))
    rest = circular_window(rows.join(fresh.select("shard", "id"), ["shard", "id"], "left_anti"), cursors, n)
    rest = rest.join(taken, "shard", "left").where(F.col("rank") <= n - F.coalesce("taken", F.lit(0)))
    return fresh.unionByName(rest.select("shard", "id", F.lit(1).alias("part"), "rank"))


def largest_remainder(stocks: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """Shares of a budget in proportion to stock, in whole numbers that add up: the largest remainders are rounded up.

    ``stocks`` has a row a shard (a planning table); ``group`` splits it, each group with the budget of its own.
    """
    part = Window.partitionBy(group) if group else Window.partitionBy(F.lit(1))
    total = F.sum("stock").over(part)
    # Whole numbers throughout: floor and remainder of budget * stock / total.
    rows = stocks.withColumn("_t", total).where("_t > 0").withColumn("_p", F.col("stock") * budget)
    rows = rows.withColumn("_q", F.floor(F.try_divide(F.col("_p"), F.col("_t"))).cast("long")).withColumn("_f", F.col("_p") - F.col("_q") * F.col("_t"))
    order = part.orderBy(F.desc("_f"), F.desc("stock"), "shard")
    rows = rows.withColumn("_left", F.lit(budget) - F.sum("_q").over(part)).withColumn("_r", F.row_number().over(order))
    return rows.withColumn("quota", F.col("_q") + (F.col("_r") <= F.col("_left")).cast("long")).drop("_t", "_p", "_q", "_f", "_left", "_r")


def redistribute(plan: DataFrame, rounds: int = 8) -> DataFrame:
    """Move what shards can't use (quota over capacity) to those with room, in proportion to their room.

    Each round is two windows over the planning table; a round that has nothing left to move changes nothing.
    """
    every = Window.partitionBy(F.lit(1))
    rows = plan.withColumn("quota", F.col("quota").cast("long"))
    for _ in range(rounds):
        rows = rows.withColumn("_left", F.sum(F.greatest(F.col("quota") - F.col("capacity"), F.lit(0))).over(every)).withColumn("quota", F.least("quota", "capacity"))
        rows = rows.withColumn("_room", F.col("capacity") - F.col("quota"))
        rows = rows.withColumn("_all", F.sum("_room").over(every))
        give = F.least(F.col("_left"), F.col("_all"))
        share = F.coalesce(F.floor(F.try_divide(give * F.col("_room"), F.col("_all"))).cast("long"), F.lit(0))
        rows = rows.withColumn("_give", share)
        order = every.orderBy(F.desc("_room"), "shard")
        rest = give - F.sum("_give").over(every)
        rows = rows.withColumn("_rest", rest).withColumn("_r", F.row_number().over(order))
        more = ((F.col("_r") <= F.col("_rest")) & (F.col("_room") > F.col("_give"))).cast("long")
        rows = rows.withColumn("quota", F.col("quota") + F.col("_give") + more)
    return rows.drop("_left", "_room", "_all", "_give", "_rest", "_r")


def rotation_step(n: int) -> int:
    """The step nearest to 0.4 n that has no factor in common with n."""
    start = max(1, round(0.4 * n))
    return next(s for d in range(n + 1) for s in (start + d, start - d) if 0 < s <= max(n, 1) and gcd(s, n) == 1)


def rotated(rows: DataFrame, n: int, turn: int | Column, index: str = "idx") -> DataFrame:
    """The place of each index in the turn's order."""
    offset = F.pmod((F.lit(turn) if isinstance(turn, int) else turn) * rotation_step(n), F.lit(n))
    return rows.withColumn("place", F.pmod(F.col(index) - offset, F.lit(n)))


def cursors(visits: DataFrame, shard: str = "shard", order: str = "visit", most: int = 3) -> DataFrame:
    """shard and cursor: the id that each shard's pass came to without a failure before it.

    ``visits`` has id, ok, attempts and fresh. A failure stops the cursor unless it is the id's ``most``-th or a later
    one, which is passed over. Fresh ids neither move nor stop it. A shard whose cursor doesn't move has no row. Both
    steps are aggregates, so a large shard isn't gathered in one task.
    """
    walked = visits.where(~F.coalesce("fresh", F.lit(False)))
    passed = F.coalesce("ok", F.lit(False)) | (F.coalesce("attempts", F.lit(0)) >= most)
    stops = walked.where(~passed).groupBy(shard).agg(F.min(order).alias("_stop"))
    before = walked.join(stops, shard, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    return before.groupBy(shard).agg(F.max_by("id", order).alias("cursor"))


def running_best(rows: DataFrame, order: str, value: str, n: int = 4, points: float = 0.5, share: float = 0.06) -> DataFrame:
    """Whether a value is worse than the best of the last n by more than a tolerance."""
    best = F.min(value).over(Window.partitionBy("model").orderBy(order).rowsBetween(-n, -1))
    limit = best + F.greatest(F.lit(points), best * share)
    return rows.withColumn("best", best).withColumn("worse", F.coalesce(F.col(value) > limit, F.lit(False)))


def days_on_market(listings: DataFrame, now: str) -> DataFrame:
    """Whole days from first sight to now if active, else to when it went (or was last seen); never below 0."""
    stop = F.when(F.col("is_active") == 1, F.lit(now).cast("timestamp_ntz")).otherwise(F.coalesce("delisted_at", "last_seen"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    days = F.floor((micros(stop) - micros(F.col("first_seen"))) / 86_400_000_000)
    return listings.select("id", F.greatest(days, F.lit(0)).cast("long").alias("days"))


def quintiles(rows: DataFrame, value: str) -> DataFrame:
    """1 to 5 by interpolated quantiles; equal values never part."""
    cuts = summarise(rows, (), [], {"_q": F.col(value)}, at=(0.2, 0.4, 0.6, 0.8))
    above = F.aggregate("_q", F.lit(1), lambda n, q: n + (F.col(value) > q).cast("int"))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("quintile", F.when(F.col(value).isNotNull(), above)).drop("_q")


def folds(spark, last: str, n: int = 4, days: int = 7, gap: int = 0) -> DataFrame:
    """Test windows of a walk-forward, newest last, without overlap; training ends before each, ``gap`` days earlier."""
    end = F.date_sub(F.lit(last).cast("date"), ((n - 1 - F.col("id")) * days).cast("int"))
    rows = spark.range(n).select(F.col("id").cast("int").alias("fold"), F.date_sub(end, days).alias("test_start"), end.alias("test_end"))
    return rows.withColumn("train_end", F.date_sub("test_start", gap))


def time_split(rows: DataFrame, day: str = "day", share: float = 0.2, bulk: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole newest days up to a share of all rows; days that hold a bulk of them are never test.

    The table of days is small; the running sum goes over it alone.
    """
    counts = rows.groupBy(day).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    counts = counts.withColumn("total", F.sum("n").over(every)).where(F.col("n") <= bulk * F.col("total"))
    running = F.sum("n").over(every.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0))
    test_days = counts.withColumn("s", running).where(F.col("s") <= share * F.col("total")).select(day)
    return rows.join(F.broadcast(test_days), day, "left_anti"), rows.join(F.broadcast(test_days), day, "left_semi")


def recent_split(
    rows: DataFrame, at: str = "first_seen", key: str = "id", window: int = 14, need: float = 0.10, cap: float = 0.20, least: int = 500, lookback: int = 45, bulk_times: float = 3.0, bulk_least: int = 1500, bulk_days: int = 5, seed: str = "42"
) -> DataFrame:
    """Adds is_test: the newest rows by whole days, as a share of all rows between ``need`` (or ``least`` rows) and ``cap``.

    Days of a bulk load (with ``bulk_days`` days or more: over ``bulk_times`` the median day and ``bulk_least`` rows) are
    never test. From the newest other day on, days are taken while they fit under the cap, for ``window`` days, or for
    ``lookback`` days while too few are taken. Of the first day that doesn't fit, as many rows as do are drawn by a hash,
    if too few were taken before. A test of under ``least`` rows, or of a fifth of all if that is less, is none at all.
    Rows without a moment are never test. Only the table of days is put in order, and a part of one day.
    """
    day = F.to_date(at)
    days = rows.where(F.col(at).isNotNull()).groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    whole = days.agg(F.sum("_n").alias("_total"), F.count("*").alias("_days"), F.percentile("_n", F.lit(0.5)).alias("_median"))
    days = days.crossJoin(F.broadcast(whole))  # one row
    bulk = (F.col("_days") >= bulk_days) & (F.col("_n") >= F.greatest(bulk_times * F.col("_median"), F.lit(bulk_least)))
    days = days.where(~bulk).withColumn("_cap", F.greatest(F.lit(1), F.floor(cap * F.col("_total"))))
    days = days.withColumn("_need", F.least(F.greatest(F.lit(least), F.ceil(need * F.col("_total"))), F.col("_cap")))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_day"))  # a row a day
    days = days.withColumns({"_upto": F.sum("_n").over(order), "_age": F.date_diff(F.max("_day").over(Window.partitionBy(F.lit(1))), "_day")})
    before = F.col("_upto") - F.col("_n")
    open_ = (F.col("_age") <= lookback) & ((F.col("_age") < window) | (before < F.col("_need")))
    days = days.withColumn("_open", open_).withColumn("_fits", F.col("_open") & (F.col("_upto") <= F.col("_cap")))
    # Nothing is taken behind the first day that doesn't fit.
    days = days.withColumn("_misses", F.sum((~F.col("_fits")).cast("int")).over(order))
    take = F.when(F.col("_misses") == 0, F.col("_n")).when((F.col("_misses") == 1) & ~F.col("_fits") & F.col("_open") & (before < F.col("_need")), F.col("_cap") - before).otherwise(0)
    days = days.withColumn("_take", take).withColumn("_size", F.sum("_take").over(Window.partitionBy(F.lit(1))))
    enough = F.col("_size") >= F.least(F.lit(least), F.greatest(F.lit(1), F.floor(F.col("_total") / 5)))
    days = days.where(enough & (F.col("_take") > 0)).select("_day", "_n", "_take")

    placed = rows.withColumn("_at", day).join(F.broadcast(days), F.col("_at") == F.col("_day"), "left").drop("_at")  # a row a day
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("long")
    part = placed.where("_take < _n").withColumn("_draw", draw)
    # Rows are drawn by their hash: whole slices of hashes first, then the rest from one slice in order.
    slices = part.withColumn("_slice", F.shiftright("_draw", 48)).groupBy("_slice").agg(F.count("*").alias("_c"), F.first("_take").alias("_k"))
    slices = slices.withColumn("_so_far", F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy("_slice")))  # 4,096 rows at most
    edge = slices.where("_so_far > _k").agg(F.min("_slice").alias("_edge"), F.min_by(F.col("_k") - (F.col("_so_far") - F.col("_c")), "_slice").alias("_rest"))
    part = part.crossJoin(F.broadcast(edge))  # one row
    low = part.where(F.shiftright("_draw", 48) < F.col("_edge")).withColumn("_in", F.lit(True))
    high = part.where(F.shiftright("_draw", 48) > F.col("_edge")).withColumn("_in", F.lit(False))
    on = part.where(F.shiftright("_draw", 48) == F.col("_edge")).withColumn("_in", F.row_number().over(Window.partitionBy("_edge").orderBy("_draw", key)) <= F.col("_rest"))
    drawn = low.unionByName(on).unionByName(high).select(*rows.columns, F.col("_in").alias("is_test"))
    return placed.where("_take is null or _take = _n").select(*rows.columns, F.col("_take").isNotNull().alias("is_test")).unionByName(drawn)


def decimate(points: Column, least: float) -> Column:
    """Points of a line (array of struct x, y) at least so far from the last kept one; the first is kept."""
    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.hypot(p["x"] - last["x"], p["y"] - last["y"]) >= least
        return F.when(F.size(kept) == 0, F.array(p)).when(far, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, F.slice(points, 1, 0), step)
