"""Keyed merges with a rule for each column. They return new tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(stored: DataFrame, batch: DataFrame, key: str, overwrite: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Merge a batch into a table on ``key``: one full outer join.

    For keys in both: columns of ``overwrite`` take the batch's value (null too), those of ``keep`` the stored one, all
    others the batch's value unless it is null. Columns that one side lacks come from the other.
    """
    names = list(dict.fromkeys([*stored.columns, *batch.columns]))
    o, n = stored.withColumn("_o", F.lit(True)).alias("o"), batch.withColumn("_n", F.lit(True)).alias("n")
    out: list[Column] = []
    for c in names:
        old = F.col(f"o.{c}") if c in stored.columns else F.lit(None)
        new = F.col(f"n.{c}") if c in batch.columns else F.lit(None)
        if c == key:
            value = F.coalesce(new, old)
        elif c in overwrite:
            value = F.when(F.col("_n"), new).otherwise(old)
        elif c in keep:
            value = F.when(F.col("_o"), old).otherwise(new)
        else:
            value = F.coalesce(new, old)
        out.append(value.alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*out)


def fold(events: DataFrame, key: str, order: str, overwrite: tuple[str, ...] = ()) -> DataFrame:
    """The state after all events of each key in order: the last value of each column that is not null.

    Columns of ``overwrite`` take the last event's value, null or not. One aggregation, whatever the number of events.
    """
    aggs = []
    for c in events.columns:
        if c in (key, order):
            continue
        if c in overwrite:
            aggs.append(F.max_by(F.struct(c), order)[c].alias(c))
        else:
            aggs.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c))
    return events.groupBy(key).agg(*aggs, F.max(order).alias(order))


def sight(stored: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Sightings: new ids come in with their price; known ones are revived and touched, their price is not changed."""
    moment = F.lit(now).cast("timestamp_ntz")
    o, n = stored.alias("o"), seen.select("id", F.col("price").alias("seen_price")).alias("n")
    joined = o.join(n, F.col("o.id") == F.col("n.id"), "full")
    hit, known = F.col("n.id").isNotNull(), F.col("o.id").isNotNull()
    return joined.select(
        F.coalesce("o.id", "n.id").alias("id"),
        F.when(known, F.col("o.price")).otherwise(F.col("seen_price")).alias("price"),
        F.when(hit, moment).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(hit, 1).otherwise(F.col("o.is_active")).alias("is_active"),
        F.when(~hit, F.col("o.delisted_at")).alias("delisted_at"),
    )


#: Bounds of the data contract; values beyond become missing, they are never cut to the bound.
BOUNDS = {"price": (500_000, 45_000_000), "area": (22, 125), "lat": (43.11, 43.38), "lon": (76.71, 77.19)}


def quarantine(rows: DataFrame, bounds: dict = BOUNDS) -> tuple[DataFrame, DataFrame]:
    """(rows with what breaks the contract removed, anomalies as listing_id, field, reason, raw_value).

    Prices and areas out of bounds become null; coordinates are logged but stay. A missing price is an anomaly too.
    """
    beyond = lambda c: F.col(c).isNotNull() & ~F.col(c).between(*bounds[c])
    clean = rows
    for c in ("price", "area"):
        clean = clean.withColumn(c, F.when(~beyond(c), F.col(c)))
    found = F.array(
        *(F.when(beyond(c), F.struct(F.lit(c).alias("field"), F.lit("out of bounds").alias("reason"), F.round(F.col(c).cast("double"), 4).alias("raw_value"))) for c in bounds),
        F.when(F.col("price").isNull(), F.struct(F.lit("price").alias("field"), F.lit("missing").alias("reason"), F.lit(None).cast("double").alias("raw_value"))),
    )
    bad = rows.select(F.col("id").alias("listing_id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("listing_id", "a.*")
    return clean, bad


#: What a user's entry never changes in a listing that is there.
NOT_BY_USERS = ("price", "title", "raw_params", "source", "first_seen", "is_active", "delisted_at")


def upsert_user(stored: DataFrame, entries: DataFrame, now: str, key: str = "id") -> DataFrame:
    """Merge what users entered about listings: other columns than NOT_BY_USERS are filled in, and the listing was seen now.

    A listing that is gone stays gone and no price changes, so there are no points for the price log; a new one comes in
    as it was entered, with the source 'user'.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    batch = entries.withColumn("last_seen", moment)
    if "source" in stored.columns:
        batch = batch.withColumn("source", F.lit("user"))
    return upsert(stored, batch, key, keep=tuple(c for c in NOT_BY_USERS if c in batch.columns))


def replace_by_key(rows: DataFrame, *key: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def insert_or_ignore(stored: DataFrame, batch: DataFrame, *key: str) -> DataFrame:
    """Stored rows and those of the batch with a new key; of rows with one key the least by its other columns counts."""
    others = [c for c in batch.columns if c not in key]
    once = batch.groupBy(*key).agg(F.min(F.struct(*others)).alias("_x")).select(*key, "_x.*").select(*batch.columns) if others else batch.distinct()
    return stored.unionByName(once.join(stored.select(*key), list(key), "left_anti"))


def streaks(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """A counter that rises while ``hit`` holds and falls to 0 where it doesn't."""
    run = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.when(hit, 0).otherwise(1)).over(run)
    rows = rows.withColumn("_i", island)
    return rows.withColumn("streak", F.sum(F.when(hit, 1).otherwise(0)).over(Window.partitionBy(key, "_i").orderBy(order))).drop("_i")


def keep_last(rows: DataFrame, n: int, order: str, *key: str) -> DataFrame:
    """The n rows of each key (or of all) that come last in order; equal ones by their other columns, greatest first."""
    by = [F.desc(order), *(F.desc(c) for c in rows.columns if c not in (order, *key))]
    if not key:
        return rows.orderBy(*by).limit(n)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*by))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def initial_cohort(listings: DataFrame, days: int = 2) -> DataFrame:
    """Mark what was first seen within days of the very first as the initial load, where no cohort is set."""
    first = listings.agg(F.min("first_seen").alias("_first"))
    early = F.col("first_seen") <= F.col("_first") + F.expr(f"interval {days} days")
    return listings.crossJoin(F.broadcast(first)).withColumn("first_seen_cohort", F.coalesce("first_seen_cohort", F.when(early, F.lit("initial")))).drop("_first")


def gap_cohort(listings: DataFrame, start: str, stop: str, expected: tuple[int, int] | None = None) -> DataFrame:
    """Mark rows first seen in [start, stop) with the gap's cohort where none is set; doing it again changes nothing.

    With ``expected`` the rows of the window, marked or not, are counted first; a number beyond it raises an error.
    """
    within = (F.col("first_seen") >= F.lit(start).cast("timestamp_ntz")) & (F.col("first_seen") < F.lit(stop).cast("timestamp_ntz"))
    if expected is not None and not expected[0] <= (n := listings.where(within).count()) <= expected[1]:
        raise ValueError(f"{n} rows between {start} and {stop}; {expected[0]} to {expected[1]} are expected")
    return listings.withColumn("first_seen_cohort", F.coalesce("first_seen_cohort", F.when(within, F.lit(f"gap:{start[:10]}"))))


def three_way(remote: DataFrame, local: DataFrame, deleted: DataFrame, *key: str) -> DataFrame:
    """Remote state, overridden by touched local keys, less deleted ones."""
    kept = remote.join(local.select(*key), list(key), "left_anti")
    return kept.unionByName(local).join(deleted.select(*key), list(key), "left_anti")


def max_merge(a: DataFrame, b: DataFrame, key: tuple[str, ...], counter: str, members: str) -> DataFrame:
    """Merge of counters by maximum and of member sets by union; the order of merges doesn't matter."""
    both = a.unionByName(b)
    return both.groupBy(*key).agg(F.max(counter).alias(counter), F.array_sort(F.array_distinct(F.flatten(F.collect_set(members)))).alias(members))


def monotone(a: DataFrame, b: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row with the greater version; the first table wins ties."""
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(0)))
    return replace_by_key(both, key, order=(version, "_s")).drop("_s")


def keep_snapshots(snapshots: DataFrame, now: str, days: int) -> DataFrame:
    """Snapshots not older than days, and all of Sundays."""
    day = F.col("day")
    return snapshots.where((day >= F.date_sub(F.lit(now).cast("date"), days)) | (F.dayofweek(day) == 1))
