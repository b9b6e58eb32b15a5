"""Ingestion planning: shards, timings, gaps, alarms and the checks of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.operators.quantiles import summarise


def shard_grid(districts: DataFrame, groups: tuple[str, ...] = ("1", "2", "3", "4+")) -> DataFrame:
    """Every district with every group of rooms (both lists are short)."""
    rooms = F.explode(F.array(*map(F.lit, groups)))
    return districts.select("district", rooms.alias("rooms")).withColumn("shard", F.concat_ws(" ", "district", "rooms"))


def shard_district(shard: Column) -> Column:
    """A shard's label without its last token."""
    return F.regexp_replace(shard, r"\s+\S+$", "")


def timings(runs: DataFrame, key: str, n: int = 7, expected: float = 4.0, floor: float = 0.1, fallback: float = 0.5) -> DataFrame:
    """Median overhead a request of the last n runs (seconds a request less the expected pause), not below a floor."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("started_at"), F.desc("run_id")))
    last = runs.where("requests > 0").withColumn("_r", rank).where(F.col("_r") <= n)
    over = F.median(F.col("search_seconds") / F.col("requests") - expected)
    return last.groupBy(key).agg(F.round(F.greatest(F.coalesce(over, F.lit(fallback)), F.lit(floor)), 4).alias("overhead"), F.median("found").cast("long").alias("inflow"))


def freshness(runs: DataFrame, listings: DataFrame, deal: str) -> DataFrame:
    """The end of a deal's last run in unix seconds; without runs, when a listing that no user entered was last seen."""
    own = runs.where(F.coalesce("deal", F.lit("sale")) == deal)
    micros = F.unix_micros(F.col("started_at").cast("timestamp")) + F.floor(F.col("search_seconds") * 1_000_000)
    ended = own.agg(F.max_by(micros, F.struct("started_at", "run_id")).alias("end"))
    seen = listings.where(f"source <> 'user' and deal = '{deal}'").agg(F.max(F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("seen"))
    return ended.crossJoin(seen).select(F.floor(F.coalesce("end", "seen") / 1_000_000).alias("observed_at"))  # one row each


def observation_gap(listings: DataFrame, now: str, days: float = 2.5) -> DataFrame:
    """Days since an active listing that no user entered was last seen, and if that asks for recovery."""
    last = listings.where("is_active = 1 and source <> 'user'").agg(F.max(F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("m"))
    gap = (F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.col("m")) / 86_400_000_000
    return last.select(F.round(gap, 4).alias("gap_days"), F.coalesce(gap > days, F.lit(False)).alias("recovery"))


def cap_hits(runs: DataFrame, key: str, cap: Column, n: int = 3) -> DataFrame:
    """Whether the last n runs of a key all took their cap with a queue left."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("run_id")))
    last = runs.withColumn("_r", rank).where(F.col("_r") <= n)
    hit = F.coalesce((F.col("quota") >= cap) & (F.col("backlog") > 0), F.lit(False))
    return last.groupBy(key).agg(F.count_if(hit).alias("hits"), (F.count_if(hit) == n).alias("alarm"))


def degradation(runs: DataFrame, key: str, n: int = 7, share: float = 0.5) -> DataFrame:
    """Runs that found less than a share of the median of the n runs before them."""
    run = Window.partitionBy(key).orderBy("run_id").rowsBetween(-n, -1)
    # A median has no frame in Spark: the n values are a short list, whose middle is taken.
    rows = runs.withColumn("_l", F.array_sort(F.collect_list("found").over(run))).where(F.size("_l") > 0)
    middle = (F.element_at("_l", F.expr("(size(_l) + 1) div 2").cast("int")) + F.element_at("_l", F.expr("size(_l) div 2 + 1").cast("int"))) / 2
    rows = rows.withColumn("usual", middle)
    return rows.where(F.col("found") < share * F.col("usual")).select(key, "run_id", "found", F.round("usual", 4).alias("usual"))


def zero_details(runs: DataFrame) -> DataFrame:
    """Runs with a plan that fetched nothing and weren't banned."""
    return runs.where("quota > 0 and found = 0 and banned = 0").select("run_id", "shard")


def data_gaps(runs: DataFrame, hours: float) -> DataFrame:
    """Pauses between runs of more than some hours.

    Runs are put in slots of that length: a longer pause can't begin and end in one slot, so the first and last run of
    each are enough, a row a slot.
    """
    length = int(hours * 3_600_000_000)
    micros = F.unix_micros(F.col("started_at").cast("timestamp"))
    slots = runs.groupBy(F.floor(micros / length).alias("slot")).agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    before = F.lag("last").over(Window.orderBy("slot"))
    return slots.withColumn("gap_start", before).where(F.col("first") - F.col("gap_start") > length).select("gap_start", F.col("first").alias("gap_end"))


def budget_split(shards: DataFrame, total: int, reserve: float = 0.1, least: int = 1) -> DataFrame:
    """A pass's requests for each shard: a reserve is kept back, the rest is shared by stock, at least one each."""
    free = int(total * (1 - reserve))
    part = F.sum("stock").over(Window.partitionBy(F.lit(1)))  # a planning table
    share = F.floor(F.coalesce(F.try_divide(F.col("stock") * free, part), F.lit(0)))
    return shards.withColumn("requests", F.greatest(share, F.lit(least)).cast("long"))


def invariants(listings: DataFrame, history: DataFrame) -> DataFrame:
    """A day's checks as (name, value, ok)."""
    values = listings.agg(
        F.count("*").alias("rows"), F.count_if(F.col("price") <= 0).alias("bad_prices"), F.count_if((F.col("is_active") == 1) & F.col("delisted_at").isNotNull()).alias("active_and_gone"),
        F.count_if(F.col("last_seen") < F.col("first_seen")).alias("seen_backwards"),
    ).crossJoin(history.agg(F.count("*").alias("points"), F.count_if(F.col("price").isNull()).alias("empty_points")))  # fmt: skip  one row each
    ok = {"rows": F.col("rows") > 0, "points": F.col("points") > 0} | {c: F.col(c) == 0 for c in ("bad_prices", "active_and_gone", "seen_backwards", "empty_points")}
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), v.alias("ok")) for k, v in ok.items()))
    return values.select(F.explode(rows).alias("x")).select("x.*")


def activity(events: DataFrame, now: str, user: str, at: str, spans: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Events and users of the last days, for several spans, in one pass."""
    end = F.lit(now).cast("timestamp_ntz")
    wide = []
    for d in spans:
        recent = F.col(at) >= end - F.expr(f"interval {d} days")
        wide += [F.count_if(recent).alias(f"events_{d}"), F.count_distinct(F.when(recent, F.col(user))).alias(f"users_{d}")]
    return events.where(F.col(at) < end).agg(*wide)


def busiest(events: DataFrame, at: str, n: int = 3) -> DataFrame:
    """The n hours of the day with most events."""
    return events.groupBy(F.hour(at).alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(n)


def tracked_events(tracked: DataFrame, listings: DataFrame, now: str, lag_days: int = 7) -> DataFrame:
    """What happened to tracked lots: a price change, or that they went lately (not if it was found too late)."""
    rows = tracked.join(listings.select("id", F.col("price").alias("price_now"), "is_active", "delisted_at", "last_seen"), "id", "left")
    late = F.unix_micros(F.col("delisted_at").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) > lag_days * 86_400_000_000
    kind = F.when(F.col("is_active").isNull(), "unknown").when((F.col("is_active") == 0) & F.col("delisted_at").isNotNull() & ~late, "gone").when(F.col("price_now") < F.col("price"), "cheaper").when(F.col("price_now") > F.col("price"), "dearer")
    return rows.withColumn("event", kind).where("event is not null").select("chat", "id", "event", F.bround(F.try_divide((F.col("price_now") - F.col("price")) * 100.0, F.col("price")), 1).alias("change_pct"))


def capped(tracked: DataFrame, most: int = 10) -> DataFrame:
    """The earliest lots of each chat, up to a number."""
    rank = F.row_number().over(Window.partitionBy("chat").orderBy("since", "id"))
    return tracked.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def delivered(lots: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Lots that all wanted chats have got."""
    got = lots.join(deliveries.select("id", "chat").distinct().withColumn("_got", F.lit(1)), ["id", "chat"], "left")
    return got.groupBy("id").agg(F.count("*").alias("wanted"), F.count("_got").alias("got")).withColumn("done", F.col("wanted") == F.col("got"))


def bars(rows: DataFrame, value: str, city: float | None = None) -> DataFrame:
    """Bar lengths in per cent of the greatest value, halves rounded up; with a city value the difference to it."""
    top = F.max(value).over(Window.partitionBy(F.lit(1)))  # a row a district
    out = rows.withColumn("bar", F.floor(F.col(value) * 100.0 / top + 0.5).cast("long"))
    return out if city is None else out.withColumn("delta_pct", F.floor((F.col(value) - city) * 100.0 / city + 0.5).cast("long"))


def best_filled(rows: DataFrame, key: str, attributes: tuple[str, ...], tie: str) -> DataFrame:
    """Of each key the record with most attributes, the first of equal ones."""
    filled = sum(F.col(a).isNotNull().cast("int") for a in attributes)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_f"), tie))
    return rows.withColumn("_f", filled).withColumn("_r", rank).where("_r = 1").drop("_r").withColumnRenamed("_f", "filled")


def upper_median(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """The upper median (a value that occurs, not an interpolated one) of each column, with the count."""
    out = None
    for v in values:
        # Ranks by window spill; no list of a key's values is built.
        w = Window.partitionBy(key)
        ranked = rows.where(F.col(v).isNotNull()).select(key, v, F.row_number().over(w.orderBy(v)).alias("_r"), F.count("*").over(w).alias("_n"))
        own = ranked.where(F.expr("_r = _n div 2 + 1")).select(key, F.col(v).alias(v), F.col("_n").alias(f"n_{v}"))
        out = own if out is None else out.join(own, key, "full")
    return out


def typical(rows: DataFrame, modes: tuple[str, ...], medians: tuple[str, ...]) -> DataFrame:
    """The commonest value (the smallest of equal ones) and the median of columns, in one row."""
    found = summarise(rows, (), [F.mode(c, True).alias(c) for c in modes], {c: F.col(c) for c in medians})
    return found.select(*modes, *(F.round(c, 4).alias(c) for c in medians))


def fill_typical(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Missing values (or 'unknown') from a row of typical ones."""
    names = values.columns
    one = values.select(*(F.col(c).alias(f"_t_{c}") for c in names))
    out = rows.crossJoin(F.broadcast(one))  # one row
    kinds = dict(rows.dtypes)
    return out.withColumns({c: F.coalesce(F.nullif(c, F.lit("unknown")) if kinds[c] == "string" else F.col(c), F.col(f"_t_{c}")) for c in names}).drop(*(f"_t_{c}" for c in names))


def fold_contributions(rows: DataFrame, groups: DataFrame, n: int = 5) -> DataFrame:
    """Contributions of features summed by group (a feature without one is its own), the n greatest of each row."""
    named = rows.join(F.broadcast(groups), "feature", "left").withColumn("group", F.coalesce("group", "feature"))  # a short list
    sums = named.groupBy("id", "group").agg(F.round(F.sum("value"), 9).alias("value")).where(F.abs("value") > 1e-9)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.abs("value")), "group"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def valid_replies(replies: DataFrame, expected: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """Replies for expected ids only, once each, with known flags in the fixed order."""
    once = replies.groupBy("id").agg(F.count("*").alias("_n"), F.first("flags").alias("flags")).where("_n = 1")
    known = F.array(*map(F.lit, flags))
    return once.join(expected.select("id"), "id", "left_semi").select("id", F.array_intersect(known, "flags").alias("flags"))
