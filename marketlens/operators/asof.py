"""As-of lookups and reconstructions over the price log (listing_id, price, observed_at, and seq for ties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.operators.quantiles import summarise


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def last_price(history: DataFrame, cutoff: str) -> DataFrame:
    """Each listing's last price strictly before the cut-off."""
    before = history.where(F.col("observed_at") < moment(cutoff))
    return before.groupBy("listing_id").agg(F.max_by("price", F.struct("observed_at", "seq")).alias("price"))


_WEEK = 7 * 86_400_000_000


def _each_week(rows: DataFrame, start: Column, stop: Column, now: str, weeks: int) -> DataFrame:
    """Rows with t (0 is the oldest of the last whole weeks), one for each week whose end lies in (start, stop].

    The first and last such week come from arithmetic, so rows that touch none are dropped before anything is exploded.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    last = micros(F.date_trunc("week", moment(now)))
    low = F.greatest(F.floor(weeks - 1 - (last - micros(start)) / _WEEK) + 1, F.lit(0)).cast("int")
    high = F.coalesce(F.least(F.floor(weeks - 1 - (last - micros(stop)) / _WEEK), F.lit(weeks - 1)), F.lit(weeks - 1)).cast("int")
    placed = rows.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    return placed.withColumn("t", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def weekly_prices(history: DataFrame, now: str, weeks: int = 12) -> DataFrame:
    """listing_id, t and the price at the end of each week: each point holds until the next, so no join is needed."""
    nxt = F.lead("observed_at").over(Window.partitionBy("listing_id").orderBy("observed_at", "seq"))
    valid = history.where("price > 0").withColumn("until", nxt)
    return _each_week(valid, F.col("observed_at"), F.col("until"), now, weeks).select("listing_id", "price", "t")


def weekly_trend(listings: DataFrame, history: DataFrame, now: str, weeks: int = 12, least: int = 100, by: str | None = None) -> DataFrame:
    """Median unit price of the listings alive in each week, at the price known at its end.

    A listing is alive if it was first seen before the week's end and last seen at or after its start. A week needs
    ``least`` such listings, with a price too; t is the calendar number of the week, gaps included.
    """
    keys = [by] if by else []
    rows = listings.where("area > 0 and price > 0 and first_seen is not null")
    last = F.coalesce("last_seen", "first_seen")
    rows = _each_week(rows, F.col("first_seen"), last + F.expr("interval 7 days"), now, weeks).select("id", "area", *keys, "t")
    prices = weekly_prices(history, now, weeks).alias("h")
    priced = rows.alias("l").join(prices, (F.col("l.id") == F.col("h.listing_id")) & (F.col("l.t") == F.col("h.t")), "left")
    flat = priced.select(*keys, F.col("l.t").alias("t"), "area", F.col("h.price").alias("paid"))
    counts = [F.count("*").alias("alive"), F.count("paid").alias("n")]
    grouped = summarise(flat, (*keys, "t"), counts, {"median_ppsm": F.col("paid") / F.col("area")}).withColumn("median_ppsm", F.col("median_ppsm").cast("long"))
    return grouped.where((F.col("alive") >= least) & (F.col("n") >= least)).select(*keys, "t", "median_ppsm", "n")


def index_at(index: DataFrame, moments: DataFrame, value: str = "value", week: str = "week", at: str = "at") -> DataFrame:
    """The index of each moment's week, else of the latest week before it, else the global value (week is null).

    Weeks and moments are put in one order and the last known value is carried on, so nothing is paired out.
    """
    points = index.where(F.col(week).isNotNull()).select(F.col(week).alias("_w"), F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.lit(None).cast("long").alias("key"))
    asked = moments.select(F.date_trunc("week", F.col(at)).cast("timestamp_ntz").alias("_w"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_v"), F.col("key").cast("long"))
    # The weeks of an index are few; the moments of one week are alike, so each week is asked once.
    weeks = asked.select("_w").distinct().select("_w", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_v"))
    order = Window.orderBy("_w", "_kind")
    known = points.drop("key").union(weeks).withColumn("_known", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1").select("_w", "_known")
    overall = index.where(F.col(week).isNull()).agg(F.first(value).alias("_global"))
    return asked.join(known, "_w", "left").crossJoin(F.broadcast(overall)).select("key", F.coalesce("_known", "_global").alias("value"))


def asof_interval(history: DataFrame) -> DataFrame:
    """Each price with the half-open interval in which it holds."""
    nxt = F.lead("observed_at").over(Window.partitionBy("listing_id").orderBy("observed_at", "seq"))
    return history.select("listing_id", "price", F.col("observed_at").alias("valid_from"), nxt.alias("valid_to"))


def change_log(history: DataFrame, jump: float = 0.6) -> DataFrame:
    """The points that differ from the one before (the first always), with a flag for a jump of more than ``jump``."""
    before = F.lag("price").over(Window.partitionBy("listing_id").orderBy("observed_at", "seq"))
    rows = history.where("price is not null").withColumn("before", before).where("before is null or price <> before")
    leap = F.coalesce(F.abs(F.col("price") - F.col("before")) > jump * F.col("before"), F.lit(False))
    return rows.select("listing_id", "seq", "price", "before", leap.alias("jump"))


def backfill_first_points(listings: DataFrame, history: DataFrame) -> DataFrame:
    """A first point at first_seen for priced listings without any history that users didn't enter."""
    rows = listings.where("price is not null and source <> 'user'")
    missing = rows.join(history.select(F.col("listing_id").alias("id")).distinct(), "id", "left_anti")
    return missing.select(F.col("id").alias("listing_id"), "price", F.date_format("first_seen", "yyyy-MM-dd").alias("day"))
