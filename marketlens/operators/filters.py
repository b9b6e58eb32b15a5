"""Contracts, filters and feature frames over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import scoring, text

#: Box of the city, with what counts as outside.
BOX = {"lat": (43.12, 43.38), "lon": (76.75, 77.15)}


def clean(rows: DataFrame, price: tuple[int, int] = (500_000, 45_000_000), ppsm: tuple[int, int] = (10_000, 1_000_000), area: tuple[int, int] = (22, 125)) -> DataFrame:
    """Rows with a price, an area and a unit price within bounds, both ends included."""
    unit = F.try_divide(F.col("price"), F.col("area"))
    return rows.where(F.col("price").between(*price) & F.col("area").between(*area) & unit.between(*ppsm))


def current(rows: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Active rows (a missing flag is active) or lately gone ones, in the city's box or without coordinates."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    fresh = (F.coalesce("is_active", F.lit(1)) == 1) | F.coalesce(F.col("delisted_at") >= since, F.lit(False))
    inside = F.col("lat").between(*BOX["lat"]) & F.col("lon").between(*BOX["lon"])
    return rows.where(fresh & (F.col("lat").isNull() | F.col("lon").isNull() | inside))


#: Bounds of numbers by the rule, both ends included; years go up to so many after the current one.
BOUNDS = {"floor": (1, 100), "total_floors": (1, 100), "ceiling": (2.0, 5.0), "rooms": (1, 10)}
FIRST_YEAR, YEARS_AHEAD = 1930, 3


def sanitized(rows: DataFrame, year: int | None = None, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Numbers out of range become missing; so do a floor above the top and both coordinates of a bad pair.

    ``bounds`` replaces those of some columns; ``year`` is the current one, else the session's clock tells.
    """
    within = lambda c, a, b: F.when(F.col(c).between(a, b), F.col(c))
    last = F.year(F.current_date()) + YEARS_AHEAD if year is None else F.lit(year + YEARS_AHEAD)
    every = BOUNDS | {"year_built": (FIRST_YEAR, last)} | (bounds or {})
    rows = rows.withColumns({c: within(c, a, b) for c, (a, b) in every.items() if c in rows.columns})
    pair = F.col("lat").between(*BOX["lat"]) & F.col("lon").between(*BOX["lon"])
    return rows.withColumns({"floor": F.when(~F.coalesce(F.col("floor") > F.col("total_floors"), F.lit(False)), F.col("floor")), "lat": F.when(pair, F.col("lat")), "lon": F.when(pair, F.col("lon"))})


def params_frame(rows: DataFrame) -> DataFrame:
    """Features of the JSON parameters: normalised categories, counts of items and flags; malformed JSON is empty."""
    m = text.params("raw_params")
    rows = rows.withColumn("_m", m)
    security = F.try_element_at(F.col("_m"), F.lit("flat.security"))
    balcony, loggia = (text.count_of(F.try_element_at(F.col("_m"), F.lit(k))) for k in ("balcony", "loggia"))
    counted = F.when(balcony.isNotNull() | loggia.isNotNull(), F.format_string("b%d_l%d", F.coalesce(balcony, F.lit(-1)), F.coalesce(loggia, F.lit(-1))))
    return rows.select(
        "id",
        text.category(text.either(F.col("_m"), "flat.toilet", "flat.wc")).alias("toilet"),
        F.coalesce(F.try_element_at(F.col("_m"), F.lit("map.complex")), "complex_name").alias("complex"),
        text.items_in(security).alias("security_items"),
        F.coalesce(security.contains("video"), F.lit(False)).cast("int").alias("has_video"),
        balcony.alias("balconies"),
        F.coalesce(counted, F.lit("unknown")).alias("balcony_kind"),
        text.category("building_type").alias("building"),
        F.size(F.map_keys("_m")).alias("n_params"),
    )


def feature_frame(rows: DataFrame, year: int, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return sanitized(rows, year, bounds).select("id", *(c.alias(k) for k, c in scoring.derived(year).items()))


def new_listings(rows: DataFrame, alerted: DataFrame, now: str) -> DataFrame:
    """First seen in the last 26 hours, or found again lately within a week of that, and not alerted before."""
    moment = F.lit(now).cast("timestamp_ntz")
    first, last = F.col("first_seen"), F.col("last_seen")
    recent = (first >= moment - F.expr("interval 26 hours")) | ((last >= moment - F.expr("interval 26 hours")) & (first >= moment - F.expr("interval 7 days")))
    return rows.where(recent).join(alerted, "id", "left_anti")


def delist_guarded(rows: DataFrame, now: str, days: int = 3, most: float = 0.3, covered: bool = True) -> DataFrame:
    """Active rows unseen for days are marked gone, unless that would be more than a share of all active ones.

    Nothing is marked if the pass hasn't ``covered`` all shards.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    on = F.col("is_active") == 1
    gone = on & (F.col("last_seen") < moment - F.expr(f"interval {days} days"))
    share = rows.agg(F.try_divide(F.count_if(gone), F.count_if(on)).alias("_share"))
    apply: Column = F.lit(covered) & gone & (F.coalesce("_share", F.lit(0.0)) <= most)
    return rows.crossJoin(F.broadcast(share)).withColumn("gone", F.coalesce(apply, F.lit(False)))  # one row


def refresh_queue(rows: DataFrame, now: str, days: int, n: int) -> DataFrame:
    """The n active rows with details that were read longest ago."""
    old = F.col("last_seen") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return rows.where((F.col("is_active") == 1) & F.col("title").isNotNull() & old).orderBy("last_seen", "id").limit(n)


def as_of(rows: DataFrame, moment: str, days: int = 90) -> DataFrame:
    """The rows as they were known at a moment: first seen by then (or at an unknown time), and current then."""
    known = F.col("first_seen").isNull() | (F.col("first_seen") <= F.lit(moment).cast("timestamp_ntz"))
    return current(rows.where(known), moment, days)
