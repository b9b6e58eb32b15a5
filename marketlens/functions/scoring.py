"""Targets, weights, intervals and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived(year: int) -> dict[str, Column]:
    """Features of a listing's columns in a year; flags are 0, never missing."""
    flag = lambda ok: F.coalesce(ok, F.lit(False)).cast("int")
    age = F.when(F.col("year_built").isNotNull(), F.greatest(year - F.col("year_built"), F.lit(-5)))
    return {
        "floor_ratio": F.round(F.try_divide(F.col("floor").cast("double"), F.col("total_floors").cast("double")), 6),
        "is_first_floor": flag(F.col("floor") == 1),
        "is_last_floor": flag(F.col("floor") == F.col("total_floors")),
        "building_age": age,
        "is_new_building": flag((F.col("category") == "novostroiki") | F.coalesce(age <= 1, F.lit(False)) | F.coalesce(F.col("user_type") == "complex", F.lit(False))),
        "is_panel_age": flag((F.col("building_type") == "panel") & F.col("year_built").between(1960, 1990)),
        "log_price": F.round(F.log1p(F.col("price").cast("double")), 6),
    }


def freshness_weight(age_days: Column, half_life: float) -> Column:
    """0.5 ** (age / half-life), 1 for a missing age; no age is below 0."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / half_life), F.lit(1.0))


def interval(point: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds in order that hold the point."""
    return F.least(low, high, point), F.greatest(low, high, point)


def widened(low: Column, high: Column, scale: float, floor: float = -30.0, ceiling: float = 30.0) -> tuple[Column, Column]:
    """Both bounds (of logs) moved out by ``scale`` times the width, within limits."""
    by = F.greatest(F.least(scale * (high - low), F.lit(ceiling)), F.lit(floor))
    return low - by, high + by


def verdict(price: Column, low: Column, high: Column) -> Column:
    return F.when(price < low, "good").when(price > high, "high").when(price.isNotNull(), "fair")


def verdict_by_share(price: Column, fair: Column, share: float = 0.1) -> Column:
    """The verdict where only a point estimate is known: more than a share below or above it."""
    off = F.try_divide(price - fair, fair)
    return F.when(off < -share, "good").when(off > share, "high").when(off.isNotNull(), "fair")


def deviation_pct(price: Column, fair: Column) -> Column:
    return F.bround(F.try_divide((price - fair) * 100.0, fair), 1) + F.lit(0.0)  # no negative zero


def price_band(diff_pct: Column) -> Column:
    return F.when(diff_pct <= -5, "below").when(diff_pct < 5, "near").when(diff_pct.isNotNull(), "above")


def rounded(price: Column, deal: Column) -> Column:
    """Sales to 10,000, rents to 1,000, half to even."""
    return F.when(deal == "rent", F.bround(price, -3)).otherwise(F.bround(price, -4))


def scam_level(price: Column, low: Column, days: Column) -> Column:
    """``high`` for a new listing (7 days) far below the fair interval (15 %), ``medium`` for any other below it, else null."""
    below = F.when((low > 0) & (price != 0) & (price < low), (1 - price / low) * 100)
    return F.when((below >= 15) & F.coalesce(days <= 7, F.lit(False)), "high").when(below.isNotNull(), "medium")


def log_mean(a: Column, b: Column) -> Column:
    """Logarithmic mean of two positive numbers (their own value where they are equal)."""
    return F.when(F.abs(a - b) < 1e-9, a).otherwise((a - b) / (F.log(a) - F.log(b)))


def shard_label(district: Column, rooms: Column) -> Column:
    """District and rooms, four and more as one."""
    return F.concat(district, F.lit(" "), F.when(rooms >= 4, "4+").otherwise(rooms.cast("string")))


def deal_of(explicit: Column, price: Column, keys: Column, rent_keys: tuple[str, ...], sale_keys: tuple[str, ...], ceiling: int, floor: int) -> Column:
    """The deal as stated; else a price below the ceiling is a rent; then the parameters and the price floor of sales decide."""
    return (
        F.when(explicit.isin("sale", "rent"), explicit)
        .when(price < ceiling, "rent")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, rent_keys))), "rent")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, sale_keys))), "sale")
        .when(price < floor, "rent")
        .otherwise("sale")
    )
