"""Market statistics: exact medians by group, histograms, grids and summaries.

``listings`` has at least price, area and the columns that a function groups by; a missing price or area leaves a row
out of what needs it. Medians are exact and interpolated; money medians are cut to whole units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.quantiles import summarise

#: The edges of price bins in millions; the last upper bound is only that of the label's open end.
SALE_BINS = (0, 20, 30, 40, 50, 60, 80, 100, 150, 250, 10_000)
#: Weeks of a trend.
WEEKS = 12


def unit_price() -> Column:
    return F.try_divide(F.col("price"), F.col("area"))


def active(listings: DataFrame) -> DataFrame:
    """Active listings with a price and a positive area, with their unit price."""
    return listings.where("is_active = 1 and price > 0 and area > 0").withColumn("ppsm", unit_price())


def totals(listings: DataFrame) -> DataFrame:
    """Count and medians of the active listings; zeros if there are none."""
    found = summarise(active(listings), (), [F.count("*").alias("total")], {"median_price": F.col("price"), "median_ppsm": F.col("ppsm")})
    return found.select("total", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("median_price", "median_ppsm")))


def by_group(listings: DataFrame, *keys: str) -> DataFrame:
    """Count and medians for each value of the keys; rows without a key value are left out."""
    rows = active(listings).dropna(subset=list(keys))
    found = summarise(rows, keys, [F.count("*").alias("n")], {"median_ppsm": F.col("ppsm"), "median_price": F.col("price")})
    return found.withColumns({c: F.col(c).cast("long") for c in ("median_ppsm", "median_price")})


def by_rooms(listings: DataFrame, most: int = 6) -> DataFrame:
    return by_group(listings.where(F.col("rooms").between(1, most)), "rooms").drop("median_ppsm")


def category_split(listings: DataFrame) -> DataFrame:
    """New buildings against everything else (no category included)."""
    new = F.coalesce(F.col("category") == "novostroiki", F.lit(False))
    return active(listings).groupBy(F.when(new, "new").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


def price_histogram(listings: DataFrame, edges: tuple[int, ...] = SALE_BINS, unit: int = 1_000_000) -> DataFrame:
    """Counts of left-closed bins; empty bins stay, prices from the last edge on are dropped."""
    spark = listings.sparkSession
    bins = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"), *(F.element_at(F.array(*map(F.lit, edges)), (F.col("id") + i).cast("int")).alias(x) for i, x in ((1, "low"), (2, "high"))))
    bin_of = sum((F.col("price") >= e * unit).cast("int") for e in edges) - 1
    counts = active(listings).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def unit_price_histogram(listings: DataFrame, bins: int = 38) -> DataFrame:
    """Equal bins from the 1st to the 99th percentile; what lies beyond goes to the end bins.

    Bins are right-closed, the first also left-closed. If all prices are equal the bounds are 1 % around them.
    """
    rows = active(listings).select("ppsm")
    q = summarise(rows, (), [F.min("ppsm").alias("a"), F.max("ppsm").alias("b")], {"q": F.col("ppsm")}, at=(0.01, 0.99))
    flat = F.col("q")[1] <= F.col("q")[0]
    bounds = q.where("q is not null").select(F.when(flat, F.col("a") * 0.99).otherwise(F.col("q")[0]).alias("lo"), F.when(flat, F.col("b") * 1.01).otherwise(F.col("q")[1]).alias("hi"))
    placed = rows.crossJoin(F.broadcast(bounds)).withColumn("step", (F.col("hi") - F.col("lo")) / bins)  # one row
    clipped = F.least(F.greatest("ppsm", "lo"), "hi")
    place = F.greatest(F.least(F.ceil((clipped - F.col("lo")) / F.col("step")) - 1, F.lit(bins - 1)), F.lit(0))
    counts = placed.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dim = bounds.crossJoin(listings.sparkSession.range(bins)).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    edge = lambda i: F.bround(F.col("lo") + F.col("step") * (F.col("id") + i)).cast("long")
    return dim.select(F.col("id").cast("int").alias("bin"), edge(0).alias("from_ppsm"), edge(1).alias("to_ppsm")).join(counts, "bin", "left").select("bin", "from_ppsm", "to_ppsm", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(listings: DataFrame, cell: float = 0.004, least: int = 2) -> DataFrame:
    """Mean unit price of grid cells with at least ``least`` active listings; the cell is given by whole numbers."""
    rows = active(listings).where("lat is not null and lon is not null")
    at = lambda c: F.round(F.col(c) / cell).cast("long").alias(f"{c}_cell")
    return rows.groupBy(at("lat"), at("lon")).agg(F.count("*").alias("n"), F.round(F.avg("ppsm"), 4).alias("ppsm")).where(F.col("n") >= least)


def shared_pins(listings: DataFrame, least: int = 5, digits: int = 5) -> DataFrame:
    """Points (to some decimals) that many listings share, as whole numbers."""
    at = lambda c: F.round(F.col(c) * 10**digits).cast("long").alias(f"{c}_pin")
    return listings.where("lat is not null and lon is not null").groupBy(at("lat"), at("lon")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def target_maps(listings: DataFrame) -> DataFrame:
    """Median unit price by district, by microdistrict and over all, in one pass; a missing name is 'unknown'."""
    rows = listings.where("price > 0 and area > 0").select(*(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("district", "microdistrict")), unit_price().alias("ppsm"))
    sets = [["district"], ["microdistrict"], []]
    grouped = summarise(rows, ("district", "microdistrict"), [], {"m": F.col("ppsm")}, sets=sets)
    level = F.when(F.col("g") == 1, "district").when(F.col("g") == 2, "microdistrict").otherwise("all")
    return grouped.select(level.alias("level"), F.coalesce("district", "microdistrict", F.lit("")).alias("name"), F.round("m", 4).alias("median_ppsm"))


def segment_medians(listings: DataFrame, year: int = 2001) -> DataFrame:
    """Median unit prices of floor classes, ages and areas, of districts and of the city: one pass for all classes."""
    p, age = F.col("ppsm"), year - F.col("year_built")
    tall = F.col("total_floors") >= 5
    classes = {
        "floor_first": tall & (F.col("floor") == 1),
        "floor_last": tall & (F.col("floor") == F.col("total_floors")),
        "floor_middle": tall & (F.col("floor") > 1) & (F.col("floor") < F.col("total_floors")),
        "age_new": (age >= 0) & (age < 5),
        "age_middle": (age >= 5) & (age < 25),
        "age_old": (age >= 25) & (age < 200),
        "area_small": F.col("area") < 40,
        "area_middle": (F.col("area") >= 40) & (F.col("area") < 70),
        "area_large": (F.col("area") >= 70) & (F.col("area") < 1000),
        "city": F.lit(True),
    }
    found = summarise(active(listings), (), [], {name: F.when(ok, p) for name, ok in classes.items()})
    wide = found.select(*(F.round(name, 4).alias(name) for name in classes))
    return wide.unpivot([], list(classes), "segment", "median_ppsm")


def summary(listings: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Stock, flow of the last days and medians in one row."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    on = F.col("is_active") == 1
    flow = [
        F.count("*").alias("total"),
        F.count_if(on).alias("active"),
        F.count_if(F.col("first_seen") >= since).alias("inflow"),
        F.count_if((F.col("delisted_at") >= since) & ~on).alias("outflow"),
        *(F.count_if(on & (F.col("rooms") == r)).alias(f"rooms_{r}") for r in (1, 2, 3)),
        F.count_if(on & (F.col("rooms") >= 4)).alias("rooms_4_up"),
    ]
    return summarise(listings, (), flow, {"median_price": F.when(on, F.col("price"))}).withColumn("median_price", F.col("median_price").cast("long"))


def top_districts(listings: DataFrame, n: int = 5) -> DataFrame:
    rows = listings.where("is_active = 1 and district is not null").groupBy("district").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "district").limit(n)


def rent_yield(rents: DataFrame, sales: DataFrame) -> DataFrame:
    """Medians of rents by district, and 12 * rent / price a unit in per cent where sales exist."""
    per = lambda rows, name: summarise(active(rows).dropna(subset=["district"]), ("district",), [F.count("*").alias(f"n_{name}")], {f"{name}_ppsm": F.col("ppsm")})
    joined = per(rents, "rent").join(per(sales, "sale"), "district", "left")
    return joined.select("district", "n_rent", F.round("rent_ppsm", 4).alias("rent_ppsm"), F.round(F.try_divide(12 * F.col("rent_ppsm"), F.col("sale_ppsm")) * 100, 1).alias("gross_yield_pct"))


def recent_medians(listings: DataFrame, now: str, days: int = 60) -> DataFrame:
    """Median unit price of what was seen lately, by district and by district and rooms (4 and more as one)."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    rows = listings.where((F.col("last_seen") >= since) & (F.col("price") > 0) & (F.col("area") > 0)).dropna(subset=["district"])
    rows = rows.select("district", F.least("rooms", F.lit(4)).alias("rooms"), unit_price().alias("ppsm"))
    return summarise(rows, ("district", "rooms"), [F.count("*").alias("n")], {"ppsm": F.col("ppsm")}, sets=[["district"], ["district", "rooms"]])


def district_yield(rents: DataFrame, sales: DataFrame, now: str, least: int = 30, days: int = 60) -> DataFrame:
    """Yield by district and rooms if both sides have enough rows, else by district; the scope says which."""
    r, s = (recent_medians(x, now, days) for x in (rents, sales))
    both = r.select("district", "rooms", "g", F.col("n").alias("n_rent"), F.col("ppsm").alias("rent")).join(s.select("district", F.col("rooms").alias("rooms_s"), F.col("g").alias("g_s"), F.col("n").alias("n_sale"), F.col("ppsm").alias("sale")), "district")
    both = both.where("g = g_s and rooms <=> rooms_s").where((F.col("n_rent") >= least) & (F.col("n_sale") >= least))
    fine, coarse = both.where("g = 0"), both.where("g = 1")
    value = F.try_divide(12 * F.col("rent"), F.col("sale")) * 100
    fine = fine.select("district", "rooms", value.alias("fine"))
    coarse = coarse.select("district", value.alias("coarse"))
    wanted = r.where("g = 0").select("district", "rooms")
    found = wanted.join(fine, ["district", "rooms"], "left").join(coarse, "district", "left")
    scope = F.when(F.col("fine").isNotNull(), "district_rooms").when(F.col("coarse").isNotNull(), "district")
    return found.select("district", "rooms", F.round(F.coalesce("fine", "coarse"), 2).alias("yield_pct"), scope.alias("scope")).where("yield_pct is not null")


def duration_medians(listings: DataFrame) -> DataFrame:
    """Days on the market of organic episodes that were seen to end: by district and rooms, by district, over all.

    An episode counts if it lasted a day, was found gone within a week of its last sighting and didn't come with a bulk
    load (no cohort).
    """
    days = lambda a, b: (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 86_400_000_000
    rows = listings.where("is_active = 0 and delisted_at is not null and first_seen_cohort is null").where((days("last_seen", "first_seen") >= 1) & (days("delisted_at", "last_seen") <= 7))
    rows = rows.select("district", "rooms", days("last_seen", "first_seen").alias("days"))
    return summarise(rows, ("district", "rooms"), [F.count("*").alias("n")], {"days": F.col("days")}, sets=[["district", "rooms"], ["district"], []])


def liquidity(listings: DataFrame, least: int = 15, least_city: int = 30) -> DataFrame:
    """Median days on the market for each district and number of rooms, or the city's where there are too few."""
    levels = duration_medians(listings)
    fine = levels.where((F.col("g") == 0) & (F.col("n") >= least)).dropna(subset=["district"]).select("district", "rooms", F.col("days").alias("own"), F.col("n").alias("n_own"))
    city = levels.where((F.col("g") == 3) & (F.col("n") >= least_city)).select(F.col("days").alias("city"), F.col("n").alias("n_city"))
    wanted = listings.dropna(subset=["district", "rooms"]).select("district", "rooms").distinct()
    joined = wanted.join(fine, ["district", "rooms"], "left").crossJoin(F.broadcast(city))  # at most one row
    scope = F.when(F.col("own").isNotNull(), "district_rooms").otherwise("city")
    return joined.select("district", "rooms", F.bround(F.coalesce("own", "city")).cast("long").alias("days"), F.coalesce("n_own", "n_city").alias("n"), scope.alias("scope"))
