"""What is shown of a listing: labelled details, hints, events, known values, and moments as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(c: Column | str) -> Column:
    """Unix seconds of an ISO text; without a zone it is UTC, malformed is null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    zoned = F.when(c.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_seconds(zoned.try_cast("timestamp"))


def is_quiet(seconds: Column, hours_east: int = 5, start: int = 22, stop: int = 8) -> Column:
    """Whether a moment (unix seconds) lies in the quiet hours of the zone, over midnight."""
    hour = F.floor(F.pmod(seconds + hours_east * 3600, F.lit(86_400)) / 3600)
    return (hour >= start) | (hour < stop)


def data_as_of(*texts: Column) -> Column:
    """The date of the first text that begins with one."""
    return F.coalesce(*(F.substring(t, 1, 10).try_cast("date") for t in texts))


def known_values(values: dict[str, Column]) -> Column:
    """A map of the values that are there; a missing one leaves its key out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def details(labels: dict[str, str], photos: Column | None = None, most: int = 5) -> Column:
    """A struct of (label, value) of the columns that have a non-empty value, in order, and the first photos."""
    items = F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for c, label in labels.items()))
    shown = F.filter(items, lambda x: F.coalesce(F.trim(x["value"]) != "", F.lit(False)))
    return F.struct(shown.alias("items"), (F.slice(photos, 1, most) if photos is not None else F.array().cast("array<string>")).alias("photos"))


def masked(chat: Column) -> Column:
    """A chat's number as stars and its last two digits, as logs are public; stars alone if there is no digit."""
    digits = F.regexp_replace(F.coalesce(chat.cast("string"), F.lit("")), r"[^0-9]", "")
    return F.concat(F.lit("***"), F.right(digits, F.lit(2)))


def ip_subject(ip: Column) -> Column:
    """Whom a limit counts: an IPv4 address (also one mapped into IPv6), or the first four groups of an IPv6 address."""
    low = F.lower(F.trim(ip))
    four = F.nullif(F.regexp_extract(low, r"^(?:::ffff:)?(\d+\.\d+\.\d+\.\d+)$", 1), F.lit(""))
    groups = lambda part: F.filter(F.split(part, ":"), lambda x: x != "")
    halves = F.split(low, "::")
    left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    every = F.concat(left, F.array_repeat(F.lit("0"), (8 - F.size(left) - F.size(right)).cast("int")), right)
    short = F.transform(F.slice(every, 1, 4), lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0")))
    return F.coalesce(four, F.when(low.contains(":"), F.concat(F.array_join(short, ":"), F.lit("::/64"))))


def hint(factor: Column, per_cent: Column, least: float = 2.0, strong: float = 10.0) -> Column:
    """A sentence on what a factor does to a price, by sign and size; null for what hardly matters."""
    size = F.when(F.abs(per_cent) >= strong, "much ").otherwise("")
    way = F.when(per_cent > 0, "dearer").otherwise("cheaper")
    return F.when(F.abs(per_cent) >= least, F.concat(factor, F.lit(" makes it "), size, way))


def event_text(old: Column, new: Column, active: Column, lag_days: Column, most_lag: int = 7) -> Column:
    """The text of a delisting, or of an active listing's price change; else null.

    A delisting that was noticed after more than some days without a look says nothing of the market and isn't
    reported; one whose lag isn't known is.
    """
    share = F.bround(F.try_divide((new - old) * 100.0, old), 0).cast("long")
    change = F.concat(F.lit("price "), old.cast("string"), F.lit(" -> "), new.cast("string"), F.lit(" ("), F.when(share > 0, "+").otherwise(""), share.cast("string"), F.lit(" %)"))
    return F.when(~active, F.when(~F.coalesce(lag_days > most_lag, F.lit(False)), "off the market")).when(old != new, change)


def typed_record(json: Column, districts: dict[str, str]) -> Column:
    """A struct of what a parsed text says, with types; a district's name becomes its key, unknown ones are null."""
    raw = F.from_json(json, "rooms string, area string, price string, district string")
    names = F.create_map(*(F.lit(x) for pair in districts.items() for x in pair))
    number = lambda c, kind: F.regexp_replace(raw[c], r"[\s ]", "").try_cast(kind)
    return F.struct(number("rooms", "int").alias("rooms"), number("area", "double").alias("area"), number("price", "long").alias("price"), F.try_element_at(names, F.lower(F.trim(raw["district"]))).alias("district"))


def in_city(city: Column, lat: Column, lon: Column, names: tuple[str, ...], box: tuple[float, float, float, float]) -> Column:
    """By the city's name if there is one, else by the box (south, north, west, east), else yes."""
    inside = lat.between(box[0], box[1]) & lon.between(box[2], box[3])
    return F.when(city.isNotNull(), F.lower(F.trim(city)).isin(*names)).when(lat.isNotNull() & lon.isNotNull(), inside).otherwise(True)


def is_complete(*columns: str) -> Column:
    """Whether all columns have a value."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def in_rectangle(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """1 in the box (south, north, west, east), else 0, also for missing coordinates."""
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False)).cast("int")


def old_panel(building_type: Column, age: Column, most: int) -> Column:
    """1 for a panel house older than some years, else 0."""
    return F.coalesce(F.lower(building_type).contains("panel") & (age > most), F.lit(False)).cast("int")


def target(kind: str, price: Column, area: Column, index: Column | None = None) -> Column:
    """What a model learns: the log of the price, of the unit price, or of the unit price against the index."""
    unit = F.when((price > 0) & (area > 0), price / area)
    return {"price": lambda: F.log1p(price.cast("double")), "ppsm": lambda: F.log(unit), "index_residual": lambda: F.log(F.when(index > 0, unit / index))}[kind]()


def price_of_target(kind: str, value: Column, area: Column, index: Column | None = None) -> Column:
    """The price that a target stands for."""
    return {"price": lambda: F.expm1(value), "ppsm": lambda: F.exp(value) * area, "index_residual": lambda: F.exp(value) * index * area}[kind]()
