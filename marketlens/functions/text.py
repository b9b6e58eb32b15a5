"""Text normalisation, parsing and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What stands before a complex's name, and what its parts are joined by.
PREFIXES = ("жк", "жилой комплекс", "коттеджный городок", "кг", "мкр", "клубный дом", "complex")
QUOTES = "\"'«»“”()\\[\\]"
SEPARATORS = "\\s._\\-—–/#"


def category(c: Column | str) -> Column:
    """Collapsed blanks, trimmed, lower case; missing and empty are 'unknown'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit("")), F.lit("unknown"))


def fingerprint() -> Column:
    """A key of what a relisted flat keeps: place, rooms, half square metres, floors and coordinates to 4 decimals.

    Numbers go in as scaled whole numbers, so no float formatting is involved. Null without area or coordinates.
    """
    whole = lambda c, k: F.coalesce(F.bround(F.col(c) * k).cast("long").cast("string"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [text("district"), text("rooms"), whole("area", 2), text("floor"), text("total_floors"), whole("lat", 10_000), whole("lon", 10_000)]
    usable = F.col("area").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return F.when(usable, F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def count_of(c: Column | str) -> Column:
    """A count in text: a word for none is 0, a number is cut to a whole one, anything else is missing."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c.isin("no", "none", "нет"), 0).otherwise(F.when(c.rlike(r"^\d+(\.\d+)?$"), c.try_cast("double").cast("int")))


def items_in(c: Column | str) -> Column:
    """How many non-empty items a comma list has; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.size(F.filter(F.split(c, ","), lambda x: F.trim(x) != "")))


def floor_parts(c: Column | str) -> tuple[Column, Column]:
    """(floor, floors) from '4 of 5', '4/5' or a bare number."""
    c = F.col(c) if isinstance(c, str) else c
    number = lambda g: F.nullif(F.regexp_extract(c, r"(\d+)\s*(?:из|of|/)\s*(\d+)", g), F.lit("")).try_cast("int")
    return F.coalesce(number(1), F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")), number(2)


def latest_year(c: Column | str) -> Column:
    """The greatest year (19xx or 20xx) in a text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"((?:19|20)\d\d)"), 1), lambda x: x.cast("int")))


def complex_name(c: Column | str) -> Column:
    """Lower case, without quotes and prefixes, separators as single blanks."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    c = F.regexp_replace(F.trim(c), "[" + QUOTES + "]", "")
    c = F.regexp_replace(c, "^(" + "|".join(PREFIXES) + r")[\s.:]+", "")
    return F.trim(F.regexp_replace(c, "[" + SEPARATORS + "]+", " "))


def without_phase(c: Column) -> Column:
    """A normalised name without the number of its phase at the end: one or two numbers, or a Roman one."""
    return F.regexp_replace(c, "\\s+(?:[0-9]+(?:\\s+[0-9]+)?|[ivx]+)$", "")


def text_key(c: Column | str, most: int = 3000) -> Column:
    """SHA-256 of a text with collapsed blanks, of its first characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sha2(F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most), 256)


def user_key(c: Column | str, salt: str) -> Column:
    """A salted hash that stands for a user."""
    return F.substring(F.sha2(F.concat(F.lit(salt), (F.col(c) if isinstance(c, str) else c).cast("string")), 256), 1, 12)


def room_share(c: Column | str) -> Column:
    """Whether a text offers a room or place in a flat; letters of any script in either case."""
    return (F.col(c) if isinstance(c, str) else c).rlike(r"(?iu)(подсел|койко|комнат[ау] в|hostel|хостел|chambre|zimmer)")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The word's form after a number, by its last digits."""
    tail, last = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tail.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


def params(c: Column | str) -> Column:
    """A JSON map of texts; malformed or missing is an empty map."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def either(m: Column, key: str, other: str) -> Column:
    """A map's value, or that of another key if it is missing or empty."""
    return F.coalesce(F.nullif(F.try_element_at(m, F.lit(key)), F.lit("")), F.nullif(F.try_element_at(m, F.lit(other)), F.lit("")))


def comma_decimal(c: Column) -> Column:
    """A number of cents or more with one decimal after a comma, half to even."""
    tenths = F.bround(F.round(c * 100) / 10).cast("long")
    sign = F.when(tenths < 0, "\u2212").otherwise("")
    tenths = F.abs(tenths)
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"))


def without_tail(c: Column | str, tail: str = r"(?is)\s*(?:this work is licensed under|all rights reserved).*$") -> Column:
    """A description without its closing formula, and without blanks around."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, tail, ""))


def wish(c: Column | str, districts: tuple[str, ...], least_price: int = 1_000_000) -> Column:
    """A struct of rooms (1 to 6), max_price (a number of at least ``least_price``) and district from a free text.

    Of each the first fitting token counts; a district fits if its name holds the token (of three letters or more).
    """
    tokens = F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[\s,;]+"), lambda t: t != "")
    first = lambda ok: F.try_element_at(F.filter(tokens, ok), F.lit(1))
    number = lambda t: t.try_cast("bigint")
    rooms = number(first(lambda t: t.rlike("^[1-6]$"))).cast("int")
    price = number(first(lambda t: F.coalesce(number(t) >= least_price, F.lit(False))))
    named = F.array(*(F.lit(d.lower()) for d in districts))
    match = lambda t: F.try_element_at(F.filter(named, lambda d: d.contains(t)), F.lit(1))
    district = match(first(lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]") & F.exists(named, lambda d: d.contains(t))))
    return F.struct(rooms.alias("rooms"), price.alias("max_price"), district.alias("district"))
