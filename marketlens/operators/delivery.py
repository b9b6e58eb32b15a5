"""What is sent, in which order: deals, digests, pools to pick from, samples, turns of chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lot(key: Column, seed: str) -> Column:
    """A number that is drawn for a key: the first 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("long")


def deals(rows: DataFrame) -> DataFrame:
    """Suspicious ones last, then the best deviation first (a missing one counts as none), with their place."""
    order = Window.partitionBy("chat").orderBy("suspicious", F.coalesce("diff", F.lit(0)), "id")
    return rows.withColumn("place", F.row_number().over(order))


def digest(rows: DataFrame, posted: DataFrame, n: int = 5) -> DataFrame:
    """The n best that weren't posted and aren't suspicious."""
    fresh = rows.where("not suspicious").join(posted.select("id").distinct(), "id", "left_anti")
    return fresh.orderBy(F.coalesce("diff", F.lit(0)), "id").limit(n)


def pool(rows: DataFrame, n: int, when: str = "last_seen") -> DataFrame:
    """The n freshest rows."""
    return rows.orderBy(F.desc(when), "id").limit(n)


def pick(rows: DataFrame, seed: str) -> DataFrame:
    """One row, drawn by the seed."""
    return rows.orderBy(lot(F.col("id"), seed), "id").limit(1)


def sample(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """At most n rows, drawn by the seed; a task keeps n of its own, so nothing else is sorted."""
    return rows.orderBy(lot(F.col("id"), seed), "id").limit(n)


def turns(rows: DataFrame) -> DataFrame:
    """The order in which chats are served: the first message of each, then the second, and so on."""
    own = Window.partitionBy("chat").orderBy("diff", "id")
    return rows.withColumn("turn", F.row_number().over(own))


def anomalies_since(rows: DataFrame, bad: Column, since: str, at: str = "last_seen") -> DataFrame:
    """How many rows from a moment on are bad."""
    return rows.where((F.col(at) >= F.lit(since).cast("timestamp_ntz")) & bad).agg(F.count("*").alias("anomalies"))


def fold_rows(listings: DataFrame, history: DataFrame, start: str, stop: str, days: int = 90, train_end: str | None = None) -> DataFrame:
    """id, part ('train', 'purged' or 'test') and price of one walk-forward fold.

    Both parts know only what was known then: the test has what was first seen from ``start`` to before ``stop`` with
    its last price before ``stop``; training has what was first seen before ``train_end`` (else ``start``) with its last
    price before that. In both, what was delisted over ``days`` before the part's end, lies outside of the city's box or
    has no price goes, and of a fingerprint one row stays for each price level, the one with the greatest id, as when
    rows were last seen isn't known then. Training rows whose fingerprint the test has are purged. ``listings`` has fp.
    """
    from marketlens.operators import filters, windows

    train_end = train_end or start
    a, b, c = (F.lit(x).cast("timestamp_ntz") for x in (start, stop, train_end))

    def part(rows: DataFrame, end: str, by: Column) -> DataFrame:
        last = history.where(F.col("observed_at") < by).groupBy("listing_id").agg(F.max_by("price", F.struct("observed_at", "seq")).alias("known"))
        rows = filters.current(rows, end, days).join(last, F.col("id") == F.col("listing_id")).where("known > 0")
        return windows.dedup_relistings(rows.select("id", "fp", F.col("known").alias("price")), order=("id",))

    test = part(listings.where((F.col("first_seen") >= a) & (F.col("first_seen") < b)), stop, b)
    train = part(listings.where(F.col("first_seen") < c), train_end, c)
    seen = test.where("fp is not null").select("fp", F.lit(True).alias("_seen")).distinct()
    train = train.join(seen, "fp", "left").select("id", F.when(F.col("_seen"), "purged").otherwise("train").alias("part"), "price")
    return train.union(test.select("id", F.lit("test").alias("part"), "price"))
