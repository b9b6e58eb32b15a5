"""The k nearest references of points in the plane, for any density.

References at one place are one spot with the few of them that can count. Cells of a pyramid, each level half as wide as
the one before, have the number of references in them. A place's own cell is the smallest around it that holds enough of
them: as its quarters don't, it holds few, and the k-th nearest of these bounds the search. Cells that the bound's
circle touches are looked up by their counts, and those with many references are split again, with a bound that their
counts make smaller. So what a place meets depends on k and not on how crowded its surroundings are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.scratch import stage

#: Levels below the first, whose cells are as wide as the radius: the last is 16,000 times finer and isn't split.
LEVELS = 14
_HALF, _WIDTH = 1 << 27, 1 << 28


def _cell(c: Column, level: Column, radius: float) -> Column:
    return F.floor(c * F.pow(F.lit(2.0), level) / radius).cast("long")


def _key(level: Column, cx: Column, cy: Column) -> Column:
    """One number for a cell; coordinates lie within 8,000 km for a radius of 1 km."""
    return (level.cast("long") * _WIDTH + (cx + _HALF)) * _WIDTH + (cy + _HALF)


def _each_level(rows: DataFrame, radius: float, last: int, *columns: str) -> DataFrame:
    """A row for each level up to the last, with the key of the cell around x and y."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level")
    spread = rows.select(*columns, "x", "y", levels)
    return spread.select(*columns, "x", "y", "level", _key(F.col("level"), _cell(F.col("x"), F.col("level"), radius), _cell(F.col("y"), F.col("level"), radius)).alias("key"))


def _last_level(spots: DataFrame, k: int, radius: float) -> int:
    """A level none of whose cells holds k references, so that finer ones aren't needed, or the last of all."""
    for level in (3, 7):
        own = _key(F.lit(level), _cell(F.col("x"), F.lit(level), radius), _cell(F.col("y"), F.lit(level), radius))
        if not spots.groupBy(own.alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") >= k).head(1):
            return level
    return LEVELS


def _span(c: str, cell: str, radius: float) -> tuple[Column, Column]:
    """Least and greatest difference of a coordinate to what lies in a cell (number ``cell`` of ``level``)."""
    side = radius / F.pow(F.lit(2.0), F.col("level"))
    low, high = F.col(cell) * side - F.col(c), (F.col(cell) + 1) * side - F.col(c)
    return F.greatest(low, -high, F.lit(0.0)), F.greatest(F.abs(low), F.abs(high))


def _bounds(cells: DataFrame, radius: float) -> DataFrame:
    """near and far: between them lies the distance to all that a cell holds (a little wider, for rounding)."""
    (x0, x1), (y0, y1) = _span("x", "cx", radius), _span("y", "cy", radius)
    return cells.withColumns({"near": F.hypot(x0, y0) * (1 - 1e-9) - 1e-12, "far": F.hypot(x1, y1) * (1 + 1e-9) + 1e-12})


def nearest(places: DataFrame, spots: DataFrame, k: int, radius: float) -> DataFrame:
    """place and found (array of km, id, value: the k nearest within the radius, of equally near ones the smaller id).

    ``places`` has place, x and y; ``spots`` has x, y and top: the k smallest ids there with their values, in order.
    """
    split = 4 * k
    spots = stage(spots.select(F.monotonically_increasing_id().alias("spot"), "x", "y", F.size("top").alias("n"), "top"), "spots")
    last = _last_level(spots, k, radius)
    keyed = stage(_each_level(spots, radius, last, "spot", "n"), "keyed")
    counts = stage(keyed.groupBy("key").agg(F.sum("n").alias("n")), "counts")

    # The own cell: the smallest with k references; without any the bound is the radius.
    around = _each_level(places, radius, last, "place").join(counts.where(F.col("n") >= k), "key", "left")
    own = stage(around.groupBy("place").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max(F.when(F.col("n").isNotNull(), F.struct("level", "key"))).alias("own")), "own")
    inside = own.where("own is not null").select("place", "x", "y", "own.key")
    wanted = inside.select("key").distinct()
    met = inside.join(keyed.join(wanted, "key", "left_semi").select("key", F.col("x").alias("sx"), F.col("y").alias("sy"), "n"), "key")
    met = met.select("place", F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y")).alias("km"), "n")
    # Own cells of the last level may hold more than 4 k, so counts are added up by distance, not listed.
    so_far = F.sum("n").over(Window.partitionBy("place").orderBy("km").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bound = met.withColumn("upto", so_far).where(F.col("upto") >= k).groupBy("place").agg(F.min("km").alias("bound"))
    start = own.join(bound, "place", "left").select("place", "x", "y", F.coalesce("own.level", F.lit(0)).alias("level"), F.least(F.coalesce("bound", F.lit(radius)), F.lit(radius)).alias("bound"))

    # Cells that the circle touches: the bound is at most the own cell's diagonal, so there are 25 at most.
    side = radius / F.pow(F.lit(2.0), F.col("level"))
    steps = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("bound")) / side).cast("long"), F.floor((F.col(c) + F.col("bound")) / side).cast("long")))
    cells = start.withColumn("cx", steps("x")).withColumn("cy", steps("y"))
    leaves = []
    while True:
        near = _bounds(cells, radius).where("near <= bound").withColumn("key", _key(F.col("level"), F.col("cx"), F.col("cy")))
        front = stage(near.join(counts, "key"), "front")
        many = (F.col("n") > split) & (F.col("level") < last)
        leaves.append(front.where(~many).select("place", "x", "y", "key", "bound"))
        large = front.where(many)
        if not large.head(1):
            break
        # Enough references lie within the far end of some cells: that is a bound for their place.
        upto = F.sum("n").over(Window.partitionBy("place").orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        tight = large.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("place").agg(F.min("far").alias("tight"))
        large = large.join(tight, "place", "left").withColumn("bound", F.least("bound", "tight")).where("near <= bound")
        halves = F.array(F.lit(0), F.lit(1))
        large = large.select("place", "x", "y", (F.col("level") + 1).alias("level"), "bound", "cx", "cy", F.explode(halves).alias("dx")).select("*", F.explode(halves).alias("dy"))
        cells = large.select("place", "x", "y", "level", "bound", (F.col("cx") * 2 + F.col("dx")).alias("cx"), (F.col("cy") * 2 + F.col("dy")).alias("cy"))
    leaves = reduce(DataFrame.unionByName, leaves)
    wanted = leaves.select("key").distinct()
    members = keyed.join(wanted, "key", "left_semi").select("key", "spot", F.col("x").alias("sx"), F.col("y").alias("sy"))
    km = F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    close = leaves.join(members, "key").withColumn("km", km).where((F.col("km") <= F.col("bound")) & (F.col("km") <= radius)).select("place", "spot", "km")
    found = close.join(spots.select("spot", "top"), "spot").select("place", "km", F.explode("top").alias("t")).select("place", "km", "t.id", "t.value")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("km", "id"))
    found = found.withColumn("_r", rank).where(F.col("_r") <= k)
    return found.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("km", "id", "value"))).alias("found"))


def spots_of(reference: DataFrame, k: int) -> DataFrame:
    """x, y and top (the k smallest ids with their values) of each place that references (id, x, y, value) have."""
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    few = reference.withColumn("_r", rank).where(F.col("_r") <= k)  # a literal, so tasks drop the rest before the shuffle
    return few.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("top"))
