"""Exact medians and other quantiles of groups of any size.

``F.percentile`` keeps a count of each distinct value of a group in one task, which is the quickest way while the input
is small. Beyond ONE_TASK bytes of input a sketch of bounded size first gives two values around each wanted rank; values
below are only counted, and just the few between them (a share of about 4 / accuracy of the rows) are put in order. Both
ways give the same values. A sketch comes out a little different each time it is made, as partial ones meet in any order, so
it is made once and stored; bounds that turn out not to hold a wanted rank are dropped for the whole group's range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.scratch import stage

#: Bytes that the plan's sources may have for the values of a group to be gathered in one task.
ONE_TASK = 256 << 20
#: Groups whose bounds are sent to all tasks; with more, rows meet theirs by a shuffle.
BROADCAST_ROWS = 50_000


def input_bytes(rows: DataFrame) -> int:
    """The size of all that the plan reads, as its sources state it; nothing is run."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def exact_quantiles(rows: DataFrame, keys: tuple[str, ...], values: dict[str, Column], at: tuple[float, ...] = (0.5,), accuracy: int = 10_000, higher: bool = False) -> DataFrame:
    """For each group, an array of the quantiles ``at`` of each named value, interpolated (or the value above, if ``higher``).

    Null values are left out, null keys are a group; a name without values is null. The sketch's ranks are off by
    n / accuracy at most, so two ranks that far from the wanted one on either side hold it.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), v.cast("double").alias("v")) for i, v in enumerate(values.values())))
    long = rows.select(*(F.col(k).alias(x) for k, x in zip(keys, ks, strict=True)), F.explode(pairs).alias("_p")).select(*ks, F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v")).where("_v is not null")
    long = stage(long, "long")  # read three times; what it comes from may be joins of large tables
    by, e = [*ks, "_i"], 2 / accuracy
    ends = F.percentile_approx("_v", F.array(*(F.lit(min(max(q + d, 0.0), 1.0)) for q in at for d in (-e, e))), accuracy)
    ks_b = [f"{x}b" for x in by]
    bounds = stage(long.groupBy(*by).agg(F.count("*").alias("_n"), ends.alias("_q")).toDF(*ks_b, "_n", "_q"), "bounds")
    few = bounds.count() <= BROADCAST_ROWS
    sized = lambda df: F.broadcast(df) if few else df
    low, high = (lambda j: F.col("_q")[2 * j]), (lambda j: F.col("_q")[2 * j + 1])
    each_at = lambda f: F.array(*(f(j) for j in range(len(at))))
    placed = long.join(sized(bounds), _same(by, ks_b))
    counts = [each_at(lambda j: F.count_if(F.col("_v") < low(j))).alias("_below"), each_at(lambda j: F.count_if(F.col("_v") <= high(j))).alias("_within")]
    below = stage(placed.groupBy(*by).agg(F.first("_n").alias("_n"), F.first("_q").alias("_q"), *counts), "below")
    at_of = lambda j: (F.col("_n") - 1) * F.lit(at[j])
    holds = lambda j: (F.col("_below")[j] <= F.floor(at_of(j))) & (F.col("_within")[j] > F.ceil(at_of(j)))
    # Without bounds (null) all values of the group are put in order.
    kept = lambda c: lambda j: F.when(holds(j), c(j))
    below = below.select(*by, "_n", each_at(kept(low)).alias("_low"), each_at(kept(high)).alias("_high"), each_at(lambda j: F.when(holds(j), F.col("_below")[j]).otherwise(0)).alias("_below"))
    # Equal values are one row with a count, so a value that many rows share is one row too.
    between = lambda j: F.col("_low")[j].isNull() | ((F.col("_v") >= F.col("_low")[j]) & (F.col("_v") <= F.col("_high")[j]))
    wanted = F.array_compact(each_at(lambda j: F.when(between(j), F.lit(j))))
    inside = long.join(sized(below.toDF(*ks_b, "_n", "_low", "_high", "_below")), _same(by, ks_b)).withColumn("_j", F.explode(wanted)).groupBy(*by, "_j", "_v").agg(F.count("*").alias("_c"))
    ranked = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_j").orderBy("_v"))).toDF(*(f"{x}r" for x in by), "_j", "_v", "_c", "_upto")
    joined = ranked.join(below, _same([f"{x}r" for x in by], by)).withColumn("_last", F.element_at("_below", F.col("_j") + 1) + F.col("_upto"))
    place = (F.col("_n") - 1) * F.element_at(F.array(*map(F.lit, at)), F.col("_j") + 1)
    rank = lambda f: F.min(F.when(F.col("_last") > f(place), F.col("_v")))
    part = F.first(place - F.floor(place))
    lower, upper = rank(F.floor), rank(F.ceil)
    # Weights of one value don't always add up to it.
    value = upper if higher else F.when(lower == upper, lower).otherwise(lower * (1 - part) + upper * part)
    each = joined.groupBy(*by, "_j").agg(value.alias("_x")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_x"))), lambda x: x["_x"]).alias("_x"))
    wide = each.groupBy(*ks).agg(*(F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(name) for i, name in enumerate(values)))
    return wide.select(*(F.col(x).alias(k) for x, k in zip(ks, keys, strict=True)), *values)


def summarise(
    rows: DataFrame, keys: tuple[str, ...], aggs: list[Column], values: dict[str, Column], at: float | tuple[float, ...] = 0.5, sets: list[list[str]] | None = None
) -> DataFrame:
    """Aggregates and exact quantiles of each group: the keys, ``aggs``, then a column for each value.

    A value's column is a number, or an array if ``at`` is a tuple. With ``sets`` the groups are those of each set of
    keys, told apart by ``g`` as GROUPING_ID gives it. Without keys there is one row, also of no rows.
    """
    if input_bytes(rows) <= ONE_TASK:
        q = F.array(*map(F.lit, at)) if isinstance(at, tuple) else F.lit(at)
        medians = [F.percentile(v.cast("double"), q).alias(name) for name, v in values.items()]
        if sets is not None:
            return rows.groupingSets(sets, *keys).agg(F.grouping_id().alias("g"), *aggs, *medians)
        return rows.groupBy(*keys).agg(*aggs, *medians)
    if sets is not None:
        parts = []
        for own in sets:
            g = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
            part = summarise(rows, tuple(own), aggs, values, at)
            parts.append(part.select(*((F.col(k) if k in own else F.lit(None).cast(rows.schema[k].dataType).alias(k)) for k in keys), F.lit(g).cast("long").alias("g"), *part.columns[len(own) :]))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out
    found = exact_quantiles(rows, keys, values, at if isinstance(at, tuple) else (at,))
    names = [f"_q{i}" for i in range(len(keys))]
    found = found.toDF(*names, *values)
    base = rows.groupBy(*keys).agg(*aggs or [F.count("*").alias("_rows")])
    joined = base.join(found, _same(list(keys), names), "left").drop(*names, "_rows")
    return joined if isinstance(at, tuple) else joined.withColumns({name: F.col(name)[0] for name in values})


def exact_medians(rows: DataFrame, keys: tuple[str, ...], value: str, accuracy: int = 10_000) -> DataFrame:
    """n and the exact interpolated median of ``value`` for each group, by the sketch whatever the size."""
    own = rows.where(F.col(value).isNotNull())
    found = exact_quantiles(own, keys, {"median": F.col(value)}, accuracy=accuracy).toDF(*(f"_q{i}" for i in range(len(keys))), "median")
    counts = own.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(found, _same(list(keys), [f"_q{i}" for i in range(len(keys))])).select(*keys, "n", F.col("median")[0].alias("median"))
