"""How far estimates can be trusted: distances of distributions, error metrics, clustered intervals, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.operators.quantiles import exact_quantiles, summarise


def canonical(c: Column | str) -> Column:
    """A category as text: whole numbers alike in any encoding, missing as '?'."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.coalesce(F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1"), F.lit("?"))


def variation_distance(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Half the sum of absolute differences of shares, for each column: 0 for equal distributions, 1 for disjoint ones.

    All columns of both tables are counted in one pass each.
    """
    def shares(rows: DataFrame, name: str) -> DataFrame:
        long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), canonical(c).alias("value")) for c in columns))).alias("x")).select("x.*")
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy("column"))).drop("n")

    both = shares(a, "p").join(shares(b, "q"), ["column", "value"], "full")
    gap = F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2
    return both.groupBy("column").agg(F.round(gap, 6).alias("tvd"))


def representativeness(sample: DataFrame, population: DataFrame, columns: tuple[str, ...], limit: float = 0.2) -> DataFrame:
    """The worst column's distance and if it is within the limit."""
    d = variation_distance(sample, population, columns)
    return d.agg(F.max_by("column", F.struct("tvd", "column")).alias("worst"), F.max("tvd").alias("tvd")).withColumn("ok", F.col("tvd") <= limit)


def time_confounding(rows: DataFrame, column: str, day: str = "day", least: int = 30, window: int | None = None) -> DataFrame:
    """Mean distance of days (with enough rows) from the whole, weighted by rows.

    With ``window`` days and whole alike are those of the last so many days before the newest.
    """
    value = canonical(column)
    counts = rows.where(F.col(day).isNotNull()).groupBy(day, value.alias("value")).agg(F.count("*").alias("n"))
    if window is not None:
        last = counts.agg(F.max(day).alias("_last"))
        counts = counts.crossJoin(F.broadcast(last)).where(F.date_diff("_last", F.col(day)) < window).drop("_last")  # one row
    per_day = counts.withColumn("day_n", F.sum("n").over(Window.partitionBy(day)))
    whole = counts.groupBy("value").agg(F.sum("n").alias("all_n"))
    whole = whole.crossJoin(F.broadcast(whole.agg(F.sum("all_n").alias("total")))).select("value", (F.col("all_n") / F.col("total")).alias("q"))
    # A value that a day lacks adds its whole share: that is 1 less the shares of the values that it has.
    near = per_day.where(F.col("day_n") >= least).join(whole, "value").withColumn("p", F.col("n") / F.col("day_n"))
    daily = near.groupBy(day).agg(F.first("day_n").alias("w"), ((F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("tvd"))
    return daily.agg(F.count("*").alias("days"), F.round(F.sum(F.col("w") * F.col("tvd")) / F.sum("w"), 6).alias("confounding"))


def segments(rows: DataFrame, y: str, p: str, low: str, high: str, *keys: str, least: int = 5) -> DataFrame:
    """Errors and the interval's quality by the keys and fifths of ``y``, for segments with enough rows.

    worst_error and worst_coverage tell the segments with the greatest mean error and the least coverage (of equals the first
    by keys).
    """
    from marketlens.operators.windows import quintiles

    by = [*keys, "quintile"]
    placed = quintiles(rows, y).where(F.col("quintile").isNotNull())
    valid = placed.where(F.col(p).isNotNull() & (F.col(y) != 0))
    error = F.abs(F.col(y) - F.col(p)) / F.greatest(F.col(y), F.lit(1))
    middle = F.greatest((F.col(low) + F.col(high)) / 2.0, F.lit(1.0))
    hit = F.col(y).between(F.col(low), F.col(high)).cast("int")
    aggs = [F.count("*").alias("n"), F.round(F.avg(error) * 100, 4).alias("mape"), F.round(F.avg((F.col(p) - F.col(y)) / F.greatest(F.col(y), F.lit(1))) * 100, 4).alias("bias"), F.round(F.avg(hit) * 100, 4).alias("coverage")]
    found = summarise(valid, tuple(by), aggs, {"mdape": error * 100, "width": (F.col(high) - F.col(low)) / middle * 100}).where(F.col("n") >= least)
    found = found.withColumns({c: F.round(c, 4) for c in ("mdape", "width")})
    one = Window.partitionBy(F.lit(1))  # a row for each of a few segments
    first = lambda *order: F.row_number().over(one.orderBy(*order, *by)) == 1
    return found.withColumns({"worst_error": first(F.desc("mape")), "worst_coverage": first(F.asc("coverage"))})


def regression_metrics(rows: DataFrame, y: str, p: str, *keys: str) -> DataFrame:
    """Mean and median errors, and R squared against the mean of what is judged."""
    e = F.abs(F.col(y) - F.col(p))
    valid = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull() & (F.col(y) != 0))
    r2 = 1 - F.sum(F.pow(F.col(y) - F.col(p), 2)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    aggs = [F.count("*").alias("n"), F.round(F.avg(e), 4).alias("mae"), F.round(F.avg(e / F.col(y)) * 100, 4).alias("mape"), F.round(r2, 4).alias("r2"), F.round(F.avg((F.col(p) - F.col(y)) / F.col(y)) * 100, 4).alias("bias")]
    found = summarise(valid, keys, aggs, {"mdape": e / F.col(y)})
    return found.select(*keys, "n", "mae", "mape", F.round(F.col("mdape") * 100, 4).alias("mdape"), "r2", "bias")


def pinball(y: Column, q: Column, tau: float) -> Column:
    d = y - q
    return F.greatest(tau * d, (tau - 1) * d)


def interval_quality(rows: DataFrame, y: str, low: str, high: str, point: str, *keys: str) -> DataFrame:
    """Coverage, median relative width and pinball losses of intervals."""
    hit = F.col(y).between(F.col(low), F.col(high)).cast("int")
    width = F.try_divide(F.col(high) - F.col(low), F.col(point))
    aggs = [F.count("*").alias("n"), F.round(F.avg(hit) * 100, 4).alias("coverage")]
    aggs += [F.round(F.avg(pinball(F.col(y), F.col(c), t)), 2).alias(f"pinball_{x}") for c, t, x in ((low, 0.1, "low"), (high, 0.9, "high"))]
    found = summarise(rows, keys, aggs, {"width": width})
    return found.withColumn("width", F.round(F.col("width") * 100, 4))


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, reps: int = 2000, least: int = 30, seed: int = 11, level: float = 0.95) -> DataFrame:
    """Interval of a mean when rows of a cluster go together: clusters are drawn again, not rows.

    Clusters are summed first. Each draws a Poisson(1) weight for each repetition from a hash, so repetitions are sums
    by (repetition) with map-side sums: the work is clusters times repetitions, and nothing is gathered. With fewer than
    ``least`` clusters the bounds are null, and ``reason`` says so.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    # Poisson(1) by inversion of its distribution function; the tail beyond 6 has weight 1e-4 of a per cent.
    name = F.concat_ws("|", F.coalesce(F.col(cluster).cast("string"), F.lit("")), F.col("rep").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / float(1 << 32)
    cdf, total, term = [], 0.0, 0.36787944117144233
    for k in range(7):
        total += term
        cdf.append(total)
        term /= k + 1
    weight = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", weight)
    means = drawn.groupBy("rep").agg(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum(F.col("c") * F.col("w"))).alias("m"))
    low, high = (1 - level) / 2, (1 + level) / 2
    bounds = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    point = sums.agg((F.sum("s") / F.sum("c")).alias("mean"), F.count("*").alias("clusters"))
    enough = F.col("clusters") >= least
    reason = F.when(~enough, F.format_string("%d clusters, %d needed", F.col("clusters"), F.lit(least)))
    return point.crossJoin(bounds).select("clusters", "mean", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), reason.alias("reason"))  # one row each


def conformal_scale(scores: DataFrame, cluster: str, score: str, coverage: float = 0.8, most: float = 10.0) -> DataFrame:
    """The score at rank ceil((n + 1) * coverage) of n clusters' (the 'higher' quantile of rows), within [0, most]."""
    k = scores.agg(F.countDistinct(cluster).alias("k")).first().k  # one number
    level = min(math.ceil((k + 1) * coverage) / k, 1.0) if k else 1.0
    found = exact_quantiles(scores, (), {"s": F.col(score)}, (level,), higher=True).select(F.col("s")[0].alias("s"))
    return found.select(F.round(F.greatest(F.least("s", F.lit(most)), F.lit(0.0)), 6).alias("scale"))


def trend_line(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Least-squares slope with its standard error, and the change in per cent 13 and 26 steps on.

    A flat line has slope 0 and no error. Two points have no error; fewer have no line.
    """
    sxx, syy, sxy, n = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x), F.count("*")
    flat = F.max(y) == F.min(y)
    fit = points.groupBy(*keys).agg(n.alias("n"), F.when(flat, 0.0).otherwise(F.regr_slope(y, x)).alias("slope"), F.regr_intercept(y, x).alias("b"), F.max(x).alias("last"), F.when(n > 2, F.sqrt(F.greatest((syy - sxy * sxy / sxx) / (n - 2) / sxx, F.lit(0.0)))).alias("se"))
    now = F.col("b") + F.col("slope") * F.col("last")
    change = lambda k: F.round(F.try_divide(F.col("slope") * k, now) * 100, 2).alias(f"change_{k}")
    significant = F.coalesce(F.abs("slope") > 2 * F.col("se"), F.lit(False))
    return fit.where("n >= 2").select(*keys, "n", F.round("slope", 4).alias("slope"), F.round("se", 4).alias("se"), significant.alias("significant"), change(13), change(26))


def month_change(points: DataFrame, t: str = "t", value: str = "median_ppsm") -> DataFrame:
    """The last value against the fifth from last, in per cent."""
    ranked = points.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(t))))  # a row a week
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(value)))
    return ranked.agg(F.bround(F.try_divide((at(1) - at(5)) * 100.0, at(5)), 1).alias("month_pct"))


def city_index(rows: DataFrame, cell: str, week: str, value: str, least: int = 8) -> DataFrame:
    """Weekly median over a fixed basket: the cells with enough rows overall; the row without a week is over all."""
    basket = rows.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(cell)
    kept = rows.join(basket, cell, "left_semi")
    return summarise(kept, (week,), [], {"value": F.col(value)}).unionByName(summarise(rows, (), [], {"value": F.col(value)}).select(F.lit(None).cast(rows.schema[week].dataType).alias(week), "value"))


def gate(new: DataFrame, old: DataFrame, mape: float = 0.5, coverage: tuple[float, float] = (75.0, 90.0)) -> DataFrame:
    """Named checks of a new model against the old one; a missing metric fails."""
    n, o = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns)), old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns))
    checks = {
        "mape": F.col("n_mape") <= F.col("o_mape") + mape,
        "mae": F.col("n_mae") <= F.col("o_mae") * 1.05,
        "coverage": F.col("n_coverage").between(*coverage),
        "width": F.col("n_width") <= F.col("o_width") * 1.25,
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for k, ok in checks.items()))
    return n.crossJoin(o).select(F.explode(rows).alias("x")).select("x.*")  # one row each


def gate_history(new: DataFrame, history: DataFrame, order: str, metric: str = "mape", n: int = 4, points: float = 0.5, share: float = 0.06) -> DataFrame:
    """The gate's check against small steps for the worse: check, ok, value and best of the last ``n`` published models.

    A model may be worse than the best of these by ``points`` or a ``share`` of it, whichever is more. Without a history
    there is nothing to be worse than; a missing metric of the new model fails.
    """
    best = history.where(F.col(metric).isNotNull()).orderBy(F.desc(order)).limit(n).agg(F.min(metric).alias("best"))
    limit = F.col("best") + F.greatest(F.lit(points), F.col("best") * share)
    ok = F.when(F.col("value").isNull(), False).otherwise(F.col("best").isNull() | (F.col("value") <= limit))
    return new.select(F.col(metric).alias("value")).crossJoin(F.broadcast(best)).select(F.lit("history").alias("check"), ok.alias("ok"), "value", "best")  # one row


def paired_bootstrap(a: DataFrame, b: DataFrame, keys: tuple[str, ...], cluster: str, value: str, **params) -> DataFrame:
    """Interval of the mean difference b - a over rows that both runs have, drawn by cluster.

    ``cluster`` is a column of ``a``.
    """
    x = a.where(F.col(value).isNotNull()).select(*keys, F.col(cluster).alias("_cluster"), F.col(value).alias("_a"))
    y = b.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_b"))
    both = x.join(y, list(keys)).withColumn("difference", F.col("_b") - F.col("_a"))
    return cluster_bootstrap(both, "_cluster", "difference", **params)
