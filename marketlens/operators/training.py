"""A training run from raw listings to a model for use, and the walk-forward back-test; both judge models on what was
known at the time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text
from marketlens.operators import delivery, filters, joins, model, validity, windows
from marketlens.operators.quantiles import summarise
from marketlens.scratch import stage

#: Columns in which a test should look like what it stands for.
KINDS = ("district", "rooms", "category")


@dataclass
class Run:
    """The model for use, one row of metrics, the same of the plain medians, and how far the test can be trusted."""

    model: model.PriceModel
    report: DataFrame


def prepared(listings: DataFrame, now: str) -> DataFrame:
    """Current listings with numbers in range and a price, one for each flat and price level."""
    rows = filters.current(listings.where("price > 0 and area > 0"), now)
    rows = filters.sanitized(rows, int(now[:4])).withColumn("fp", text.fingerprint())
    return windows.dedup_relistings(rows)


def split(rows: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(train, test) by time; by building where no test comes about; without training rows of flats that the test has."""
    marked = stage(windows.recent_split(rows, **rules), "split")
    if not marked.where("is_test").head(1):
        marked = stage(joins.split_by_group(marked.drop("is_test"), joins.building_key()), "split")
    test = marked.where("is_test").drop("is_test")
    return joins.purge(marked.where("not is_test").drop("is_test"), test), test


def judged(scored: DataFrame) -> DataFrame:
    quality = validity.interval_quality(scored, "price", "fair_low", "fair_high", "fair_price").drop("n")
    return validity.regression_metrics(scored, "price", "fair_price").crossJoin(F.broadcast(quality))  # one row each


def train(listings: DataFrame, now: str, rules: dict | None = None, **params) -> Run:
    """Clean, deduplicate, split by time, purge, fit, judge on the test, ask whether the test stands for the whole, and fit
    all rows again.

    The report has the errors and the interval's quality on the test, errors of district medians on the same rows, the
    worst distance of the test from the whole, the share of a day's mix that is the day's own, an interval of the
    error by building, and the numbers of rows: those that went in are those of the test, of training and of the purge.
    """
    rows = stage(prepared(listings, now), "prepared")
    kept, test = split(rows, **(rules or {}))
    kept, test = stage(kept, "train"), stage(test, "test")
    fitted = model.fit(kept, **params)
    scored = stage(model.estimate(fitted, test), "scored")
    base = summarise(kept.where("price > 0 and area > 0"), ("district",), [], {"m": F.col("price") / F.col("area")})
    naive = test.join(F.broadcast(base), "district").withColumn("fair_price", F.col("m") * F.col("area"))  # a row a district
    plain = validity.regression_metrics(naive, "price", "fair_price").select(F.col("mape").alias("plain_mape"), F.col("r2").alias("plain_r2"))
    stands = validity.representativeness(test, rows, KINDS).select(F.col("worst").alias("worst_column"), F.col("tvd").alias("worst_tvd"), F.col("ok").alias("representative"))
    days = validity.time_confounding(rows.withColumn("day", F.to_date("first_seen")), "district").select("confounding")
    errors = scored.withColumn("_building", joins.building_key()).withColumn("_error", F.abs(F.col("price") - F.col("fair_price")) / F.col("price") * 100)
    interval = validity.cluster_bootstrap(errors, "_building", "_error", reps=200).select(F.round("low", 4).alias("mape_low"), F.round("high", 4).alias("mape_high"))
    n, n_train, n_test = rows.count(), kept.count(), test.count()
    sizes = {"n_rows": n, "n_train": n_train, "n_test": n_test, "n_purged": n - n_train - n_test, "n_trees": fitted.trees}
    report = judged(scored)
    for one in (plain, stands, days, interval):
        report = report.crossJoin(F.broadcast(one))  # one row each
    report = report.select("*", *(F.lit(v).cast("long").alias(k) for k, v in sizes.items()))
    return Run(model.refit(fitted, rows, **{k: v for k, v in params.items() if k in ("depth", "seed")}), report)


def backtest(listings: DataFrame, history: DataFrame, folds: int = 4, days: int = 7, gap: int = 0, least_train: int = 100, least_test: int = 20, least_folds: int = 3, **params) -> DataFrame:
    """Walk-forward: of each fold a model of what was known before it, judged on what came in it at the prices of its end.

    A row a fold, oldest first, with its errors if it has enough rows, whether its test stands for its training rows
    (``valid``), and if not both, why not. The row without a fold is the mean of the valid folds' errors, weighted by rows; with
    fewer than ``least_folds`` valid folds it has no errors and says so, as any number would be taken for an estimate.
    """
    spark = listings.sparkSession
    last = listings.agg(F.max("first_seen").alias("m")).first().m
    names = ("mape", "mae", "mdape", "r2", "coverage", "width")
    schema = "fold int, test_start date, test_end date, n_train long, n_test long, n_purged long, valid boolean, worst_tvd double, " + ", ".join(f"{c} double" for c in names) + ", reason string"
    out = []
    for f in windows.folds(spark, str(last.date()), folds, days, gap).orderBy("fold").collect() if last is not None else []:  # a few rows
        ids = stage(delivery.fold_rows(listings.withColumn("fp", text.fingerprint()), history, f"{f.test_start} 00:00:00", f"{f.test_end} 00:00:00", train_end=f"{f.train_end} 00:00:00"), "fold")
        rows = stage(ids.join(listings.drop("price"), "id"), "fold_rows")
        train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
        n = {r.part: r["count"] for r in ids.groupBy("part").count().collect()}
        row = {"fold": f.fold, "test_start": f.test_start, "test_end": f.test_end, "n_train": n.get("train", 0), "n_test": n.get("test", 0), "n_purged": n.get("purged", 0), "valid": False}
        if row["n_train"] < least_train or row["n_test"] < least_test:
            out.append(row | {"reason": "too few rows"})
            continue
        stands = validity.representativeness(test, train, KINDS).first()
        metrics = judged(model.estimate(model.fit(train, **params), test)).first().asDict()
        out.append(row | {"valid": stands.ok, "worst_tvd": stands.tvd, "reason": None if stands.ok else f"the test's {stands.worst} is unlike training"} | {c: metrics[c] for c in names})
    good = [r for r in out if r["valid"]]
    weight = sum(r["n_test"] for r in good)
    whole = {"n_test": weight, "valid": len(good) >= least_folds}
    if whole["valid"]:
        whole |= {c: round(sum(r[c] * r["n_test"] for r in good if r[c] is not None) / weight, 4) for c in names}
    else:
        whole["reason"] = f"{len(good)} of {len(out)} folds are valid, {least_folds} needed"
    fields = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in fields) for r in [*out, whole]], schema)
