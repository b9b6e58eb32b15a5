"""Price models, comparisons, paired intervals and rings."""

from __future__ import annotations

import time
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens import tables
from marketlens.operators import boosting, delivery, explain, filters, model, planning, rings, training, validity, windows
from marketlens.plans.model import _rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return _rows(spark, SF).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.fit(rows, trees=4, depth=3, quantile_trees=4)


def test_estimates_lie_in_their_interval(rows, fitted):
    out = model.estimate(fitted, rows.where("price > 0"))
    assert out.count() == rows.where("price > 0").count()
    assert out.where("fair_low > fair_price or fair_high < fair_price or fair_price is null").count() == 0


def test_unknown_district_and_gaps(rows, fitted):
    odd = rows.limit(2).withColumns({"district": F.lit(None).cast("string"), "year_built": F.lit(None).cast("int"), "category": F.lit("never seen")})
    assert model.estimate(fitted, odd).where("fair_price > 0").count() == 2


def test_models_on_a_frozen_test(rows, fitted):
    out = {r.model: (r.n, r.excluded) for r in model.compare({"a": fitted, "b": fitted}, rows, {"b": "2100-01-01"}).collect()}
    assert out["a"][0] > 100 and out["a"][1] is None and out["b"] == (0, "it had data up to 2100-01-01, after which the test has no rows")


def test_rental_estimates(rows, fitted):
    typical = planning.typical(rows, ("category",), ("ceiling",))
    out = model.rental_estimates(fitted, rows.where("price > 0"), {"novostroiki": "vtorichka"}, typical)
    assert out.where("yield_pct > 0").count() == out.count() > 0


def test_paired_interval(spark):
    a = spark.range(600).selectExpr("id", "id % 60 as c", "hash(id) % 100 / 100.0D as v")
    out = validity.paired_bootstrap(a, a.withColumn("v", F.col("v") + 0.5), ("id",), "c", "v", reps=50).first()
    assert abs(out.mean - 0.5) < 1e-9 and abs(out.low - 0.5) < 1e-9 and out.clusters == 60


def test_rings():
    a, b, c, d = (0, 0), (0, 1), (1, 1), (1, 0)
    assert rings.join_ends([[a, b], [c, b], [c, d, a]]) == [[a, b, c, d, a]]
    assert rings.join_ends([[a, b], [c, d]]) == []
    assert rings.join_ends([[a, b, c, a], [d]]) == [[a, b, c, a]]
    # Ends that are off by less than the tolerance meet, also across a line of the grid; those off by more don't.
    e = 6e-8
    assert rings.join_ends([[a, b], [(1 + e, 1 - e), (0, 1 + e)], [(e, -e), (1, 0), c]]) == [[a, b, (1 + e, 1 - e), (1, 0), a]]
    assert rings.join_ends([[a, b], [c, (0, 1 + 2e-7)], [c, a]]) == []
    # Two rings that share a node, and one in very many segments.
    assert len(rings.join_ends([[a, b, c, a], [a, d, (2, 2)], [(2, 2), a]])) == 2
    many = [[(i, i * i), (i + 1, (i + 1) ** 2)] for i in range(100_000)] + [[(100_000, 10**10), (-1, 0)], [(-1, 0), (0, 0)]]
    began = time.process_time()
    assert len(rings.join_ends(many[::2] + many[1::2])[0]) == len(many) + 1 and time.process_time() - began < 10


def test_rings_of_zones(spark):
    p = lambda *xy: [{"lat": float(x), "lon": float(y)} for x, y in xy]
    segments = spark.createDataFrame([("z", "outer", 1, p((0, 0), (0, 1), (1, 1))), ("z", "outer", 2, p((0, 0), (1, 1))), ("y", "inner", 1, p((0, 0), (1, 1)))], "zone string, role string, ord int, points array<struct<lat: double, lon: double>>")
    out = rings.assemble(segments).collect()
    assert [(r.zone, r.role, len(r.ring)) for r in out] == [("z", "outer", 4)]


def test_view_of_listings_matches_its_twin(spark):
    from tests.oracle import connect

    n = connect(SF).execute(f"{tables.sql('listing')} SELECT count(*), count(price), count(raw_params) FROM listing").fetchall()[0]
    got = tables.listings(spark, SF).agg(F.count("*"), F.count("price"), F.count("raw_params")).first()
    assert tuple(got) == n


def test_contributions_equal_those_over_all_subsets(rows, fitted):
    """Shapley values by their definition: a feature that isn't known takes both ways, by training rows."""
    gbt = fitted.pipeline.stages[-1]
    nodes, trees = explain._nodes(gbt), explain.read_trees(gbt)

    def value(weight, tree, x, known, i=0):
        node = tree[i]
        if node["leftChild"] < 0:
            return weight * node["prediction"]
        split, (a, b) = node["split"], (node["leftChild"], node["rightChild"])
        if split["featureIndex"] in known:
            v, cut = x[split["featureIndex"]], split["leftCategoriesOrThreshold"]
            left = v in cut if split["numCategories"] >= 0 else v <= cut[0]
            return value(weight, tree, x, known, a if left else b)
        return sum(tree[c]["rawCount"] / node["rawCount"] * value(weight, tree, x, known, c) for c in (a, b))

    rng = np.random.default_rng(1)
    frame = model._indexed(fitted, rows.where("price > 0")).select("features", "log_fair").limit(200).collect()
    some = [frame[i] for i in rng.choice(len(frame), 8, replace=False)]
    got = explain.shapley(trees, np.array([r.features.toArray() for r in some]))
    for r, own in zip(some, got, strict=True):
        x = r.features.toArray()
        want, base = np.zeros(len(x)), 0.0
        for weight, tree in nodes:
            used = sorted({n["split"]["featureIndex"] for n in tree.values() if n["leftChild"] >= 0})
            v = {s: value(weight, tree, x, set(s)) for k in range(len(used) + 1) for s in combinations(used, k)}
            base += v[()]
            for j in used:
                others = [u for u in used if u != j]
                for k in range(len(used)):
                    for s in combinations(others, k):
                        want[j] += factorial(k) * factorial(len(used) - k - 1) / factorial(len(used)) * (v[tuple(sorted((*s, j)))] - v[s])
        assert np.allclose(own, want, atol=1e-10) and abs(base - trees.base) < 1e-10
        assert abs(trees.base + own.sum() - r.log_fair) < 1e-10


def test_parts_of_a_price_add_up(rows, fitted):
    for groups in (None, {}):
        out = model.explained(fitted, rows.where("price > 0"), n=3, groups=groups)
        rest = F.col("fair_price") - F.col("factors_base") - F.aggregate("factors", F.lit(0.0), lambda a, x: a + x["amount"]) - F.col("factors_other")
        got = out.agg(F.count("*").alias("n"), F.max(F.abs(rest)).alias("off"), F.max(F.size("factors")).alias("most")).first()
        assert got.n == rows.where("price > 0").count() and got.off < 1e-6 and got.most <= 3
        joined = out.join(model.estimate(fitted, rows.where("price > 0")).select("id", F.bround("fair_price", -4).alias("p")), "id")
        assert joined.where(F.abs(F.col("p") - F.col("fair_price")) > 10_001).count() == 0  # but for what lies on the edge of rounding


def test_money_of_contributions(spark):
    """Rows by hand: base 9 and one factor that doubles e^y; and no factor at all."""
    data = [(1, float(np.log1p(1_000_000)), {"a": float(np.log(2)), "b": 0.0}), (2, float(np.log1p(1_000_000)), {"a": 0.0, "b": 0.0})]
    out = explain.in_money(spark.createDataFrame(data, "id int, base double, contributions map<string, double>")).orderBy("id").collect()
    assert (out[0].fair_price, out[0].factors_base, out[0].factors_other) == (2_000_000, 1_000_000, 0)
    assert [(f.factor, f.impact_pct, f.amount) for f in out[0].factors] == [("a", 100.0, 1_000_000)]
    assert (out[1].fair_price, list(out[1].factors), out[1].factors_other) == (1_000_000, [], 0)


def test_quantile_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (4000, 2))
    y = np.where(x[:, 0] > 0.5, 3.0, 0.0) + rng.normal(0, 0.2 + 0.8 * (x[:, 1] > 0.5), 4000)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    models = [boosting.fit(df.repartition(n), ["a", "b"], "y", (0.1, 0.9), trees=10, depth=2) for n in (1, 5)]
    one, two = models
    assert [(t.tau, t.features, t.bins, t.values.tolist()) for t in one.trees] == [(t.tau, t.features, t.bins, t.values.tolist()) for t in two.trees]
    out = boosting.predict(one, df, ("low", "high"))
    got = out.agg(F.avg((F.col("y") < F.col("low")).cast("int")).alias("l"), F.avg((F.col("y") > F.col("high")).cast("int")).alias("h")).first()
    assert abs(got.l - 0.1) < 0.02 and abs(got.h - 0.1) < 0.02
    wide = out.groupBy((F.col("b") > 0.5).alias("late")).agg(F.avg(F.col("high") - F.col("low")).alias("w")).orderBy("late").collect()
    assert wide[1].w > 3 * wide[0].w


def days(spark, counts: dict[str, int], missing: int = 0):
    rows = [(i, d) for d, n in counts.items() for i in range(n)] + [(i, None) for i in range(missing)]
    return spark.createDataFrame([(k, d) for k, (_, d) in enumerate(rows)], "id long, d string").select("id", F.col("d").cast("timestamp_ntz").alias("first_seen"))


def taken(spark, counts: dict[str, int], missing: int = 0, **rules) -> dict[str, int]:
    out = windows.recent_split(days(spark, counts, missing), **rules)
    assert out.count() == sum(counts.values()) + missing
    return {str(r.d): r["count"] for r in out.where("is_test").groupBy(F.to_date("first_seen").alias("d")).count().collect()}


def test_recent_split_takes_whole_days_under_the_cap(spark):
    """Each case by hand from the rule; 1,000 rows, the cap is 200."""
    old = {"2024-01-01": 800}
    rules = {"least": 50, "need": 0.1}
    assert taken(spark, old | {"2024-03-01": 90, "2024-03-02": 110}, **rules) == {"2024-03-01": 90, "2024-03-02": 110}
    # Enough is taken: the next day doesn't fit and nothing is drawn from it.
    assert taken(spark, {"2024-01-01": 700, "2024-03-01": 190, "2024-03-02": 110}, **rules) == {"2024-03-02": 110}
    # Too few are taken: a part of the next day fills up to the cap, and always the same part.
    case = {"2024-01-01": 700, "2024-03-01": 250, "2024-03-02": 50}
    assert taken(spark, case, **rules) == {"2024-03-01": 150, "2024-03-02": 50}
    picked = [sorted(r.id for r in windows.recent_split(days(spark, case).repartition(n), **rules).where("is_test").collect()) for n in (1, 4)]
    assert picked[0] == picked[1]
    # Beyond the window only while too few are taken, and never beyond 45 days.
    assert taken(spark, {"2024-01-01": 800, "2024-02-10": 80, "2024-03-02": 120}, **rules) == {"2024-03-02": 120}
    assert taken(spark, {"2023-01-01": 820, "2024-02-10": 90, "2024-03-02": 90}, **rules) == {"2024-02-10": 90, "2024-03-02": 90}
    assert taken(spark, {"2023-01-01": 820, "2024-01-10": 90, "2024-03-02": 90}, **rules) == {"2024-03-02": 90}


def test_recent_split_without_a_test(spark):
    assert taken(spark, {"2024-01-01": 950, "2024-03-02": 40}, least=500) == {}  # 40 are fewer than 198
    assert taken(spark, {}, missing=5) == {} and taken(spark, {"2024-03-02": 1}, missing=3) == {"2024-03-02": 1}
    bulk = {f"2024-03-0{i}": 20 for i in range(1, 6)} | {"2024-03-09": 2000}
    assert "2024-03-09" not in taken(spark, bulk, least=10) and sum(taken(spark, bulk, least=10).values()) == 100


def test_bounds_of_numbers(spark):
    """The rule's own bounds: years 1930 to three after the current one, ceilings 2 to 5, one to ten rooms."""
    columns = "floor int, total_floors int, year_built int, ceiling double, rooms int, lat double, lon double"
    rows = [(1, 5, 1930, 2.0, 1, 43.2, 76.9), (0, 101, 1929, 1.9, 0, 43.2, 10.0), (6, 5, 2027, 5.1, 11, None, 76.9), (5, 5, 2028, 5.0, 10, 43.2, 76.9)]
    out = [tuple(r) for r in filters.sanitized(spark.createDataFrame(rows, columns), 2024).collect()]
    assert out == [(1, 5, 1930, 2.0, 1, 43.2, 76.9), (None,) * 7, (None, 5, 2027, None, None, None, None), (5, 5, None, 5.0, 10, 43.2, 76.9)]


def test_fold_rows_know_only_what_was_known(spark):
    """Prices as of the part's end, stale and outside rows gone, one row a price level in both parts, leaks purged."""
    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    rows = [
        (1, "a", "2024-01-01", 1, None, 43.2, 76.9),
        (2, "b", "2024-01-02", 1, None, None, None),
        (3, "b", "2024-01-03", 1, None, 43.2, 76.9),  # same flat and price level as 2
        (4, "c", "2024-01-04", 0, "2023-09-01", 43.2, 76.9),  # gone long before
        (5, "d", "2024-01-05", 1, None, 50.0, 76.9),  # elsewhere
        (6, None, "2024-01-06", 1, None, 43.2, 76.9),
        (7, "a", "2024-02-03", 1, None, 43.2, 76.9),
        (8, "e", "2024-02-04", 1, None, 43.2, 76.9),
        (9, "e", "2024-02-05", 1, None, 43.2, 76.9),  # relisted within the test
        (10, "f", "2024-02-05", 1, None, 43.2, 76.9),  # first price comes later
        (11, "g", "2024-02-20", 1, None, 43.2, 76.9),
    ]
    listings = spark.createDataFrame(rows, "id long, fp string, first_seen string, is_active int, delisted_at string, lat double, lon double").select("id", "fp", at("first_seen"), "is_active", at("delisted_at"), "lat", "lon")
    log = [(i, 100 + i, "2024-01-10", 1) for i in range(1, 10)] + [(6, 900, "2024-02-03", 2), (2, 103, "2024-01-15", 2), (10, 50, "2024-02-20", 1), (9, 108, "2024-02-06", 2), (8, 700, "2024-02-09", 2)]
    history = spark.createDataFrame(log, "listing_id long, price long, observed_at string, seq int").select("listing_id", "price", at("observed_at"), "seq")
    out = sorted((r.id, r.part, r.price) for r in delivery.fold_rows(listings, history, "2024-02-01", "2024-02-08").collect())
    assert out == [(1, "purged", 101), (3, "train", 103), (6, "train", 106), (7, "test", 107), (9, "test", 108)]


def test_training_run(spark):
    from marketlens.plans.model import _rows

    out = training.train(_rows(spark, SF), tables.NOW, rules={"window": 400, "lookback": 900, "least": 40}, trees=6, depth=3, quantile_trees=4)
    r = out.report.first()
    assert r.n_rows == r.n_train + r.n_test + r.n_purged and r.n == r.n_test > 40 and r.r2 > 0.5 and 1 <= r.n_trees <= 6
    assert out.model.trees == r.n_trees


def test_backtest_without_enough_valid_folds(spark):
    from marketlens.plans.model import _history

    rows = _rows(spark, SF)
    out = training.backtest(rows, _history(spark, SF), folds=2, days=200, least_train=20, least_test=5, trees=4, depth=2, quantile_trees=2).collect()
    assert [r.fold for r in out] == [0, 1, None] and out[2].mape is None and "3 needed" in out[2].reason
    assert training.backtest(rows.where("false"), _history(spark, SF)).collect()[0].reason == "0 of 0 folds are valid, 3 needed"


def test_contributions_fit_no_bounds(spark, monkeypatch):
    """Parts of an estimate need the trees on the log price alone; bounds would take most of the time."""
    from marketlens.operators import boosting
    from marketlens.plans import model as plans

    def never(*args, **params):
        raise AssertionError("bounds were fitted")

    monkeypatch.setattr(boosting, "fit", never)
    out = plans.QUERIES["model_contributions"](spark, "/root/testdata/sf0.001").limit(20).collect()
    assert out and all(abs(r.fair_price - r.factors_base - sum(f.amount for f in r.factors) - r.factors_other) < 1e-6 for r in out)


def test_counts_equal_plain_ones(spark):
    """Few numbers of many, many of few, rows that are parts of larger batches, and the codes of bins without copies."""
    import numpy as np
    import pyarrow as pa

    from marketlens.operators import boosting

    rng = np.random.default_rng(2)
    x = rng.integers(0, 32, (3000, 5), dtype=np.uint8)
    column = boosting._binary(x)
    assert column.to_pylist() == [r.tobytes() for r in x]
    assert (boosting._bytes(column.slice(700, 90), 90) == x[700:790]).all()
    rows = spark.createDataFrame([(r.tobytes(), float(i), [0.0, 0.0]) for i, r in enumerate(x)], "x binary, y double, f array<double>").repartition(3)
    for bins, key in ((64, lambda x, y, f: x.ravel().astype(np.int64)), (200_000, lambda x, y, f: x[:, 0].astype(np.int64) * 6000 + x[:, 1])):
        assert (boosting._counted(rows, [], key, bins) == np.bincount(key(x, None, None), minlength=bins)).all()
    assert pa.types.is_binary(column.type)
