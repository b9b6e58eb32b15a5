"""Validation, forecasts and indices over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions import geo
from marketlens.operators import asof, stats, validity as v
from marketlens.plans.stats import ORACLES as _STATS

L, H, P = t.listings, t.history, t.predictions
_L = t.sql("listing")


def _judged(s, d):
    """Each listing's price against the last positive estimate of it."""
    rows = P(s, d).where("fair_price > 0").groupBy("listing_id").agg(*(F.max_by(c, F.struct("predicted_at", "seq")).alias(c) for c in ("fair_price", "fair_low", "fair_high")))
    return L(s, d).where("price > 0").join(rows, F.col("id") == F.col("listing_id")).select("id", "district", "rooms", "price", "fair_price", "fair_low", "fair_high")


_JUDGED = f"""{t.sql("listing", "prediction")}, p AS (SELECT listing_id, fair_price, fair_low, fair_high FROM prediction WHERE fair_price > 0 QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY predicted_at DESC, seq DESC) = 1),
j AS (SELECT id, district, rooms, price, fair_price, fair_low, fair_high FROM listing JOIN p ON id = listing_id WHERE price > 0)"""


def _documents(s, d):
    return t.read(s, d, "documents").select("doc_id", "lang", "source", F.expr("n_chars div 1000").alias("size"))


def _trend(s, d, by=None):
    return asof.weekly_trend(L(s, d), H(s, d), t.NOW, 26, 5, by)


def _cells(s, d):
    rows = stats.active(L(s, d)).where("lat is not null")
    cell = geo.hex_cell(F.col("lat"), F.col("lon"), 2.0)
    return rows.select("id", cell.alias("cell"), F.date_trunc("month", "first_seen").cast("timestamp_ntz").alias("week"), "ppsm")


def _index(s, d):
    out = v.city_index(_cells(s, d), "cell", "week", "ppsm", 15)
    return out.select(F.date_format("week", "yyyy-MM").alias("week"), F.round("value", 4).alias("value"))


def _hex_map(s, d):
    return _cells(s, d).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.median("ppsm"), 4).alias("ppsm")).where("n >= 8")


def _gate(s, d):
    def metrics(rows):
        return v.regression_metrics(rows, "price", "fair_price").select("mape", "mae").crossJoin(v.interval_quality(rows, "price", "fair_low", "fair_high", "fair_price").select("coverage", "width"))

    rows = _judged(s, d)
    return v.gate(metrics(rows.where("id % 2 = 0")), metrics(rows.where("id % 2 = 1")))


def _kinds(s, d):
    """The judged listings with their kind of building."""
    kind = L(s, d).select("id", F.when(F.col("category") == "novostroiki", "new").otherwise("old").alias("kind"))
    return _judged(s, d).where("district is not null").join(kind, "id")


def _recent(s, d):
    days = L(s, d).select("district", F.to_date("first_seen").alias("day"))
    return v.time_confounding(days, "district", least=3, window=400)


def _gate_history(s, d):
    """All judged listings as the new model; those of each number of rooms as the models before it."""
    rows = _judged(s, d)
    return v.gate_history(v.regression_metrics(rows, "price", "fair_price"), v.regression_metrics(rows, "price", "fair_price", "rooms"), "rooms")


QUERIES = {
    "validity_gate_history": _gate_history,
    "validity_segments": lambda s, d: v.segments(_kinds(s, d), "price", "fair_price", "fair_low", "fair_high", "district", "kind"),
    "validity_confounding_recent": _recent,
    "validity_distance": lambda s, d: v.variation_distance(_documents(s, d).where("doc_id % 3 = 0"), _documents(s, d), ("lang", "source", "size")),
    "validity_representative": lambda s, d: v.representativeness(_documents(s, d).where("doc_id % 3 = 0"), _documents(s, d), ("lang", "source", "size")),
    "validity_confounding": lambda s, d: v.time_confounding(L(s, d).select("district", F.date_trunc("month", "first_seen").alias("day")), "district"),
    "validity_errors": lambda s, d: v.regression_metrics(_judged(s, d), "price", "fair_price"),
    "validity_errors_by_district": lambda s, d: v.regression_metrics(_judged(s, d), "price", "fair_price", "district").where("n >= 5"),
    "validity_intervals": lambda s, d: v.interval_quality(_judged(s, d), "price", "fair_low", "fair_high", "fair_price", "rooms"),
    "validity_bootstrap": lambda s, d: v.cluster_bootstrap(_judged(s, d).select("district", (F.abs(F.col("price") - F.col("fair_price")) / F.col("price")).alias("ape")), "district", "ape", least=10).withColumns({c: F.round(c, 8) for c in ("mean", "low", "high")}),
    "validity_conformal_scale": lambda s, d: v.conformal_scale(_judged(s, d).select("district", F.round((F.greatest(F.col("fair_low") - F.col("price"), F.col("price") - F.col("fair_high"))) / F.col("fair_price"), 6).alias("score")), "district", "score"),
    "validity_gate": _gate,
    "forecast_city": lambda s, d: v.trend_line(_trend(s, d), "t", "median_ppsm"),
    "forecast_districts": lambda s, d: v.trend_line(_trend(s, d, "district"), "t", "median_ppsm", "district"),
    "forecast_month": lambda s, d: v.month_change(_trend(s, d)),
    "index_city": _index,
    "index_hex_map": _hex_map,
}

_FIT = """f AS (SELECT {key}count(*) AS n, CASE WHEN max(y) = min(y) THEN 0.0 ELSE regr_slope(y, t) END AS slope, regr_intercept(y, t) AS b, max(t) AS last_,
CASE WHEN count(*) > 2 THEN sqrt(greatest((regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t)) / (count(*) - 2) / regr_sxx(y, t), 0)) END AS se FROM w {group})
SELECT {key}n, round(slope, 4) AS slope, round(se, 4) AS se, coalesce(abs(slope) > 2 * se, FALSE) AS significant, round(slope * 13 / (b + slope * last_) * 100, 2) AS change_13, round(slope * 26 / (b + slope * last_) * 100, 2) AS change_26 FROM f WHERE n >= 2"""
_CITY = _STATS["trend_weekly"].replace("range(12)", "range(26)").replace("(12 - 1 - i)", "(26 - 1 - i)").replace(">= 20", ">= 5")
_LONG = """x AS (SELECT doc_id, unnest([{{'c': 'lang', 'v': coalesce(lang, '?')}}, {{'c': 'source', 'v': coalesce(source, '?')}}, {{'c': 'size', 'v': CAST(n_chars // 1000 AS VARCHAR)}}], recursive := true) FROM documents),
p AS (SELECT c, v, count(*) / sum(count(*)) OVER (PARTITION BY c) AS p FROM x WHERE doc_id % 3 = 0 GROUP BY 1, 2), q AS (SELECT c, v, count(*) / sum(count(*)) OVER (PARTITION BY c) AS q FROM x GROUP BY 1, 2),
t AS (SELECT coalesce(p.c, q.c) AS "column", round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tvd FROM p FULL JOIN q ON p.c = q.c AND p.v = q.v GROUP BY 1)""".replace("{{", "{").replace("}}", "}")
_METRICS = "count(*) AS n, round(avg(abs(price - fair_price)), 4) AS mae, round(avg(abs(price - fair_price) / price) * 100, 4) AS mape, round(median(abs(price - fair_price) / price) * 100, 4) AS mdape, round(avg((fair_price - price) / price) * 100, 4) AS bias, round(1 - sum(pow(price - fair_price, 2)) / (var_pop(price) * count(*)), 4) AS r2"
_SQ3 = "1.7320508075688772e0"
_HEX = f"""h0 AS (SELECT *, (lon * (111.32e0 * cos(radians(43.25e0))) * {_SQ3} / 3 - lat * 111.32e0 / 3) / 2.0e0 AS q, lat * 111.32e0 * 2 / 3 / 2.0e0 AS r FROM a WHERE lat IS NOT NULL), h1 AS (SELECT *, floor(q + 0.5e0) AS rq, floor(r + 0.5e0) AS rr, floor(-q - r + 0.5e0) AS rs FROM h0),
h2 AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM h1), h AS (SELECT *, concat(CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR), ':', CAST(CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR)) AS cell FROM h2)"""
_A = _L + ", a AS (SELECT *, price / area AS ppsm FROM listing WHERE is_active = 1 AND price > 0 AND area > 0)"
_BOOT = "md5(concat_ws('|', coalesce(district, ''), CAST(rep AS VARCHAR), '11'))"
ORACLES = {
    "validity_gate_history": f"""{_JUDGED}, h AS (SELECT rooms, round(avg(abs(price - fair_price) / price) * 100, 4) AS mape FROM j GROUP BY 1 ORDER BY rooms DESC LIMIT 4), b AS (SELECT min(mape) AS best FROM h), n AS (SELECT round(avg(abs(price - fair_price) / price) * 100, 4) AS value FROM j)
SELECT 'history' AS "check", value <= best + greatest(0.5e0, best * 0.06e0) AS ok, value, best FROM n, b""",
    "validity_segments": f"""{_JUDGED}, c AS (SELECT quantile_cont(CAST(price AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM j WHERE district IS NOT NULL),
x AS (SELECT j.district, CASE WHEN l.category = 'novostroiki' THEN 'new' ELSE 'old' END AS kind, CAST(1 + (j.price > q[1])::INT + (j.price > q[2])::INT + (j.price > q[3])::INT + (j.price > q[4])::INT AS INTEGER) AS quintile, j.price, fair_price, fair_low, fair_high FROM j JOIN listing l ON l.id = j.id, c WHERE j.district IS NOT NULL),
g AS (SELECT district, kind, quintile, count(*) AS n, round(avg(abs(price - fair_price) / price) * 100, 4) AS mape, round(avg((fair_price - price) / price) * 100, 4) AS bias, round(avg(CASE WHEN price BETWEEN fair_low AND fair_high THEN 1 ELSE 0 END) * 100, 4) AS coverage,
round(median(abs(price - fair_price) / price * 100), 4) AS mdape, round(median((fair_high - fair_low) / greatest((fair_low + fair_high) / 2.0e0, 1.0e0) * 100), 4) AS width FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT *, row_number() OVER (ORDER BY mape DESC, district, kind, quintile) = 1 AS worst_error, row_number() OVER (ORDER BY coverage, district, kind, quintile) = 1 AS worst_coverage FROM g""",
    "validity_confounding_recent": f"""{_L}, a AS (SELECT CAST(first_seen AS DATE) AS day, coalesce(district, '?') AS v FROM listing), x AS (SELECT * FROM a WHERE (SELECT max(day) FROM a) - day < 400), c AS (SELECT day, v, count(*) AS n FROM x GROUP BY 1, 2), w AS (SELECT day, sum(n) AS w FROM c GROUP BY 1 HAVING sum(n) >= 3),
q AS (SELECT v, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY 1), k AS (SELECT w.day, w, sum(abs(coalesce(n, 0) / w - q)) / 2 AS tvd FROM w CROSS JOIN q LEFT JOIN c ON c.day = w.day AND c.v = q.v GROUP BY 1, 2) SELECT count(*) AS days, round(sum(w * tvd) / sum(w), 6) AS confounding FROM k""",
    "validity_distance": f"WITH {_LONG} SELECT * FROM t",
    "validity_representative": f'WITH {_LONG} SELECT arg_max("column", (tvd, "column")) AS worst, max(tvd) AS tvd, max(tvd) <= 0.2e0 AS ok FROM t',
    "validity_confounding": f"""{_L}, x AS (SELECT date_trunc('month', first_seen) AS day, coalesce(district, '?') AS v FROM listing), c AS (SELECT day, v, count(*) AS n FROM x GROUP BY 1, 2), w AS (SELECT day, sum(n) AS w FROM c GROUP BY 1 HAVING sum(n) >= 30),
q AS (SELECT v, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY 1), k AS (SELECT w.day, w, sum(abs(coalesce(n, 0) / w - q)) / 2 AS tvd FROM w CROSS JOIN q LEFT JOIN c ON c.day = w.day AND c.v = q.v GROUP BY 1, 2) SELECT count(*) AS days, round(sum(w * tvd) / sum(w), 6) AS confounding FROM k""",
    "validity_errors": f"{_JUDGED} SELECT {_METRICS} FROM j",
    "validity_bootstrap": f"""{_JUDGED}, bc AS (SELECT district, sum(abs(price - fair_price) / price) AS s, count(*) AS c FROM j GROUP BY 1), bu AS (SELECT s, c, rep, CAST(concat('0x', substr({_BOOT}, 1, 8)) AS BIGINT) / 4294967296.0e0 AS u FROM bc, (SELECT unnest(range(1, 2001)) AS rep)),
bw AS (SELECT s, c, rep, (u >= 0.36787944117144233e0)::INT + (u >= 0.73575888234288467e0)::INT + (u >= 0.91969860292860584e0)::INT + (u >= 0.98101184312384626e0)::INT + (u >= 0.99634015317265637e0)::INT + (u >= 0.99940581518241840e0)::INT + (u >= 0.99991675885071205e0)::INT AS w FROM bu),
bm AS (SELECT rep, sum(s * w) / nullif(sum(c * w), 0) AS m FROM bw GROUP BY 1), bp AS (SELECT count(*) AS clusters, sum(s) / sum(c) AS mean FROM bc)
SELECT clusters, round(mean, 8) AS mean, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high, CAST(NULL AS VARCHAR) AS reason FROM bp, bm GROUP BY clusters, mean""",
    "validity_errors_by_district": f"{_JUDGED} SELECT district, {_METRICS} FROM j GROUP BY district HAVING count(*) >= 5",
    "validity_intervals": f"""{_JUDGED} SELECT rooms, count(*) AS n, round(avg(CASE WHEN price BETWEEN fair_low AND fair_high THEN 1 ELSE 0 END) * 100, 4) AS coverage, round(median((fair_high - fair_low) / fair_price) * 100, 4) AS width,
round(avg(greatest(0.1e0 * (price - fair_low), -0.9e0 * (price - fair_low))), 2) AS pinball_low, round(avg(greatest(0.9e0 * (price - fair_high), (0.9e0 - 1) * (price - fair_high))), 2) AS pinball_high FROM j GROUP BY rooms""",
    "validity_conformal_scale": f"""{_JUDGED}, s AS (SELECT district, round(greatest(fair_low - price, price - fair_high) / fair_price, 6) AS score FROM j), n AS (SELECT count(DISTINCT district) AS k, count(*) AS n FROM s), r AS (SELECT ceil((n - 1) * least(ceil((k + 1) * 0.8e0) / k, 1.0e0)) + 1 AS rank FROM n),
o AS (SELECT score, row_number() OVER (ORDER BY score) AS rn FROM s) SELECT round(greatest(least(min(score), 10.0e0), 0.0e0), 6) AS scale FROM o, r WHERE rn >= rank""",
    "validity_gate": f"""{_JUDGED}, m AS (SELECT id % 2 AS part, round(avg(abs(price - fair_price) / price) * 100, 4) AS mape, round(avg(abs(price - fair_price)), 4) AS mae, round(avg(CASE WHEN price BETWEEN fair_low AND fair_high THEN 1 ELSE 0 END) * 100, 4) AS coverage, round(median((fair_high - fair_low) / fair_price) * 100, 4) AS width FROM j GROUP BY 1),
n AS (SELECT * FROM m WHERE part = 0), o AS (SELECT * FROM m WHERE part = 1)
SELECT 'mape' AS "check", n.mape <= o.mape + 0.5e0 AS ok FROM n, o UNION ALL SELECT 'mae', n.mae <= o.mae * 1.05e0 FROM n, o UNION ALL SELECT 'coverage', n.coverage BETWEEN 75 AND 90 FROM n, o UNION ALL SELECT 'width', n.width <= o.width * 1.25e0 FROM n, o""",
    "forecast_city": f"WITH w AS (SELECT t, median_ppsm AS y FROM ({_CITY})), " + _FIT.format(key="", group=""),
    "forecast_districts": f"WITH w AS (SELECT district, t, median_ppsm AS y FROM ({_STATS['trend_weekly_by_district']})), " + _FIT.format(key="district, ", group="GROUP BY district"),
    "forecast_month": f"WITH w AS (SELECT median_ppsm AS y, row_number() OVER (ORDER BY t DESC) AS r FROM ({_CITY})) SELECT round_even((max(y) FILTER (r = 1) - max(y) FILTER (r = 5)) * 100.0e0 / max(y) FILTER (r = 5), 1) AS month_pct FROM w",
    "index_city": f"{_A}, {_HEX}, b AS (SELECT cell FROM h GROUP BY 1 HAVING count(*) >= 15) SELECT strftime(date_trunc('month', first_seen), '%Y-%m') AS week, round(median(ppsm), 4) AS value FROM h WHERE cell IN (SELECT cell FROM b) GROUP BY 1 UNION ALL SELECT NULL, round(median(ppsm), 4) FROM h",
    "index_hex_map": f"{_A}, {_HEX} SELECT cell, count(*) AS n, round(median(ppsm), 4) AS ppsm FROM h GROUP BY 1 HAVING count(*) >= 8",
}
