"""Market statistics over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.operators import asof, quantiles, stats

L, H = t.listings, t.history
_ACTIVE = ", a AS (SELECT *, price / area AS ppsm FROM listing WHERE is_active = 1 AND price > 0 AND area > 0)"
_BASE = t.sql("listing") + _ACTIVE
_LONG = "CAST(trunc({}) AS BIGINT)"


def _median(c: str) -> str:
    return _LONG.format(f"median({c})")


def _deal(rows, deal):
    return rows.where(f"deal = '{deal}'")


QUERIES = {
    "market_by_district": lambda s, d: stats.by_group(L(s, d), "district").orderBy(F.desc("median_ppsm"), "district"),
    "market_totals": lambda s, d: stats.totals(L(s, d)),
    "market_by_rooms": lambda s, d: stats.by_rooms(L(s, d)),
    "market_category_split": lambda s, d: stats.category_split(L(s, d)),
    "market_price_histogram": lambda s, d: stats.price_histogram(L(s, d), (0, 2, 5, 8, 10, 15, 20, 25, 30, 40, 45)),
    "market_unit_price_histogram": lambda s, d: stats.unit_price_histogram(L(s, d)),
    "market_heatmap": lambda s, d: stats.heatmap(L(s, d)),
    "market_shared_pins": lambda s, d: stats.shared_pins(L(s, d), 3, 2),
    "market_target_maps": lambda s, d: stats.target_maps(L(s, d)),
    "market_segment_medians": lambda s, d: stats.segment_medians(L(s, d)),
    "market_summary": lambda s, d: stats.summary(L(s, d), t.NOW, 30),
    "market_top_districts": lambda s, d: stats.top_districts(L(s, d)),
    "market_rent_yield": lambda s, d: stats.rent_yield(_deal(L(s, d), "rent"), _deal(L(s, d), "sale")),
    "market_district_yield": lambda s, d: stats.district_yield(_deal(L(s, d), "rent"), _deal(L(s, d), "sale"), t.NOW, 3, 400),
    "market_liquidity": lambda s, d: stats.liquidity(L(s, d), 15, 30),
    "market_exact_medians": lambda s, d: quantiles.exact_medians(L(s, d).withColumn("ppsm", stats.unit_price()), ("district", "deal"), "ppsm", 100).withColumn("median", F.round("median", 4)),
    "trend_weekly": lambda s, d: asof.weekly_trend(L(s, d), H(s, d), t.NOW, 12, 20),
    "trend_weekly_by_district": lambda s, d: asof.weekly_trend(L(s, d), H(s, d), t.NOW, 26, 5, "district"),
}

_EDGES = (0, 2, 5, 8, 10, 15, 20, 25, 30, 40, 45)


def _trend(weeks: int, least: int, by: str = "") -> str:
    key, lkey = (f"{by}, ", f"l.{by}, ") if by else ("", "")
    return f"""{t.sql("listing", "history")}, w AS (
  SELECT i AS t, date_trunc('week', TIMESTAMP '{t.NOW}') - to_days(CAST(7 * ({weeks} - 1 - i) AS INTEGER)) AS w_end FROM range({weeks}) r(i)
), alive AS (
  SELECT l.id, l.area, {lkey}w.t, w.w_end FROM listing l JOIN w ON l.first_seen < w.w_end AND coalesce(l.last_seen, l.first_seen) >= w.w_end - INTERVAL 7 DAY
  WHERE l.area > 0 AND l.price > 0
), seen AS (
  SELECT a.id, a.t, h.price, row_number() OVER (PARTITION BY a.id, a.t ORDER BY h.observed_at DESC, h.seq DESC) AS rn
  FROM alive a JOIN history h ON h.listing_id = a.id AND h.observed_at < a.w_end AND h.price > 0
)
SELECT {key}CAST(a.t AS INTEGER) AS t, CAST(trunc(median(s.price / a.area)) AS BIGINT) AS median_ppsm, count(s.price) AS n
FROM alive a LEFT JOIN seen s ON s.id = a.id AND s.t = a.t AND s.rn = 1
GROUP BY {key}a.t HAVING count(*) >= {least} AND count(s.price) >= {least}"""


ORACLES = {
    "market_by_district": f"{_BASE} SELECT district, count(*) AS n, {_median('ppsm')} AS median_ppsm, {_median('price')} AS median_price FROM a WHERE district IS NOT NULL GROUP BY district",
    "market_totals": f"{_BASE} SELECT count(*) AS total, {_median('price')} AS median_price, {_median('ppsm')} AS median_ppsm FROM a",
    "market_by_rooms": f"{_BASE} SELECT rooms, count(*) AS n, {_median('price')} AS median_price FROM a WHERE rooms BETWEEN 1 AND 6 GROUP BY rooms",
    "market_category_split": f"{_BASE} SELECT CASE WHEN category = 'novostroiki' THEN 'new' ELSE 'other' END AS kind, count(*) AS n FROM a GROUP BY 1",
    "market_price_histogram": f"""{_BASE}, b AS (SELECT i AS bin, [{','.join(map(str, _EDGES))}][i + 1] AS low, [{','.join(map(str, _EDGES))}][i + 2] AS high FROM range({len(_EDGES) - 1}) r(i))
SELECT CAST(bin AS INTEGER) AS bin, low, high, count(price) AS n FROM b LEFT JOIN a ON price >= low * 1000000 AND price < high * 1000000 GROUP BY ALL""",
    "market_unit_price_histogram": f"""{_BASE}, q AS (SELECT quantile_cont(ppsm, 0.01) AS lo, quantile_cont(ppsm, 0.99) AS hi FROM a), e AS (SELECT lo, hi, (hi - lo) / 38 AS step FROM q),
c AS (SELECT CAST(greatest(least(ceil((least(greatest(ppsm, lo), hi) - lo) / step) - 1, 37), 0) AS INTEGER) AS bin, count(*) AS n FROM a, e GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, CAST(round_even(lo + step * i, 0) AS BIGINT) AS from_ppsm, CAST(round_even(lo + step * (i + 1), 0) AS BIGINT) AS to_ppsm, coalesce(n, 0) AS n
FROM e, range(38) r(i) LEFT JOIN c ON c.bin = i""",
    "market_heatmap": f"{_BASE} SELECT CAST(round(lat / 0.004e0) AS BIGINT) AS lat_cell, CAST(round(lon / 0.004e0) AS BIGINT) AS lon_cell, count(*) AS n, round(avg(ppsm), 4) AS ppsm FROM a WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
    "market_shared_pins": f"{_BASE} SELECT CAST(round(lat * 100) AS BIGINT) AS lat_pin, CAST(round(lon * 100) AS BIGINT) AS lon_pin, count(*) AS n FROM listing WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
    "market_target_maps": f"""{t.sql("listing")}, r AS (SELECT coalesce(district, 'unknown') AS d, coalesce(microdistrict, 'unknown') AS m, price / area AS ppsm FROM listing WHERE price > 0 AND area > 0)
SELECT 'district' AS level, d AS name, round(median(ppsm), 4) AS median_ppsm FROM r GROUP BY d UNION ALL SELECT 'microdistrict', m, round(median(ppsm), 4) FROM r GROUP BY m UNION ALL SELECT 'all', '', round(median(ppsm), 4) FROM r""",
    "market_segment_medians": _BASE
    + ", s AS (SELECT *, 2001 - year_built AS age FROM a) "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS segment, round(median(ppsm), 4) AS median_ppsm FROM s WHERE {c}"
        for k, c in {
            "floor_first": "total_floors >= 5 AND floor = 1",
            "floor_last": "total_floors >= 5 AND floor = total_floors",
            "floor_middle": "total_floors >= 5 AND floor > 1 AND floor < total_floors",
            "age_new": "age >= 0 AND age < 5",
            "age_middle": "age >= 5 AND age < 25",
            "age_old": "age >= 25 AND age < 200",
            "area_small": "area < 40",
            "area_middle": "area >= 40 AND area < 70",
            "area_large": "area >= 70 AND area < 1000",
            "city": "TRUE",
        }.items()
    ),
    "market_summary": f"""{t.sql("listing")} SELECT count(*) AS total, count(*) FILTER (is_active = 1) AS active, count(*) FILTER (first_seen >= TIMESTAMP '{t.NOW}' - INTERVAL 30 DAY) AS inflow,
count(*) FILTER (delisted_at >= TIMESTAMP '{t.NOW}' - INTERVAL 30 DAY AND is_active <> 1) AS outflow, count(*) FILTER (is_active = 1 AND rooms = 1) AS rooms_1, count(*) FILTER (is_active = 1 AND rooms = 2) AS rooms_2,
count(*) FILTER (is_active = 1 AND rooms = 3) AS rooms_3, count(*) FILTER (is_active = 1 AND rooms >= 4) AS rooms_4_up, CAST(trunc(median(price) FILTER (is_active = 1)) AS BIGINT) AS median_price FROM listing""",
    "market_top_districts": f"{t.sql('listing')} SELECT district, count(*) AS n FROM listing WHERE is_active = 1 AND district IS NOT NULL GROUP BY district ORDER BY n DESC, district LIMIT 5",
    "market_rent_yield": f"""{_BASE}, r AS (SELECT district, count(*) AS n_rent, median(ppsm) AS rent FROM a WHERE deal = 'rent' AND district IS NOT NULL GROUP BY 1), s AS (SELECT district, median(ppsm) AS sale FROM a WHERE deal = 'sale' AND district IS NOT NULL GROUP BY 1)
SELECT district, n_rent, round(rent, 4) AS rent_ppsm, round(12 * rent / sale * 100, 1) AS gross_yield_pct FROM r LEFT JOIN s USING (district)""",
    "market_district_yield": f"""{t.sql("listing")}, x AS (SELECT deal, district, least(rooms, 4) AS rooms, price / area AS ppsm FROM listing WHERE last_seen >= TIMESTAMP '{t.NOW}' - INTERVAL 400 DAY AND price > 0 AND area > 0 AND district IS NOT NULL),
f AS (SELECT district, rooms, count(*) FILTER (deal = 'rent') AS nr, count(*) FILTER (deal = 'sale') AS ns, median(ppsm) FILTER (deal = 'rent') AS r, median(ppsm) FILTER (deal = 'sale') AS s FROM x GROUP BY 1, 2),
c AS (SELECT district, count(*) FILTER (deal = 'rent') AS nr, count(*) FILTER (deal = 'sale') AS ns, median(ppsm) FILTER (deal = 'rent') AS r, median(ppsm) FILTER (deal = 'sale') AS s FROM x GROUP BY 1),
y AS (SELECT f.district, f.rooms, CASE WHEN f.nr >= 3 AND f.ns >= 3 THEN 12 * f.r / f.s * 100 END AS fine, CASE WHEN c.nr >= 3 AND c.ns >= 3 THEN 12 * c.r / c.s * 100 END AS coarse FROM f JOIN c USING (district) WHERE f.nr > 0)
SELECT district, rooms, round(coalesce(fine, coarse), 2) AS yield_pct, CASE WHEN fine IS NOT NULL THEN 'district_rooms' ELSE 'district' END AS scope FROM y WHERE coalesce(fine, coarse) IS NOT NULL""",
    "market_liquidity": f"""{t.sql("listing")}, e AS (SELECT district, rooms, (epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000 AS days FROM listing WHERE is_active = 0 AND delisted_at IS NOT NULL AND first_seen_cohort IS NULL
  AND (epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000 >= 1 AND (epoch_us(delisted_at) - epoch_us(last_seen)) / 86400000000 <= 7),
f AS (SELECT district, rooms, count(*) AS n, median(days) AS days FROM e WHERE district IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15), c AS (SELECT count(*) AS n, median(days) AS days FROM e HAVING count(*) >= 30),
k AS (SELECT DISTINCT district, rooms FROM listing WHERE district IS NOT NULL AND rooms IS NOT NULL)
SELECT k.district, k.rooms, CAST(round_even(coalesce(f.days, c.days), 0) AS BIGINT) AS days, coalesce(f.n, c.n) AS n, CASE WHEN f.days IS NOT NULL THEN 'district_rooms' ELSE 'city' END AS scope FROM k LEFT JOIN f USING (district, rooms) CROSS JOIN c""",
    "market_exact_medians": f"{t.sql('listing')} SELECT district, deal, count(price / area) AS n, round(median(price / area), 4) AS median FROM listing WHERE price / area IS NOT NULL GROUP BY 1, 2",
    "trend_weekly": _trend(12, 20),
    "trend_weekly_by_district": _trend(26, 5, "district"),
}
