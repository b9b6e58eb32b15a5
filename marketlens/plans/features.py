"""Filters, features, text functions and page readers over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions import geo, scoring, text
from marketlens.operators import filters
from marketlens.sources import html

L, P = t.listings, t.predictions
_L = t.sql("listing")


def _pages(s, d):
    return t.read(s, d, "pages")


def _docs(s, d):
    return t.read(s, d, "documents")


def _estimates(s, d):
    rows = L(s, d).join(P(s, d), F.col("id") == F.col("listing_id")).where("price > 0 and fair_price > 0")
    low, high = scoring.interval(F.col("fair_price"), F.col("fair_low"), F.col("fair_high"))
    diff = scoring.deviation_pct(F.col("price"), F.col("fair_price"))
    return rows.select(
        "id", "seq", low.alias("low"), high.alias("high"), scoring.verdict(F.col("price"), F.col("fair_low"), F.col("fair_high")).alias("verdict"), diff.alias("diff_pct"), scoring.price_band(diff).alias("band"),
        scoring.rounded(F.col("fair_price"), F.col("deal")).alias("rounded"), scoring.scam_level(F.col("price"), F.col("fair_low"), F.datediff("last_seen", "first_seen")).alias("scam"), scoring.verdict_by_share(F.col("price"), F.col("fair_price")).alias("verdict_by_share"),
        F.round(scoring.freshness_weight(F.col("photos_count"), 9.0), 6).alias("weight"), F.round(scoring.log_mean(F.col("price").cast("double"), F.col("fair_price").cast("double")), 2).alias("log_mean"),
        scoring.shard_label(F.col("district"), F.col("rooms")).alias("shard"),
    )


def _distances(s, d):
    lat, lon, c = F.col("lat"), F.col("lon"), (F.lit(43.25), F.lit(76.95))
    x, y = geo.project_km(lat, lon)
    walk = geo.walk_score({"a": (geo.plane_km(lat, lon, F.lit(43.2), F.lit(76.8)), 10.0), "b": (geo.plane_km(lat, lon, F.lit(43.3), F.lit(77.0)), 15.0)})
    return L(s, d).select("id", F.round(geo.haversine_km(lat, lon, *c), 6).alias("center_km"), F.round(geo.plane_km(lat, lon, *c), 6).alias("plane_km"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), walk.alias("walk"))


def _texts(s, d):
    floor, floors = text.floor_parts(F.expr("concat(cast(doc_id % 9 as string), case when doc_id % 3 = 0 then ' of 12' when doc_id % 3 = 1 then '/7' else '' end)"))
    return _docs(s, d).select(
        "doc_id", text.text_key("text").alias("key"), text.category("lang").alias("lang"), text.latest_year(F.concat(F.lit("built 1999, 20"), F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0"))).alias("year"),
        floor.alias("floor"), floors.alias("floors"), text.room_share("text").alias("room_share"), text.items_in(F.lit("a, ,b,c")).alias("items"), text.plural(F.col("doc_id"), "one", "few", "many").alias("word"), text.user_key("doc_id", "salt").alias("user"),
    )


def _page_facts(s, d):
    address, number = html.page_id(F.col("url"))
    h = F.col("html")
    return _pages(s, d).select("page_id", html.title(h).alias("title"), F.size(html.link_paths(h)).alias("n_links"), F.array_join(F.slice(html.link_paths(h), 1, 3), "|").alias("links"), html.has_next(h).alias("has_next"), html.is_challenge(h).alias("challenge"), address.alias("address"), number.alias("number"))


def _delisted(s, d):
    return filters.delist_guarded(L(s, d), "1999-01-01 00:00:00", 30, 1.0).select("id", "gone")


#: Bounds that some of the made-up listings overstep.
_BOUNDS = {"year_built": (1960, 2004), "ceiling": (2.5, 3.1), "rooms": (1, 5)}

QUERIES = {
    "filter_clean": lambda s, d: filters.clean(L(s, d)).select("id", "price", "area"),
    "filter_current": lambda s, d: filters.current(L(s, d), t.NOW).select("id"),
    "filter_sanitized": lambda s, d: filters.sanitized(L(s, d), 2001, _BOUNDS).select("id", "floor", "year_built", "ceiling", "rooms", "lat", "lon"),
    "filter_new_listings": lambda s, d: filters.new_listings(L(s, d), L(s, d).where("id % 4 = 0").select("id"), "2000-05-05 00:00:00").select("id"),
    "filter_delist": _delisted,
    "filter_refresh_queue": lambda s, d: filters.refresh_queue(L(s, d), "2000-01-01 00:00:00", 30, 200).select("id"),
    "feature_params": lambda s, d: filters.params_frame(L(s, d)),
    "feature_derived": lambda s, d: filters.feature_frame(L(s, d).withColumn("user_type", F.when(F.col("user_type") == "BUILDING", "complex").otherwise(F.col("user_type"))), 2001, _BOUNDS),
    "feature_fingerprint": lambda s, d: L(s, d).select("id", text.fingerprint().alias("fp")),
    "feature_estimates": _estimates,
    "feature_distances": _distances,
    "feature_texts": _texts,
    "page_facts": _page_facts,
    "page_details": lambda s, d: html.details(_pages(s, d)).select("page_id", "heading", "paragraphs", "n_words"),
    "deal_detection": lambda s, d: L(s, d).select("id", scoring.deal_of(F.expr("case when id % 5 = 0 then deal end"), F.col("price"), F.map_keys(text.params("raw_params")), ("rent.period",), ("flat.security",), 2_000_000, 5_000_000).alias("deal")),
}

_BOX = "lat BETWEEN 43.12e0 AND 43.38e0 AND lon BETWEEN 76.75e0 AND 77.15e0"
_SANE = f"""s AS (SELECT * REPLACE (CASE WHEN floor BETWEEN 1 AND 100 AND NOT coalesce(floor > total_floors, FALSE) THEN floor END AS floor, CASE WHEN year_built BETWEEN 1960 AND 2004 THEN year_built END AS year_built, CASE WHEN ceiling BETWEEN 2.5e0 AND 3.1e0 THEN ceiling END AS ceiling,
CASE WHEN rooms BETWEEN 1 AND 5 THEN rooms END AS rooms, CASE WHEN {_BOX} THEN lat END AS lat, CASE WHEN {_BOX} THEN lon END AS lon) FROM listing)"""
_CAT = "coalesce(nullif(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), ''), 'unknown')"
_JSON = "CASE WHEN json_valid(raw_params) THEN raw_params ELSE '{}' END"
_KM = "sqrt(pow(({b} - lon) * 111.32e0 * cos(radians((lat + {a}) / 2)), 2) + pow(({a} - lat) * 111.32e0, 2))"
_FP = "CASE WHEN area IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL THEN substr(sha1(concat_ws('|', coalesce(district, ''), coalesce(CAST(rooms AS VARCHAR), ''), CAST(CAST(round_even(area * 2, 0) AS BIGINT) AS VARCHAR), coalesce(CAST(floor AS VARCHAR), ''), CAST(total_floors AS VARCHAR), CAST(CAST(round_even(lat * 10000, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(lon * 10000, 0) AS BIGINT) AS VARCHAR))), 1, 16) END"
ORACLES = {
    "filter_clean": f"{_L} SELECT id, price, area FROM listing WHERE price BETWEEN 500000 AND 45000000 AND area BETWEEN 22 AND 125 AND price / area BETWEEN 10000 AND 1000000",
    "filter_current": f"{_L} SELECT id FROM listing WHERE (coalesce(is_active, 1) = 1 OR coalesce(delisted_at >= TIMESTAMP '{t.NOW}' - INTERVAL 90 DAY, FALSE)) AND (lat IS NULL OR lon IS NULL OR {_BOX})",
    "filter_sanitized": f"{_L}, {_SANE} SELECT id, floor, year_built, ceiling, rooms, lat, lon FROM s",
    "filter_new_listings": f"{_L} SELECT id FROM listing WHERE (first_seen >= TIMESTAMP '2000-05-05' - INTERVAL 26 HOUR OR (last_seen >= TIMESTAMP '2000-05-05' - INTERVAL 26 HOUR AND first_seen >= TIMESTAMP '2000-05-05' - INTERVAL 7 DAY)) AND id % 4 <> 0",
    "filter_delist": f"{_L} SELECT id, is_active = 1 AND last_seen < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY AS gone FROM listing",
    "filter_refresh_queue": f"{_L} SELECT id FROM listing WHERE is_active = 1 AND title IS NOT NULL AND last_seen < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY ORDER BY last_seen, id LIMIT 200",
    "feature_params": f"""{_L}, m AS (SELECT *, coalesce({_JSON}, '{{}}') AS j FROM listing), k AS (SELECT *, j ->> '$."flat.security"' AS sec, TRY_CAST(j ->> '$.balcony' AS INTEGER) AS b FROM m)
SELECT id, {_CAT.format('''coalesce(nullif(j ->> '$."flat.toilet"', ''), nullif(j ->> '$."flat.wc"', ''))''')} AS toilet, coalesce(j ->> '$."map.complex"', complex_name) AS complex, CASE WHEN sec IS NOT NULL THEN 3 END AS security_items, CASE WHEN contains(sec, 'video') THEN 1 ELSE 0 END AS has_video, b AS balconies,
CASE WHEN b IS NOT NULL THEN concat('b', CAST(b AS VARCHAR), '_l-1') ELSE 'unknown' END AS balcony_kind, {_CAT.format('building_type')} AS building, CAST(len(json_keys(j)) AS INTEGER) AS n_params FROM k""",
    "feature_derived": f"""{_L}, {_SANE} SELECT id, round(CAST(floor AS DOUBLE) / total_floors, 6) AS floor_ratio, CASE WHEN floor = 1 THEN 1 ELSE 0 END AS is_first_floor, CASE WHEN floor = total_floors THEN 1 ELSE 0 END AS is_last_floor, CASE WHEN year_built IS NOT NULL THEN greatest(2001 - year_built, -5) END AS building_age,
CASE WHEN category = 'novostroiki' OR CASE WHEN year_built IS NOT NULL THEN greatest(2001 - year_built, -5) END <= 1 OR user_type = 'BUILDING' THEN 1 ELSE 0 END AS is_new_building, CASE WHEN building_type = 'panel' AND year_built BETWEEN 1960 AND 1990 THEN 1 ELSE 0 END AS is_panel_age, round(ln(1 + price), 6) AS log_price FROM s""",
    "feature_fingerprint": f"{_L} SELECT id, {_FP} AS fp FROM listing",
    "feature_estimates": f"""{t.sql("listing", "prediction")}, r AS (SELECT *, round_even((price - fair_price) * 100.0e0 / fair_price, 1) + 0.0e0 AS diff, CASE WHEN fair_low > 0 AND price < fair_low THEN (1 - CAST(price AS DOUBLE) / fair_low) * 100 END AS below FROM listing JOIN prediction ON id = listing_id WHERE price > 0 AND fair_price > 0)
SELECT id, seq, least(fair_low, fair_high, fair_price) AS low, greatest(fair_low, fair_high, fair_price) AS high, CASE WHEN price < fair_low THEN 'good' WHEN price > fair_high THEN 'high' ELSE 'fair' END AS verdict, diff AS diff_pct, CASE WHEN diff <= -5 THEN 'below' WHEN diff < 5 THEN 'near' ELSE 'above' END AS band,
CAST(CASE WHEN deal = 'rent' THEN round_even(fair_price / 1000.0e0, 0) * 1000 ELSE round_even(fair_price / 10000.0e0, 0) * 10000 END AS BIGINT) AS rounded, CASE WHEN below >= 15 AND date_diff('day', first_seen, last_seen) <= 7 THEN 'high' WHEN below IS NOT NULL THEN 'medium' END AS scam, CASE WHEN (price - fair_price) / CAST(fair_price AS DOUBLE) < -0.1e0 THEN 'good' WHEN (price - fair_price) / CAST(fair_price AS DOUBLE) > 0.1e0 THEN 'high' ELSE 'fair' END AS verdict_by_share,
round(pow(0.5e0, photos_count / 9.0e0), 6) AS weight, round(CASE WHEN price = fair_price THEN CAST(price AS DOUBLE) ELSE (price - fair_price) / (ln(price) - ln(fair_price)) END, 2) AS log_mean, district || ' ' || CASE WHEN rooms >= 4 THEN '4+' ELSE CAST(rooms AS VARCHAR) END AS shard FROM r""",
    "feature_distances": f"""{_L} SELECT id, round(2 * 6371.0e0 * asin(sqrt(pow(sin(radians(43.25e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(43.25e0)) * pow(sin(radians(76.95e0 - lon) / 2), 2))), 6) AS center_km, round({_KM.format(a='43.25e0', b='76.95e0')}, 6) AS plane_km, round(lon * (111.32e0 * cos(radians(43.25e0))), 6) AS x, round(lat * 111.32e0, 6) AS y,
CASE WHEN lat IS NOT NULL THEN round((greatest(0, 1 - pow({_KM.format(a='43.2e0', b='76.8e0')} / 10, 2)) + greatest(0, 1 - pow({_KM.format(a='43.3e0', b='77.0e0')} / 15, 2))) / 6 * 100, 1) END AS walk FROM listing""",
    "feature_texts": f"""SELECT doc_id, sha256(substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 3000)) AS key, {_CAT.format('lang')} AS lang, CAST(greatest(1999, 2000 + doc_id % 24) AS INTEGER) AS year, CAST(doc_id % 9 AS INTEGER) AS floor, CASE doc_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 7 END AS floors,
regexp_matches(text, '(?i)(подсел|койко|комнат[ау] в|hostel|хостел|chambre|zimmer)') AS room_share, 3 AS items, CASE WHEN doc_id % 100 BETWEEN 11 AND 14 THEN 'many' WHEN doc_id % 10 = 1 THEN 'one' WHEN doc_id % 10 BETWEEN 2 AND 4 THEN 'few' ELSE 'many' END AS word, substr(sha256(concat('salt', CAST(doc_id AS VARCHAR))), 1, 12) AS user FROM documents""",
    "page_facts": r"""WITH p AS (SELECT *, list_distinct(regexp_extract_all(html, '<a href="/([^"]+)"', 1)) AS d, regexp_extract_all(html, '<a href="/([^"]+)"', 1) AS a, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(m\.|www\.)?', '') AS address FROM pages),
f AS (SELECT page_id, string_agg(x, '|' ORDER BY i) AS links FROM (SELECT page_id, x, i, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM (SELECT page_id, x, min(i) AS i FROM (SELECT page_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM p) GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1)
SELECT p.page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title, CAST(len(d) AS INTEGER) AS n_links, coalesce(links, '') AS links, regexp_matches(html, '(?i)<link[^>]+rel="next"') OR regexp_matches(html, '(?i)<a[^>]*class="[^"]*next') AS has_next,
contains(lower(html), 'class="g-recaptcha"') OR contains(lower(html), 'recaptcha/api2') OR contains(lower(html), 'grecaptcha.render') OR contains(lower(html), 'data-sitekey') OR contains(lower(html), 'attention required') OR contains(lower(html), 'cf-browser-verification') OR contains(lower(html), 'are you a robot') OR contains(lower(html), 'checking your browser') OR contains(lower(html), 'access denied') AS challenge, address, TRY_CAST(nullif(regexp_extract(address, '/(\d+)/?$', 1), '') AS BIGINT) AS number FROM p LEFT JOIN f USING (page_id)""",
    "deal_detection": f"""{_L} SELECT id, CASE WHEN id % 5 = 0 THEN deal WHEN price < 2000000 THEN 'rent' WHEN json_valid(raw_params) THEN 'sale' WHEN price < 5000000 THEN 'rent' ELSE 'sale' END AS deal FROM listing""",
}
