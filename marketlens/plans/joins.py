"""Lookups, neighbours and matches over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions import geo, text
from marketlens.operators import filters, joins

L, H, P, R = t.listings, t.history, t.predictions, t.runs
_L = t.sql("listing")


def _sharded(s, d):
    """A shard for each listing that isn't a multiple of 5."""
    return L(s, d).where("id % 5 > 0").select(F.col("id").alias("listing_id"), F.concat("deal", F.lit(" "), F.col("rooms").cast("string")).alias("shard"))


_SHARDS = "shards AS (SELECT id AS listing_id, concat(deal, ' ', CAST(rooms AS VARCHAR)) AS shard FROM listing WHERE id % 5 > 0)"


def _places(s, d):
    """Suppliers stand for places of eight kinds."""
    return t.read(s, d, "supplier").selectExpr("s_suppkey as ord", "concat('c', cast(s_suppkey as string)) as label", "cast(s_suppkey % 8 as int) as kind", "43.1e0 + cast(s_suppkey * 37 % 3000 as double) / 10000 as lat", "76.7e0 + cast(s_suppkey * 91 % 5000 as double) / 10000 as lon")


def _squares(s):
    """A square with a hole, and a neighbour that overlaps it."""
    ring = lambda a, b, c, e: f"array(named_struct('lat', {a}e0, 'lon', {b}e0), named_struct('lat', {a}e0, 'lon', {e}e0), named_struct('lat', {c}e0, 'lon', {e}e0), named_struct('lat', {c}e0, 'lon', {b}e0))"
    rows = [
        f"select 1 as ord, 'west' as name, array({ring(43.20005, 76.85005, 43.30005, 76.95005)}) as outer, array({ring(43.24005, 76.89005, 43.26005, 76.91005)}) as inner",
        f"select 2 as ord, 'east' as name, array({ring(43.20005, 76.94005, 43.30005, 77.05005)}) as outer, array() as inner",
    ]
    return s.sql(rows[0]).unionByName(s.sql(rows[1]).withColumn("inner", F.expr("cast(inner as array<array<struct<lat: double, lon: double>>>)")))


_IN = "lat > {a} AND lat < {c} AND lon > {b} AND lon < {e}"
_WEST = f"({_IN.format(a='43.20005e0', b='76.85005e0', c='43.30005e0', e='76.95005e0')} AND NOT ({_IN.format(a='43.24005e0', b='76.89005e0', c='43.26005e0', e='76.91005e0')}))"
_EAST = f"({_IN.format(a='43.20005e0', b='76.94005e0', c='43.30005e0', e='77.05005e0')})"


def _baseline(s, d):
    rows = L(s, d)
    reference = rows.where("price > 0 and area > 0")
    out = joins.fallback_levels(rows.where("area > 0"), reference, (("district", "rooms"), ("district",), ()), F.col("price") / F.col("area"))
    return out.select("id", F.round(F.col("value") * F.col("area"), 4).alias("baseline"), "level")


def _ppsm_fallback(s, d):
    rows = L(s, d)
    reference = rows.where("price > 0 and area > 0 and deal = 'rent'")
    out = joins.fallback_levels(rows, reference, (("microdistrict",), ("district",), ()), F.col("price") / F.col("area"))
    return out.select("id", F.round("value", 4).alias("value"), "level")


def _complexes(s, d):
    customers = t.read(s, d, "customer").where("c_custkey % 3 > 0")
    return customers.select(F.col("c_custkey").alias("complex_id"), text.complex_name("c_name").alias("name_norm"), F.expr("case when c_custkey % 4 > 0 then c_acctbal end").alias("score"), F.col("c_mktsegment").alias("kind"))


def _complex_lookup(s, d):
    rows = L(s, d).where("complex_name is not null").select("id", F.expr("concat('Complex ', replace(complex_name, '#', '-'), case id % 4 when 0 then ' 2' when 1 then ' 2.0' when 2 then ' III' else '' end)").alias("complex_name"))
    return joins.complex_lookup(rows, _complexes(s, d), "complex_name", ("score", "kind"))


def _knn(s, d):
    rows = L(s, d).where("price > 0 and area > 0").withColumn("value", F.col("price") / F.col("area"))
    return joins.neighbours(L(s, d), rows)


def _subscriptions(s, d):
    rows = L(s, d).where("is_active = 1 and price > 0").withColumn("diff", (F.col("price") % 101).cast("long"))
    chats = t.read(s, d, "supplier").join(t.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    filters = chats.select(F.col("s_suppkey").alias("chat"), F.expr("case when s_suppkey % 5 > 0 then n_name end").alias("district"), F.expr("case when s_suppkey % 3 > 0 then cast(1 + s_suppkey % 6 as int) end").alias("rooms"), F.expr("case when s_suppkey % 2 = 0 then 20000000L end").alias("max_price"))
    sent = H(s, d).select(F.col("listing_id").alias("id"), (F.col("seq") % 100).alias("chat")).distinct()
    return joins.subscription_matches(rows, filters, sent)


def _fp(s, d):
    return L(s, d).withColumn("fp", F.when(F.col("area").isNotNull(), F.concat_ws("|", "district", "rooms", F.col("area").cast("int").cast("string"))))


def _hex(s, d):
    rows = L(s, d).withColumns({f"cell_{k}": geo.hex_cell(F.col("lat"), F.col("lon"), size) for k, size in (("fine", 0.8), ("coarse", 2.0))})
    out = joins.fallback_levels(rows, rows.where("price > 0 and area > 0"), (("cell_fine",), ("cell_coarse",), ("district",), ()), F.col("price") / F.col("area"), 8)
    return out.select("id", F.round("value", 4).alias("value"), "level")


def _sources(s, d):
    rows = L(s, d).select("id", "price", "district", "deal", (F.col("price") < 3_000_000).alias("is_rent"))
    return joins.either_source(rows.select("id"), rows.where("deal = 'sale' or id % 2 = 0"), rows.where("deal = 'rent' or id % 3 = 0"), ("price", "district"))


def _wishes(s, d):
    c = t.read(s, d, "customer").withColumn("wish", F.expr("concat('want ', cast(c_custkey % 9 as string), ' rooms, ', cast(c_custkey * 9000 as string), ' in Nation_', cast(c_nationkey as string))"))
    return c.select("c_custkey", text.wish("wish", tuple(f"NATION_{i}" for i in range(25))).alias("w")).select("c_custkey", "w.*")


QUERIES = {
    "join_hex_fallback": _hex,
    "join_unseen": lambda s, d: joins.unseen(_fp(s, d), "2001-03-01 00:00:00").select("id"),
    "join_either_source": _sources,
    "split_buildings": lambda s, d: joins.split_by_group(L(s, d), joins.building_key()).select("id", "is_test"),
    "filter_as_of": lambda s, d: filters.as_of(L(s, d), "1999-05-05 00:00:00").select("id"),
    "feature_wishes": _wishes,
    "feature_descriptions": lambda s, d: t.read(s, d, "documents").select("doc_id", F.length(text.without_tail("text")).alias("n")),
    "join_latest_fair_price": lambda s, d: joins.latest(P(s, d), "listing_id", "fair_price", "predicted_at", "seq", where="fair_price > 0"),
    "join_latest_stock": lambda s, d: joins.latest(R(s, d), "shard", "stock", "run_id", where="stock > 0"),
    "join_unattributed": lambda s, d: joins.unattributed(L(s, d), _sharded(s, d)),
    "join_backlog": lambda s, d: joins.backlog(L(s, d), _sharded(s, d)),
    "join_baseline": _baseline,
    "join_unit_price_fallback": _ppsm_fallback,
    "join_complex_lookup": _complex_lookup,
    "join_neighbours": _knn,
    "join_nearest_places": lambda s, d: joins.nearest_places(L(s, d), _places(s, d)),
    "join_zone": lambda s, d: joins.zone_of(L(s, d), _squares(s)),
    "join_zone_label": lambda s, d: joins.majority_label(L(s, d).withColumn("label", F.expr("case when id % 5 < 4 then 'a' else 'b' end")), _squares(s)),
    "join_nearest_centroid": lambda s, d: joins.nearest_centroid(L(s, d), _places(s, d), 3.0),
    "join_analogues": lambda s, d: joins.analogues(L(s, d), L(s, d)),
    "join_duplicates": lambda s, d: joins.duplicates(L(s, d).withColumns({"lat": F.lit(43.2), "lon": F.lit(76.9), "floor": F.lit(1), "total_floors": F.lit(9)})),
    "join_pin_counts": lambda s, d: joins.pin_counts(L(s, d), 2, 2),
    "join_purge": lambda s, d: joins.purge(_fp(s, d).where("first_seen <= '2001-06-01'"), _fp(s, d).where("first_seen > '2001-06-01'")).select("id"),
    "join_subscriptions": _subscriptions,
    "join_paired": lambda s, d: joins.paired(P(s, d).where("seq % 2 = 0").groupBy("listing_id").agg(F.max("fair_price").alias("v")), P(s, d).where("seq % 2 = 1").groupBy("listing_id").agg(F.max("fair_price").alias("v")), ("listing_id",), "v"),
}

_X, _Y = "lon * (111.32e0 * cos(radians(43.25e0)))", "lat * 111.32e0"
_PLACES = "SELECT s_suppkey AS ord, concat('c', CAST(s_suppkey AS VARCHAR)) AS label, CAST(s_suppkey % 8 AS INTEGER) AS kind, 43.1e0 + CAST(s_suppkey * 37 % 3000 AS DOUBLE) / 10000 AS plat, 76.7e0 + CAST(s_suppkey * 91 % 5000 AS DOUBLE) / 10000 AS plon FROM supplier"
_HEX_OF = """{p}0 AS (SELECT id, (lon * (111.32e0 * cos(radians(43.25e0))) * 1.7320508075688772e0 / 3 - lat * 111.32e0 / 3) / {size} AS q, lat * 111.32e0 * 2 / 3 / {size} AS r FROM listing WHERE lat IS NOT NULL), {p}1 AS (SELECT *, floor(q + 0.5e0) AS rq, floor(r + 0.5e0) AS rr, floor(-q - r + 0.5e0) AS rs FROM {p}0),
{p}2 AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM {p}1), {p} AS (SELECT id, concat(CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR), ':', CAST(CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR)) AS cell FROM {p}2)"""
_FPSQL = "f AS (SELECT id, first_seen, CASE WHEN area IS NOT NULL THEN concat_ws('|', district, CAST(rooms AS VARCHAR), CAST(CAST(area AS INTEGER) AS VARCHAR)) END AS fp FROM listing)"
ORACLES = {
    "join_hex_fallback": f"""{_L}, {_HEX_OF.format(p='hf', size='0.8e0')}, {_HEX_OF.format(p='hc', size='2.0e0')}, x AS (SELECT l.id, hf.cell AS cf, hc.cell AS cc, district, price / area AS v, price > 0 AND area > 0 AS ref FROM listing l LEFT JOIN hf ON hf.id = l.id LEFT JOIN hc ON hc.id = l.id),
a AS (SELECT cf, median(v) AS m FROM x WHERE ref GROUP BY 1 HAVING count(*) >= 8), b AS (SELECT cc, median(v) AS m FROM x WHERE ref GROUP BY 1 HAVING count(*) >= 8), c AS (SELECT district, median(v) AS m FROM x WHERE ref GROUP BY 1 HAVING count(*) >= 8), g AS (SELECT median(v) AS m FROM x WHERE ref)
SELECT x.id, round(coalesce(a.m, b.m, c.m, g.m), 4) AS value, CASE WHEN a.m IS NOT NULL THEN 0 WHEN b.m IS NOT NULL THEN 1 WHEN c.m IS NOT NULL THEN 2 ELSE 3 END AS level FROM x LEFT JOIN a ON a.cf = x.cf LEFT JOIN b ON b.cc = x.cc LEFT JOIN c ON c.district = x.district CROSS JOIN g""",
    "split_buildings": f"{_L} SELECT id, CAST(concat('0x', substr(md5(coalesce(CAST(CAST(round_even(lat * 10000, 0) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round_even(lon * 10000, 0) AS BIGINT) AS VARCHAR), concat('id:', CAST(id AS VARCHAR)))), 1, 8)) AS BIGINT) % 100 < 20 AS is_test FROM listing",
    "join_unseen": f"{_L}, {_FPSQL} SELECT id FROM f WHERE first_seen > TIMESTAMP '2001-03-01' AND (fp IS NULL OR fp NOT IN (SELECT fp FROM f WHERE first_seen <= TIMESTAMP '2001-03-01' AND fp IS NOT NULL))",
    "join_either_source": f"""{_L}, s AS (SELECT *, price < 3000000 AS is_rent FROM listing WHERE deal = 'sale' OR id % 2 = 0), r AS (SELECT * FROM listing WHERE deal = 'rent' OR id % 3 = 0)
SELECT l.id, CASE WHEN s.id IS NOT NULL AND NOT coalesce(s.is_rent, FALSE) THEN s.price ELSE r.price END AS price, CASE WHEN s.id IS NOT NULL AND NOT coalesce(s.is_rent, FALSE) THEN s.district ELSE r.district END AS district, CASE WHEN s.id IS NOT NULL AND NOT coalesce(s.is_rent, FALSE) THEN 'sale' WHEN r.id IS NOT NULL THEN 'rent' ELSE 'none' END AS source
FROM listing l LEFT JOIN s ON s.id = l.id LEFT JOIN r ON r.id = l.id""",
    "filter_as_of": f"{_L} SELECT id FROM listing WHERE (first_seen IS NULL OR first_seen <= TIMESTAMP '1999-05-05') AND (coalesce(is_active, 1) = 1 OR coalesce(delisted_at >= TIMESTAMP '1999-05-05' - INTERVAL 90 DAY, FALSE)) AND (lat IS NULL OR lon IS NULL OR (lat BETWEEN 43.12e0 AND 43.38e0 AND lon BETWEEN 76.75e0 AND 77.15e0))",
    "feature_wishes": "SELECT c_custkey, CASE WHEN c_custkey % 9 BETWEEN 1 AND 6 THEN CAST(c_custkey % 9 AS INTEGER) END AS rooms, CASE WHEN c_custkey * 9000 >= 1000000 THEN c_custkey * 9000 END AS max_price, CASE WHEN c_nationkey IN (1, 2) THEN concat('nation_', CAST(c_nationkey AS VARCHAR)) ELSE concat('nation_', CAST(c_nationkey AS VARCHAR)) END AS district FROM customer",
    "feature_descriptions": "SELECT doc_id, CAST(length(trim(regexp_replace(text, '(?is)\\s*(?:this work is licensed under|all rights reserved).*$', ''))) AS INTEGER) AS n FROM documents",
    "join_latest_fair_price": f"{t.sql('prediction')} SELECT listing_id, fair_price FROM prediction WHERE fair_price > 0 QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY predicted_at DESC, seq DESC) = 1",
    "join_latest_stock": f"{t.sql('run')} SELECT shard, arg_max(stock, run_id) AS stock FROM run WHERE stock > 0 GROUP BY shard",
    "join_unattributed": f"{_L}, {_SHARDS} SELECT id FROM listing WHERE is_active = 1 AND title IS NULL AND id NOT IN (SELECT listing_id FROM shards)",
    "join_backlog": f"{_L}, {_SHARDS} SELECT shard, count(*) AS n FROM listing JOIN shards ON id = listing_id WHERE is_active = 1 AND title IS NULL GROUP BY shard",
    "join_baseline": f"""{_L}, r AS (SELECT district, rooms, price / area AS v FROM listing WHERE price > 0 AND area > 0), a AS (SELECT district, rooms, median(v) AS m FROM r GROUP BY 1, 2), b AS (SELECT district, median(v) AS m FROM r GROUP BY 1), c AS (SELECT median(v) AS m FROM r)
SELECT id, round(coalesce(a.m, b.m, c.m) * area, 4) AS baseline, CASE WHEN a.m IS NOT NULL THEN 0 WHEN b.m IS NOT NULL THEN 1 ELSE 2 END AS level FROM listing l LEFT JOIN a ON l.district = a.district AND l.rooms = a.rooms LEFT JOIN b ON l.district = b.district CROSS JOIN c WHERE area > 0""",
    "join_unit_price_fallback": f"""{_L}, r AS (SELECT microdistrict, district, price / area AS v FROM listing WHERE price > 0 AND area > 0 AND deal = 'rent'), a AS (SELECT microdistrict, median(v) AS m FROM r GROUP BY 1), b AS (SELECT district, median(v) AS m FROM r GROUP BY 1), c AS (SELECT median(v) AS m FROM r)
SELECT id, round(coalesce(a.m, b.m, c.m), 4) AS value, CASE WHEN a.m IS NOT NULL THEN 0 WHEN b.m IS NOT NULL THEN 1 ELSE 2 END AS level FROM listing l LEFT JOIN a ON l.microdistrict = a.microdistrict LEFT JOIN b ON l.district = b.district CROSS JOIN c""",
    "join_complex_lookup": f"""{_L}, n AS (SELECT c_custkey AS complex_id, trim(regexp_replace(regexp_replace(lower(c_name), '["''«»()]', '', 'g'), '[\\s#_/.-]+', ' ', 'g')) AS k, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS score, c_mktsegment AS kind FROM customer WHERE c_custkey % 3 > 0),
r AS (SELECT id, concat('Complex ', replace(complex_name, '#', '-'), CASE id % 4 WHEN 0 THEN ' 2' WHEN 1 THEN ' 2.0' WHEN 2 THEN ' III' ELSE '' END) AS complex_name FROM listing WHERE complex_name IS NOT NULL),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(complex_name), '^(жк|complex)\\s+', ''), '[\\s#_/.-]+', ' ', 'g')) AS k1 FROM r), kk AS (SELECT *, regexp_replace(k1, '\\s+([0-9]+(\\s+[0-9]+)?|[ivx]+)$', '') AS k2 FROM k)
SELECT id, complex_name, CASE WHEN a.k IS NOT NULL THEN a.score ELSE b.score END AS complex_score, CASE WHEN a.k IS NOT NULL THEN a.kind ELSE b.kind END AS complex_kind FROM kk LEFT JOIN n a ON a.k = k1 LEFT JOIN n b ON b.k = k2""",
    "join_neighbours": f"""{_L}, p AS (SELECT id, {_X} AS x, {_Y} AS y FROM listing), r AS (SELECT id, {_X} AS x, {_Y} AS y, price / area AS v FROM listing WHERE price > 0 AND area > 0 AND lat IS NOT NULL),
n AS (SELECT p.id, r.v, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(r.x - p.x, 2) + pow(r.y - p.y, 2)), r.id) AS k FROM p JOIN r ON p.id <> r.id AND pow(r.x - p.x, 2) + pow(r.y - p.y, 2) <= 1),
m AS (SELECT id, count(*) AS n, median(v) AS v FROM n WHERE k <= 15 GROUP BY id) SELECT p.id, coalesce(n, 0) AS n, round(CASE WHEN n >= 3 THEN v END, 4) AS value FROM p LEFT JOIN m USING (id)""",
    "join_nearest_places": f"""{_L}, k AS ({_PLACES})
SELECT id, kind, round(min(sqrt(pow((plon - lon) * 111.32e0 * cos(radians((lat + plat) / 2)), 2) + pow((plat - lat) * 111.32e0, 2))), 6) AS km FROM listing, k WHERE lat IS NOT NULL GROUP BY 1, 2""",
    "join_zone": f"{_L} SELECT id, CASE WHEN {_WEST} THEN 'west' WHEN {_EAST} THEN 'east' END AS zone FROM listing",
    "join_zone_label": f"""{_L}, z AS (SELECT CASE WHEN {_WEST} THEN 'west' WHEN {_EAST} THEN 'east' END AS zone, CASE WHEN id % 5 < 4 THEN 'a' ELSE 'b' END AS label FROM listing), c AS (SELECT zone, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY zone) AS total FROM z WHERE zone IS NOT NULL GROUP BY 1, 2)
SELECT zone, label, n FROM c WHERE n >= 0.6e0 * total AND total >= 3""",
    "join_nearest_centroid": f"""{_L}, c AS (SELECT ord, label, plat AS clat, plon AS clon FROM ({_PLACES})), p AS (SELECT id, lat, lon FROM listing),
k AS (SELECT id, ord, label, round(2 * 6371.0e0 * asin(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))), 9) AS km FROM p, c)
SELECT p.id, b.label FROM p LEFT JOIN (SELECT id, label FROM k WHERE km <= 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, ord DESC) = 1) b USING (id)""",
    "join_analogues": f"""{_L}, m AS (SELECT a.id, b.id AS analogue, CASE WHEN a.district = b.district THEN 1 ELSE 0 END AS same_district,
  round(sqrt(pow((b.area - a.area) / (a.area * 0.25e0), 2) + 0.5e0 * coalesce(pow((b.floor - a.floor) / 5.0e0, 2), 2.25e0) + 0.5e0 * coalesce(pow((b.year_built - a.year_built) / 10.0e0, 2), 2.25e0)), 6) AS distance
  FROM listing a JOIN listing b ON a.rooms = b.rooms AND a.id <> b.id AND b.area BETWEEN a.area * 0.75e0 AND a.area * 1.25e0 WHERE a.area > 0 AND b.is_active = 1 AND b.price > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY same_district DESC, distance, analogue) AS INTEGER) AS rank FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY same_district DESC, distance, analogue) <= 5""",
    "join_duplicates": f"""{_L}, f AS (SELECT concat_ws('|', coalesce(district, ''), CAST(rooms AS VARCHAR), CAST(area * 2 AS VARCHAR)) AS fp, id, is_active, last_seen FROM listing WHERE area IS NOT NULL)
SELECT a.id, b.id AS duplicate FROM f a JOIN f b ON a.fp = b.fp AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.is_active DESC, b.last_seen DESC, b.id) = 1""",
    "join_pin_counts": f"""{_L}, k AS (SELECT id, count(*) OVER (PARTITION BY CAST(round(lat * 100) AS BIGINT), CAST(round(lon * 100) AS BIGINT)) - 1 AS others FROM listing WHERE lat IS NOT NULL AND lon IS NOT NULL) SELECT id, others, CASE WHEN others >= 2 THEN 1 ELSE 0 END AS coords_approx FROM k""",
    "join_purge": f"{_L}, {_FPSQL} SELECT id FROM f WHERE first_seen <= TIMESTAMP '2001-06-01' AND (fp IS NULL OR fp NOT IN (SELECT fp FROM f WHERE first_seen > TIMESTAMP '2001-06-01' AND fp IS NOT NULL))",
    "join_subscriptions": f"""{t.sql("listing", "history")}, f AS (SELECT s_suppkey AS chat, CASE WHEN s_suppkey % 5 > 0 THEN n_name END AS district, CASE WHEN s_suppkey % 3 > 0 THEN 1 + s_suppkey % 6 END AS rooms, CASE WHEN s_suppkey % 2 = 0 THEN 20000000 END AS max_price FROM supplier JOIN nation ON s_nationkey = n_nationkey),
h AS (SELECT f.chat, l.id, l.price % 101 AS diff FROM listing l JOIN f ON (f.district IS NULL OR f.district = l.district) AND (f.rooms IS NULL OR f.rooms = l.rooms) AND (f.max_price IS NULL OR l.price <= f.max_price) WHERE l.is_active = 1 AND l.price > 0 AND NOT EXISTS (SELECT 1 FROM history x WHERE x.listing_id = l.id AND x.seq % 100 = f.chat))
SELECT chat, id, diff, CAST(row_number() OVER (PARTITION BY chat ORDER BY diff, id) AS INTEGER) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY chat ORDER BY diff, id) <= 5""",
    "join_paired": f"""{t.sql("prediction")}, a AS (SELECT listing_id, max(fair_price) AS v FROM prediction WHERE seq % 2 = 0 GROUP BY 1), b AS (SELECT listing_id, max(fair_price) AS v FROM prediction WHERE seq % 2 = 1 GROUP BY 1)
SELECT listing_id, b.v - a.v AS difference FROM a JOIN b USING (listing_id) WHERE a.v IS NOT NULL AND b.v IS NOT NULL""",
}
