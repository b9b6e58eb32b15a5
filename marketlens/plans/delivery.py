"""Display, delivery and fold queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.functions import display, geometry
from marketlens.operators import delivery, joins, rings
from marketlens.sources import html

L, H, P = t.listings, t.history, t.predictions
_L = t.sql("listing")
_BOX = (43.12, 43.38, 76.75, 77.15)
_INBOX = "lat BETWEEN 43.12e0 AND 43.38e0 AND lon BETWEEN 76.75e0 AND 77.15e0"


def _scored(s, d):
    return L(s, d).where("is_active = 1 and price > 0").select("id", (F.col("price") % 101).cast("long").alias("diff"), (F.col("id") % 9 == 0).alias("suspicious"), (F.col("price") % 50).cast("long").alias("chat"), "last_seen")


_SCORED = "x AS (SELECT id, price % 101 AS diff, id % 9 = 0 AS suspicious, price % 50 AS chat, last_seen FROM listing WHERE is_active = 1 AND price > 0)"
_LOT = "CAST(concat('0x', substr(md5(concat(CAST(id AS VARCHAR), '|{seed}')), 1, 15)) AS BIGINT)"


def _display(s, d):
    rows = L(s, d)
    stamp = F.concat(F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("id") % 3 == 0, "+05:00").when(F.col("id") % 3 == 1, "Z").otherwise(""))
    shown = display.details({"district": "District", "category": "Kind", "building_type": "House"})
    known = display.known_values({"area": F.col("area").cast("long"), "floor": F.col("floor"), "rooms": F.col("rooms")})
    return rows.select(
        "id", display.moment(stamp).alias("moment"), display.is_quiet(display.moment(stamp)).alias("quiet"), display.data_as_of(F.when(F.col("id") % 4 == 0, "soon").otherwise(F.date_format("last_seen", "yyyy-MM-dd HH:mm")), F.date_format("first_seen", "yyyy-MM-dd")).cast("string").alias("as_of"),
        F.array_join(F.transform(shown["items"], lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";").alias("details"), F.size(known).cast("long").alias("n_known"), display.masked(F.col("id") + 1000).alias("chat"),
        display.in_city(F.when(F.col("id") % 3 == 0, F.lit(" Nation ")).when(F.col("id") % 3 == 1, F.lit("Other")), F.col("lat"), F.col("lon"), ("nation",), _BOX).alias("in_city"),
        display.is_complete("rooms", "area", "lat", "lon").alias("complete"), display.in_rectangle(F.col("lat"), F.col("lon"), (43.2, 43.3, 76.8, 77.0)).alias("square"), display.old_panel(F.col("building_type"), 2001 - F.col("year_built"), 30).alias("old_panel"),
        display.hint(F.lit("floor"), (F.col("id") % 41 - 20).cast("double")).alias("hint"), display.event_text(F.col("price"), F.col("price") + F.col("id") % 3 * 100_000, F.col("id") % 5 != 0, F.when(F.col("id") % 3 != 1, F.col("id") % 11)).alias("event"),
    )


def _subjects(s, d):
    ip = F.expr("case id % 3 when 0 then concat('10.0.', cast(id % 256 as string), '.7') when 1 then concat('::FFFF:10.1.', cast(id % 256 as string), '.7') else concat('2001:0db8::', cast(id % 10 as string), ':1') end")
    return L(s, d).select("id", display.ip_subject(ip).alias("subject"))


def _targets(s, d):
    price, area, index = F.col("price"), F.col("area"), 300_000 + F.col("rooms") * 1000
    out = {k: display.target(k, price, area, index) for k in ("price", "ppsm", "index_residual")}
    return L(s, d).where("price > 0 and area > 0").select("id", *(F.round(v, 6).alias(f"t_{k}") for k, v in out.items()), *(F.round(display.price_of_target(k, v, area, index), 0).cast("long").alias(f"p_{k}") for k, v in out.items()))


def _records(s, d):
    raw = F.concat(F.lit('{"rooms": "'), F.col("rooms").cast("string"), F.lit('", "area": "'), F.col("area").cast("int").cast("string"), F.lit('", "price": "12 '), (F.col("id") % 1000).cast("string"), F.lit('", "district": " '), F.coalesce("district", F.lit("?")), F.lit(' "}'))
    return L(s, d).select("id", display.typed_record(raw, {f"nation_{i}": f"n{i}" for i in range(20)}).alias("r")).select("id", "r.*")


def _cards(s, d):
    """Pages of search cards, made of the listings; a page's other links and prices lie outside of cards."""
    card = F.concat(F.lit('<div class="card" data-id="'), F.col("id").cast("string"), F.lit('"><a href="/show/'), F.col("id").cast("string"), F.lit('">flat</a><span class="price">'), F.coalesce(F.format_number("price", 0), F.lit("on request")), F.lit("</span></div>"))
    pages = L(s, d).groupBy(F.floor(F.col("id") / 40).alias("page")).agg(F.concat(F.lit('<html><span class="price">1</span>'), F.array_join(F.collect_list(card), ""), F.lit('<div class="card" data-id="7777777777"><a href="/show/1">x</a><span class="price">5</span></div></html>')).alias("html"))
    return pages.select(F.explode(html.card_prices(F.col("html"))).alias("id", "price"))


def _page_records(s, d):
    page = F.concat(F.lit("<html><h1>"), F.coalesce("title", F.lit("")), F.lit('</h1><div class="offer__price">'), F.coalesce(F.format_number("price", 0), F.lit("")), F.lit('</div><dl><dt>Area</dt><dd>'), F.coalesce(F.col("area").cast("int").cast("string"), F.lit("")), F.lit(' m2</dd><dt>Floor</dt><dd>'), F.coalesce(F.concat(F.col("floor").cast("string"), F.lit(" of "), F.col("total_floors").cast("string")), F.lit("")), F.lit('</dd></dl><script>var p = {"map":{"lat":'), F.coalesce(F.format_number("lat", 4), F.lit("null")), F.lit(',"lon":'), F.coalesce(F.format_number("lon", 4), F.lit("null")), F.lit("}};</script></html>"))
    return L(s, d).select("id", html.listing_record(page).alias("r")).select("id", "r.*")


def _geometry(s, d):
    node = F.concat(F.lit('{"type": "node", "id": '), F.col("id").cast("string"), F.lit(', "lat": '), F.format_number("lat", 4), F.lit(', "lon": '), F.format_number("lon", 4), F.lit("}"))
    way = F.concat(F.lit('{"type": "way", "id": '), F.col("id").cast("string"), F.lit(', "center": {"lat": 1.5, "lon": '), (F.col("id") % 90).cast("string"), F.lit(".0}}"))
    docs = L(s, d).groupBy(F.floor(F.col("id") / 50).alias("g")).agg(F.concat(F.lit('{"elements": ['), F.array_join(F.collect_list(F.when(F.col("id") % 2 == 0, node).otherwise(way)), ","), F.lit("]}")).alias("json"))
    return docs.select(F.explode(geometry.points(F.col("json"))).alias("p")).select("p.*")


def _with_fp(s, d):
    return L(s, d).withColumn("fp", F.when(F.col("area").isNotNull(), F.concat_ws("|", "district", "rooms", F.col("area").cast("int").cast("string"))))


def _cache(s, d):
    return P(s, d).groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("n")).select("id", (F.col("n") % 3).alias("h"), F.col("n").alias("flags"))


def _hashed(s, d):
    return L(s, d).select("id", "is_active", (F.col("id") % 3).alias("h"))


_CACHE = "c AS (SELECT listing_id AS id, count(*) % 3 AS h, count(*) AS flags FROM prediction GROUP BY 1), l AS (SELECT id, is_active, id % 3 AS h FROM listing)"
def _typed(s, d):
    """The record of every page by one pass over its tags."""
    return t.read(s, d, "pages").select("page_id", html.typed(F.col("html")).alias("r")).select("page_id", "r.*").select("page_id", "lang", "charset", "title", "heading", "paragraphs", F.size("links").alias("n_links"), F.array_join("links", " ").alias("links"), F.element_at("by_class", "ad").alias("advert"))


def _segments(s, d):
    """The outline of a square around each listing's point in four segments, two of them against the others' direction,
    with ends that are off by less than the tolerance; every seventh lacks one."""
    square = ((-1, -1), (-1, 1), (1, 1), (1, -1))
    at = lambda k, off=0.0: F.struct((F.col("lat") + square[k][0] * 0.001 + off).alias("lat"), (F.col("lon") + square[k][1] * 0.001).alias("lon"))
    middle = F.struct((F.col("lat") - 0.001).alias("lat"), F.col("lon").alias("lon"))
    ways = F.array(F.array(at(0), middle, at(1)), F.array(at(2), at(1, 4e-8)), F.array(at(2, -4e-8), at(3)), F.array(at(0, 4e-8), at(3)))
    rows = L(s, d).where("lat is not null").select(F.col("id").cast("string").alias("zone"), F.lit("outer").alias("role"), F.posexplode(ways).alias("ord", "points"), "id")
    return rows.where("id % 7 > 0 or ord < 3").select("zone", "role", "ord", "points")


def _rings(s, d):
    area = F.aggregate(F.sequence(F.lit(1), F.size("ring") - 1), F.lit(0.0), lambda a, i: a + F.element_at("ring", i)["lat"] * F.element_at("ring", i + 1)["lon"] - F.element_at("ring", i + 1)["lat"] * F.element_at("ring", i)["lon"])
    return rings.assemble(_segments(s, d)).select(F.col("zone").cast("long").alias("id"), F.size("ring").alias("points"), F.round(F.abs(area) / 2 * 1e6, 2).alias("area"), (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"))


QUERIES = {
    "page_typed": _typed,
    "geometry_rings": _rings,
    "show_fields": _display,
    "show_subjects": _subjects,
    "show_targets": _targets,
    "show_records": _records,
    "page_cards": _cards,
    "page_records": _page_records,
    "geometry_points": _geometry,
    "send_deals": lambda s, d: delivery.deals(_scored(s, d)).select("chat", "id", "place"),
    "send_digest": lambda s, d: delivery.digest(_scored(s, d), H(s, d).where("seq % 10 = 0").select(F.col("listing_id").alias("id"))).select("id", "diff"),
    "send_pool": lambda s, d: delivery.pool(_scored(s, d).where("not suspicious"), 100).select("id"),
    "send_pick": lambda s, d: delivery.pick(delivery.pool(_scored(s, d).where("not suspicious"), 50), "today").select("id"),
    "send_sample": lambda s, d: delivery.sample(L(s, d).select("id"), 500, "shap"),
    "send_turns": lambda s, d: delivery.turns(_scored(s, d)).select("chat", "turn", "id"),
    "contract_anomalies_since": lambda s, d: delivery.anomalies_since(L(s, d), F.col("price").isNull() | F.col("area").isNull(), "2000-01-01 00:00:00"),
    "join_validated": lambda s, d: joins.validated(_hashed(s, d), _cache(s, d), "id", "h", "flags"),
    "join_pending": lambda s, d: joins.pending(_hashed(s, d), _cache(s, d), "id", "h").select("id", "is_active"),
    "model_folds": lambda s, d: delivery.fold_rows(_with_fp(s, d), H(s, d), "2000-06-01 00:00:00", "2000-09-01 00:00:00"),
}

_STAMP = "epoch(first_seen)::BIGINT - CASE WHEN id % 3 = 0 THEN 18000 ELSE 0 END"
ORACLES = {
    "page_typed": """WITH p AS (SELECT page_id, html, regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g') AS h FROM pages)
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS heading,
CAST(len(regexp_extract_all(h, '<p>')) AS INTEGER) AS paragraphs, CAST(len(regexp_extract_all(h, '<a href="([^"]*)"', 1)) AS INTEGER) AS n_links, array_to_string(regexp_extract_all(h, '<a href="([^"]*)"', 1), ' ') AS links, trim(regexp_replace(regexp_extract(h, '(?s)<div class="ad">(.*?)</div>', 1), '\\s+', ' ', 'g')) AS advert FROM p""",
    "geometry_rings": f"{_L} SELECT id, 6 AS points, 4.0e0 AS area, TRUE AS closed FROM listing WHERE lat IS NOT NULL AND id % 7 > 0",
    "show_fields": f"""{_L} SELECT id, {_STAMP} AS moment, (({_STAMP}) + 18000) % 86400 // 3600 >= 22 OR (({_STAMP}) + 18000) % 86400 // 3600 < 8 AS quiet, strftime(CASE WHEN id % 4 = 0 THEN first_seen ELSE last_seen END, '%Y-%m-%d') AS as_of,
concat_ws(';', 'District=' || district, 'Kind=' || category, 'House=' || building_type) AS details, CAST((area IS NOT NULL)::INT + (floor IS NOT NULL)::INT + 1 AS BIGINT) AS n_known, concat('***', right(CAST(id + 1000 AS VARCHAR), 2)) AS chat,
CASE WHEN id % 3 = 0 THEN TRUE WHEN id % 3 = 1 THEN FALSE WHEN lat IS NOT NULL THEN {_INBOX} ELSE TRUE END AS in_city, area IS NOT NULL AND lat IS NOT NULL AS complete, CASE WHEN lat BETWEEN 43.2e0 AND 43.3e0 AND lon BETWEEN 76.8e0 AND 77.0e0 THEN 1 ELSE 0 END AS square,
CASE WHEN building_type = 'panel' AND 2001 - year_built > 30 THEN 1 ELSE 0 END AS old_panel, CASE WHEN abs(id % 41 - 20) >= 2 THEN concat('floor makes it ', CASE WHEN abs(id % 41 - 20) >= 10 THEN 'much ' ELSE '' END, CASE WHEN id % 41 > 20 THEN 'dearer' ELSE 'cheaper' END) END AS hint,
CASE WHEN id % 5 = 0 THEN CASE WHEN id % 3 = 1 OR id % 11 <= 7 THEN 'off the market' END WHEN id % 3 > 0 AND price IS NOT NULL THEN concat('price ', price, ' -> ', price + id % 3 * 100000, ' (', CASE WHEN round_even((id % 3 * 100000) * 100.0e0 / price, 0) > 0 THEN '+' ELSE '' END, CAST(round_even((id % 3 * 100000) * 100.0e0 / price, 0) AS BIGINT), ' %)') END AS event FROM listing""",
    "show_subjects": f"{_L} SELECT id, CASE id % 3 WHEN 0 THEN concat('10.0.', id % 256, '.7') WHEN 1 THEN concat('10.1.', id % 256, '.7') ELSE '2001:db8:0:0::/64' END AS subject FROM listing",
    "show_targets": f"{_L} SELECT id, round(ln(1 + price), 6) AS t_price, round(ln(price / area), 6) AS t_ppsm, round(ln(price / area / (300000 + rooms * 1000)), 6) AS t_index_residual, price AS p_price, price AS p_ppsm, price AS p_index_residual FROM listing WHERE price > 0 AND area > 0",
    "show_records": f"{_L} SELECT id, CASE WHEN area IS NOT NULL THEN rooms END AS rooms, area, CASE WHEN area IS NOT NULL THEN CAST(concat('12', CAST(id % 1000 AS VARCHAR)) AS BIGINT) END AS price, CASE WHEN area IS NOT NULL AND CAST(nullif(regexp_extract(district, '(\\d+)', 1), '') AS INTEGER) < 20 THEN concat('n', regexp_extract(district, '(\\d+)', 1)) END AS district FROM listing",
    "page_cards": f"{_L} SELECT id, price FROM listing",
    "page_records": f"{_L} SELECT id, title, price, CAST(CAST(area AS INTEGER) AS DOUBLE) AS area, floor, CASE WHEN floor IS NOT NULL THEN total_floors END AS total_floors, lat, lon FROM listing",
    "geometry_points": f"{_L} SELECT id, CASE WHEN id % 2 = 0 THEN lat ELSE 1.5e0 END AS lat, CASE WHEN id % 2 = 0 THEN lon ELSE CAST(id % 90 AS DOUBLE) END AS lon FROM listing WHERE id % 2 = 1 OR lat IS NOT NULL",
    "send_deals": f"{_L}, {_SCORED} SELECT chat, id, CAST(row_number() OVER (PARTITION BY chat ORDER BY suspicious, diff, id) AS INTEGER) AS place FROM x",
    "send_digest": f"{t.sql('listing', 'history')}, {_SCORED} SELECT id, diff FROM x WHERE NOT suspicious AND id NOT IN (SELECT listing_id FROM history WHERE seq % 10 = 0) ORDER BY diff, id LIMIT 5",
    "send_pool": f"{_L}, {_SCORED} SELECT id FROM x WHERE NOT suspicious ORDER BY last_seen DESC, id LIMIT 100",
    "send_pick": f"{_L}, {_SCORED}, p AS (SELECT id FROM x WHERE NOT suspicious ORDER BY last_seen DESC, id LIMIT 50) SELECT id FROM p ORDER BY {_LOT.format(seed='today')}, id LIMIT 1",
    "send_sample": f"{_L} SELECT id FROM listing ORDER BY {_LOT.format(seed='shap')}, id LIMIT 500",
    "send_turns": f"{_L}, {_SCORED} SELECT chat, CAST(row_number() OVER (PARTITION BY chat ORDER BY diff, id) AS INTEGER) AS turn, id FROM x",
    "contract_anomalies_since": f"{_L} SELECT count(*) AS anomalies FROM listing WHERE last_seen >= TIMESTAMP '2000-01-01' AND (price IS NULL OR area IS NULL)",
    "join_validated": f"{t.sql('listing', 'prediction')}, {_CACHE} SELECT l.id, c.flags FROM l LEFT JOIN c ON c.id = l.id AND c.h = l.h",
    "join_pending": f"{t.sql('listing', 'prediction')}, {_CACHE} SELECT l.id, is_active FROM l LEFT JOIN c ON c.id = l.id WHERE c.id IS NULL OR c.h <> l.h",
    "model_folds": f"""{t.sql('listing', 'history')}, f AS (SELECT *, CASE WHEN area IS NOT NULL THEN concat_ws('|', district, CAST(rooms AS VARCHAR), CAST(CAST(area AS INTEGER) AS VARCHAR)) END AS fp FROM listing),
pa AS (SELECT listing_id, arg_max(price, (observed_at, seq)) AS known FROM history WHERE observed_at < TIMESTAMP '2000-06-01' GROUP BY 1), pb AS (SELECT listing_id, arg_max(price, (observed_at, seq)) AS known FROM history WHERE observed_at < TIMESTAMP '2000-09-01' GROUP BY 1),
x AS (SELECT id, fp, known AS price, 'test' AS part FROM f JOIN pb ON listing_id = id WHERE known > 0 AND first_seen >= TIMESTAMP '2000-06-01' AND first_seen < TIMESTAMP '2000-09-01' AND (coalesce(is_active, 1) = 1 OR coalesce(delisted_at >= TIMESTAMP '2000-09-01' - INTERVAL 90 DAY, FALSE)) AND (lat IS NULL OR lon IS NULL OR (lat BETWEEN 43.12e0 AND 43.38e0 AND lon BETWEEN 76.75e0 AND 77.15e0))
UNION ALL SELECT id, fp, known, 'train' FROM f JOIN pa ON listing_id = id WHERE known > 0 AND first_seen < TIMESTAMP '2000-06-01' AND (coalesce(is_active, 1) = 1 OR coalesce(delisted_at >= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY, FALSE)) AND (lat IS NULL OR lon IS NULL OR (lat BETWEEN 43.12e0 AND 43.38e0 AND lon BETWEEN 76.75e0 AND 77.15e0))),
y AS (SELECT *, CASE WHEN price > lag(price) OVER (PARTITION BY part, fp ORDER BY price, id) * 1.02e0 THEN 1 ELSE 0 END AS fresh FROM x), z AS (SELECT *, sum(fresh) OVER (PARTITION BY part, fp ORDER BY price, id) AS cluster FROM y),
k AS (SELECT * FROM z QUALIFY fp IS NULL OR row_number() OVER (PARTITION BY part, fp, cluster ORDER BY id DESC) = 1)
SELECT id, CASE WHEN part = 'train' AND fp IN (SELECT fp FROM k WHERE part = 'test' AND fp IS NOT NULL) THEN 'purged' ELSE part END AS part, price FROM k""",
}
