"""Streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import tables as t
from marketlens.scratch import folder
from marketlens.sources import html, publish
from marketlens.streaming import events as e
from marketlens.streaming import ingest


def _events(s, d):
    return e.source(s, f"{d}/event[s].parquet")


def _twice(s, d):
    """The events, each of them sent twice."""
    rows = _events(s, d)
    return e.unique_events(rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy"))


#: Passes of eight days, shards, and the pages that a pass may read.
_PASSES, _SHARDS, _DETAILS = 4, ("0", "1", "2", "3"), 60


def _sightings(s, d):
    """The events as cards of search pages: a few listings of each user, now and then a page that failed."""
    rows = t.read(s, d, "events")
    return rows.select(
        (F.col("user_id") * 7 + F.col("event_id") % 7).alias("id"),
        F.when(F.col("event_type") != "error", (F.floor(F.col("value") / 20) * 2_000_000).cast("long")).alias("price"),
        F.col("ts").cast("timestamp_ntz").alias("at"),
        (F.col("user_id") % 4).cast("string").alias("shard"),
        (F.col("event_id") % 2503 != 0).alias("ok"),
        F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(_PASSES - 1)).alias("pass"),
    )


def _ingested(s, d):
    """What is known of each listing after all passes; each pass's sightings arrive when the one before is done."""
    arrivals, root, state = folder(s, "arrivals"), folder(s, "store"), folder(s, "state")
    rows = _sightings(s, d)
    pages = t.read(s, d, "pages").select(F.col("page_id").alias("id"), html.title(F.col("html")).alias("title"))
    rules = ingest.Rules(details=_DETAILS, days=3, most_gone=0.3, shards=_SHARDS)
    for k in range(_PASSES):
        rows.where(F.col("pass") == k).drop("pass").write.mode("append").parquet(arrivals)
        stream = s.readStream.schema(rows.drop("pass").schema).parquet(arrivals)
        ingest.ingest(stream, pages, rules, root, state)
    return publish.read(s, root).tables


def _stored(s, d):
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return _ingested(s, d)["listings"].select("id", "price", "title", at("first_seen"), at("last_seen"), "is_active", at("delisted_at"), at("detailed_at"))


def _passes_sql(last: str) -> str:
    """Each pass as tables of its own, the state after one being the start of the next."""
    out = ["""b AS MATERIALIZED (SELECT user_id * 7 + event_id % 7 AS id, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 20) * 2000000 AS BIGINT) END AS price, ts AS moment, user_id % 4 AS shard, event_id % 2503 <> 0 AS ok, least((day(ts) - 1) // 8, 3) AS p FROM events),
s0 AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS price, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS TIMESTAMP) AS first_seen, CAST(NULL AS TIMESTAMP) AS last_seen, 0 AS is_active, CAST(NULL AS TIMESTAMP) AS delisted_at, CAST(NULL AS TIMESTAMP) AS detailed_at WHERE FALSE),
t AS MATERIALIZED (SELECT page_id AS id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS page_title FROM pages)"""]
    for k in range(_PASSES):
        out.append(f"""n{k} AS MATERIALIZED (SELECT id, min(moment) AS f, max(moment) AS t, arg_max(price, (moment, price)) FILTER (price IS NOT NULL) AS sp FROM b WHERE p = {k} AND ok GROUP BY id),
w{k} AS (SELECT max(moment) AS now_ FROM b WHERE p = {k}), c{k} AS (SELECT count(*) = 4 AS whole FROM (SELECT shard FROM b WHERE p = {k} GROUP BY shard HAVING bool_and(ok))),
m{k} AS MATERIALIZED (SELECT coalesce(o.id, n.id) AS id, coalesce(n.sp, o.price) AS price, o.title, coalesce(o.first_seen, n.f) AS first_seen, coalesce(n.t, o.last_seen) AS last_seen, CASE WHEN n.id IS NOT NULL THEN 1 ELSE o.is_active END AS is_active, CASE WHEN n.id IS NULL THEN o.delisted_at END AS delisted_at, o.detailed_at,
  n.id IS NOT NULL AND n.sp IS NOT NULL AND o.price IS DISTINCT FROM n.sp AS changed, n.t AS t FROM s{k} o FULL JOIN n{k} n ON o.id = n.id),
q{k} AS MATERIALIZED (SELECT id FROM m{k} WHERE is_active = 1 AND detailed_at IS NULL AND id IN (SELECT id FROM t) ORDER BY first_seen, id LIMIT {_DETAILS}),
g{k} AS (SELECT whole AND count(*) FILTER (is_active = 1 AND last_seen < now_ - INTERVAL 3 DAY) <= 0.3e0 * count(*) FILTER (is_active = 1) AS go FROM m{k}, w{k}, c{k} GROUP BY whole),
s{k + 1} AS MATERIALIZED (SELECT m{k}.id, price, coalesce(CASE WHEN q{k}.id IS NOT NULL THEN page_title END, title) AS title, first_seen, last_seen, CASE WHEN go AND is_active = 1 AND last_seen < now_ - INTERVAL 3 DAY THEN 0 ELSE is_active END AS is_active,
  CASE WHEN go AND is_active = 1 AND last_seen < now_ - INTERVAL 3 DAY THEN now_ ELSE delisted_at END AS delisted_at, CASE WHEN q{k}.id IS NOT NULL THEN now_ ELSE detailed_at END AS detailed_at FROM m{k} LEFT JOIN q{k} ON q{k}.id = m{k}.id LEFT JOIN t ON t.id = m{k}.id, w{k}, g{k})""")
    return "WITH " + ",\n".join(out) + "\n" + last


QUERIES = {
    "stream_ingest": _stored,
    "stream_ingest_prices": lambda s, d: _ingested(s, d)["prices"].select("listing_id", "price", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_at"), "batch"),
    "stream_unique": lambda s, d: e.drain(_twice(s, d)).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids")),
    "stream_daily": lambda s, d: e.drain(e.windows(_events(s, d), "1 day", "event_type"), "complete"),
    "stream_weekly": lambda s, d: e.drain(e.windows(_events(s, d), "7 days"), "complete"),
    "stream_sessions": lambda s, d: e.drain(e.sessions(_events(s, d), "12 hours", "user_id"), "complete"),
    "stream_rate_limit": lambda s, d: e.drain(e.rate_limited(_events(s, d), "user_id", 2, 43_200)),
    "stream_gaps": lambda s, d: e.gaps(e.drain(e.slots(_events(s, d), 0.4), "complete"), 0.4),
}

ORACLES = {
    "stream_ingest": _passes_sql(f"SELECT id, price, title, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, is_active, epoch_us(delisted_at) AS delisted_at, epoch_us(detailed_at) AS detailed_at FROM s{_PASSES}"),
    "stream_ingest_prices": _passes_sql(" UNION ALL ".join(f"SELECT id AS listing_id, price, epoch_us(t) AS observed_at, CAST({k} AS BIGINT) AS batch FROM m{k} WHERE changed" for k in range(_PASSES))),
    "stream_unique": "SELECT event_type, count(*) AS n, count(*) AS ids FROM events GROUP BY 1",
    "stream_daily": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "stream_weekly": "SELECT CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS start, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g)
SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, i""",
    "stream_gaps": "WITH g AS (SELECT lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap_start, epoch_us(ts) AS gap_end FROM events) SELECT gap_start, gap_end FROM g WHERE gap_end - gap_start > 1440000000",
}
