"""The market's entities as views over the supplied tables, in Spark and in the SQL of the twins.

Each view is one select list that both engines read; only casts to text and date steps differ. The supplied tables hold
no listings, so attributes that they lack are made from the key by arithmetic, with gaps where a listing has gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The moment that stands for now, just after the newest row.
NOW = "2001-08-02 00:00:00"


def _list(columns: dict[str, str], duck: bool) -> str:
    out = []
    for name, text in columns.items():
        text = text.replace("<text>", "VARCHAR" if duck else "STRING")
        while "@days(" in text:
            at = text.index("@days(")
            depth, end = 0, at + 5
            for end in range(at + 5, len(text)):
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                if not depth:
                    break
            when, n = text[at + 6 : end].split(";")
            step = f"({when} + to_days(CAST({n} AS INTEGER)))" if duck else f"({when} + make_dt_interval(CAST({n} AS INT)))"
            text = text[:at] + step + text[end + 1 :]
        out.append(f"{text} AS {name}")
    return ",\n  ".join(out)


LISTING = {
    "id": "o_orderkey",
    "price": "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) * 100 END",
    "area": "CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE CAST(20 + o_orderkey * 7 % 110 AS DOUBLE) END",
    "rooms": "CAST(1 + o_orderkey % 6 AS INT)",
    "floor": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(1 + o_orderkey * 3 % 12 AS INT) END",
    "total_floors": "CAST(3 + o_orderkey * 5 % 14 AS INT)",
    "year_built": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(1955 + o_orderkey * 11 % 72 AS INT) END",
    "ceiling": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(24 + o_orderkey % 9 AS DOUBLE) / 10 END",
    "district": "CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE n_name END",
    "microdistrict": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(n_name, '-', CAST(o_orderkey % 5 AS <text>)) END",
    "category": "CASE o_orderkey % 3 WHEN 0 THEN 'novostroiki' WHEN 1 THEN 'vtorichka' END",
    "building_type": "CASE o_orderkey % 4 WHEN 0 THEN 'panel' WHEN 1 THEN 'brick' WHEN 2 THEN ' Monolith  House' END",
    "user_type": "c_mktsegment",
    "complex_name": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE c_name END",
    "lat": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 43.1e0 + CAST(o_orderkey * 37 % 3000 AS DOUBLE) / 10000 END",
    "lon": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 76.7e0 + CAST(o_orderkey * 91 % 5000 AS DOUBLE) / 10000 END",
    "first_seen": "o_orderdate",
    "last_seen": "@days(o_orderdate; o_orderkey % 120)",
    "is_active": "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END",
    "delisted_at": "CASE WHEN o_orderstatus = 'F' THEN @days(o_orderdate; o_orderkey % 120 + o_orderkey % 11) END",
    "source": "CASE WHEN o_orderkey % 29 = 0 THEN 'user' ELSE 'scrape' END",
    "first_seen_cohort": "CASE WHEN o_orderkey % 13 = 0 THEN 'initial' WHEN o_orderkey % 23 = 0 THEN 'gap:2000-01-01' END",
    "deal": "CASE WHEN o_orderpriority = '5-LOW' THEN 'rent' ELSE 'sale' END",
    "photos_count": "CAST(o_orderkey % 21 AS INT)",
    "title": "CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE concat('flat ', CAST(o_orderkey AS <text>)) END",
    "raw_params": """CASE WHEN o_orderkey % 41 = 0 THEN '{broken' WHEN o_orderkey % 43 = 0 THEN NULL ELSE concat('{"flat.toilet": "', CASE WHEN o_orderkey % 2 = 0 THEN 'Joint ' ELSE '' END, '", "flat.wc": "two", "map.complex": "', c_name, '", "flat.security": "lock, video, alarm", "balcony": "', CAST(o_orderkey % 3 AS <text>), '"}') END""",
}
HISTORY = {
    "listing_id": "l_orderkey",
    "price": "CAST(floor(l_extendedprice / 5000) AS BIGINT) * 500000",
    "observed_at": "l_shipdate",
    "seq": "l_linenumber * 1000000 + l_partkey",
}
PREDICTION = {
    "listing_id": "l_orderkey",
    "predicted_at": "l_shipdate",
    "fair_price": "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) * 100 END",
    "fair_low": "CAST(floor(l_extendedprice * 0.9e0) AS BIGINT) * 100",
    "fair_high": "CAST(floor(l_extendedprice * 1.1e0) AS BIGINT) * 100",
    "seq": "l_linenumber * 1000000 + l_partkey",
}
RUN = {
    "run_id": "event_id",
    "started_at": "ts",
    "deal": "CASE WHEN user_id % 3 = 0 THEN 'rent' WHEN user_id % 3 = 1 THEN 'sale' END",
    "shard": "concat(event_type, ' ', CAST(user_id % 4 + 1 AS <text>))",
    "stock": "CAST(floor(value * 100) AS BIGINT)",
    "found": "CAST(floor(value * 80) AS BIGINT)",
    "quota": "CASE WHEN value < 5 THEN 0 ELSE CAST(floor(value) AS BIGINT) END",
    "backlog": "CAST(floor(value * 100) AS BIGINT)",
    "search_seconds": "value * 60",
    "requests": "CAST(1 + user_id % 40 AS BIGINT)",
    "banned": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
}

_FROM = {
    "listing": (LISTING, "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "history": (HISTORY, "lineitem"),
    "prediction": (PREDICTION, "lineitem"),
    "run": (RUN, "events"),
}


def sql(*views: str) -> str:
    """The WITH clause of a twin, without the last comma."""
    return "WITH " + ",\n".join(f"{v} AS (SELECT {_list(_FROM[v][0], True)}\n  FROM {_FROM[v][1]})" for v in views)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _view(df: DataFrame, view: str) -> DataFrame:
    return df.selectExpr(*_list(_FROM[view][0], False).split(",\n  "))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # nation has 25 rows by definition
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation.hint("broadcast"), customer.c_nationkey == nation.n_nationkey)
    return _view(joined, "listing")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(read(spark, sf_dir, "lineitem"), "history")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(read(spark, sf_dir, "lineitem"), "prediction")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(read(spark, sf_dir, "events"), "run")
