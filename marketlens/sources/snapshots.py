"""Snapshots, histories and state files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "ts timestamp_ntz, model string, mape double, mae double, n long"


def read_json_lines(spark: SparkSession, path: str, schema: str = METRIC_SCHEMA) -> DataFrame | None:
    """Rows of a JSON-lines history; malformed lines are skipped; None (not an empty table) if there is no file."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return None


def read_snapshot(spark: SparkSession, path: str, schema: str, missing: str = "none", lines: bool = False) -> DataFrame | None:
    """A JSON snapshot, one document over all lines, or a row a line as ``write_snapshot`` has it (``lines``); without a
    file None, or no rows if ``missing`` is 'empty'.

    The two mean different things: None that nothing is known, no rows that there is nothing.
    """
    try:
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema) if missing == "empty" else None


def last_rows(rows: DataFrame, n: int, before: str | None = None, order: str = "ts") -> DataFrame:
    """The last n rows, of those before a moment."""
    if before:
        rows = rows.where(F.col(order) < F.lit(before).cast("timestamp_ntz"))
    return rows.orderBy(F.desc(order)).limit(n)


def append_metrics(rows: DataFrame, path: str, digits: int = 4) -> None:
    """Append metric rows, floats rounded."""
    names = [F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in rows.dtypes]
    rows.select(*names).write.mode("append").json(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """chat, item and state of a nested JSON map {chat: {item: {...}}}, one document a file; malformed files are empty."""
    files = spark.read.option("wholetext", "true").text(path)
    nested = F.from_json("value", "map<string,map<string,struct<since: string, price: bigint, deal: string>>>")
    outer = files.select(F.explode(nested).alias("chat", "items"))
    return outer.select("chat", F.explode("items").alias("item", "state")).select("chat", "item", "state.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of files, for verification after a transfer."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def drill(tables: dict[str, DataFrame], required: dict[str, str], now: str, hours: float) -> DataFrame:
    """One row a check: the table is there, has rows, and its newest moment isn't older than hours."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, moment in required.items():
        if name not in tables:
            row = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("rows"), F.lit(False).alias("ok"))
        else:
            limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(hours * 3600)} seconds")
            row = tables[name].agg(F.count("*").alias("rows"), F.max(moment).alias("last")).select(F.lit(name).alias("name"), "rows", (F.col("rows") > 0).__and__(F.coalesce(F.col("last") >= limit, F.lit(False))).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out
