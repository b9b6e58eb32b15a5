"""Tables that cut lineage, in the folder that every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when it ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables that were staged within each open scope.
_open: list[list[str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or below the warehouse, which is shared too, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def brief(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files; they are run once, so nothing reads these again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by the columns ``by``, and read it again."""
    path = folder(df.sparkSession, name)
    for paths in _open:
        paths.append(path)
    with brief(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder_ in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder_)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are staged inside are removed at the end, but for those whose path is taken out of the list.

    What is still to be read must be taken out, by ``keep``.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.remove(paths)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def keep(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    """Stage a table that outlives the scope."""
    out = stage(df, name)
    paths.pop()
    return out
