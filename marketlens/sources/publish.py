"""Several tables published as one version: a reader has all of a version or all of another, whenever a writer stops.

A version is a manifest with the folders, numbers of rows and content hashes of its tables. Files are written aside, then
the manifest is put in place by one rename that fails if another writer was first. The file system's rename of a file
must be atomic, as HDFS's and local ones are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Damaged(RuntimeError):
    """Files of a version are missing or aren't what its manifest says."""


@dataclass
class Version:
    number: int
    meta: dict
    tables: dict[str, DataFrame]
    manifest: dict


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a hash of them in any order, in one pass over files of any size."""
    names = [F.col(f"`{c}`") for c in df.columns]
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), *names)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(F.lit(2), *names).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r.n, f"{r.x}:{r.s}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    folder, fs = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(folder) if (m := re.fullmatch(r"(\d{12})\.json", s.getPath().getName())))


def _manifest(spark: SparkSession, root: str, number: int) -> dict:
    rows = spark.read.option("wholetext", True).text(f"{root}/versions/{number:012d}.json").collect()
    return json.loads(rows[0].value)


def _open(spark: SparkSession, manifest: dict) -> dict[str, DataFrame]:
    return {name: spark.read.schema(StructType.fromJson(t["schema"])).parquet(*t["paths"]) for name, t in manifest["tables"].items()}


def publish(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], append: dict[str, DataFrame] | None = None, meta: dict | None = None, keep: int = 3, step: Callable[[str], None] = lambda _: None
) -> int:
    """Publish a new version and return its number.

    ``tables`` replace those of the version before, ``append`` adds files to them, others are taken over as they are.
    Data that only versions before the last ``keep`` have is deleted afterwards; what a writer left that didn't come
    to its manifest stays, as it may still be at work. ``step`` is told of each step that is done.
    """
    numbers = _numbers(spark, root)
    before = _manifest(spark, root, numbers[-1]) if numbers else {"tables": {}}
    number = (numbers[-1] if numbers else 0) + 1
    entries = dict(before["tables"])
    aside = f"{root}/data/{uuid4().hex}"
    for name, df in [*tables.items(), *(append or {}).items()]:
        path = f"{aside}/{name}"
        df.write.parquet(path)
        step(f"written {name}")
        old = entries.get(name) if name in (append or {}) else None
        paths = [*(old["paths"] if old else []), path]
        schema = old["schema"] if old else df.schema.jsonValue()
        rows, sha = fingerprint(spark.read.schema(StructType.fromJson(schema)).parquet(path))
        parts = [*(old["parts"] if old else []), [rows, sha]]
        entries[name] = {"paths": paths, "schema": schema, "parts": parts}
    text = json.dumps({"version": number, "meta": meta or {}, "tables": entries})
    draft, fs = _fs(spark, f"{root}/versions/_{uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    step("drafted")
    place, _ = _fs(spark, f"{root}/versions/{number:012d}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(place), no_overwrite)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            fs.delete(draft, False)
            raise Conflict(f"version {number} of {root} is there already") from e
        raise
    step("published")
    _forget(spark, root, [*numbers, number], keep)
    return number


def _forget(spark: SparkSession, root: str, numbers: list[int], keep: int) -> None:
    """Delete versions before the last ``keep``, their manifests first, and the data that no other has."""
    old, new = numbers[:-keep], numbers[-keep:]
    if not old:
        return
    folders = lambda n: {p for t in _manifest(spark, root, n)["tables"].values() for p in t["paths"]}
    kept = set().union(*(folders(n) for n in new))
    gone = set().union(*(folders(n) for n in old)) - kept
    for n in old:
        path, fs = _fs(spark, f"{root}/versions/{n:012d}.json")
        fs.delete(path, False)
    for p in gone:
        path, fs = _fs(spark, p)
        fs.delete(path, True)


def read(spark: SparkSession, root: str, strict: bool = True) -> Version | None:
    """The newest version; None if nothing was published.

    The strict reader checks all files against the manifest and raises Damaged; the lenient one then takes the newest
    version that is whole, and None if there is none.
    """
    for number in reversed(_numbers(spark, root)):
        manifest = _manifest(spark, root, number)
        try:
            for name, t in manifest["tables"].items():
                for path, (rows, sha) in zip(t["paths"], t["parts"], strict=True):
                    found = fingerprint(spark.read.schema(StructType.fromJson(t["schema"])).parquet(path))
                    if found != (rows, sha):
                        raise Damaged(f"{name} of version {number}: {path} has {found[0]} rows, {rows} were published")
            return Version(number, manifest["meta"], _open(spark, manifest), manifest)
        except (AnalysisException, Damaged) as e:
            if strict:
                raise e if isinstance(e, Damaged) else Damaged(str(e)) from e
        except Exception as e:  # a file that can't be read
            if strict:
                raise Damaged(str(e)[:500]) from e
    return None


def newest(spark: SparkSession, root: str) -> Version | None:
    """The newest version without a check of its files, for the writer that made them."""
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    manifest = _manifest(spark, root, numbers[-1])
    return Version(numbers[-1], manifest["meta"], _open(spark, manifest), manifest)
