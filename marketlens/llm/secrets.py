"""Secret scans with a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger says which rules, by name and
version, have been run over which blob, and what they found. A run scans only the pairs of blob and rule version that
the ledger doesn't hold, each blob once, and joins the findings back to all paths with that content.

Base rules are assign, access and hex; the method adds ``pem`` (private key headers) and ``forge`` (prefixed access
tokens of code hosts).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import _scratch, _text

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: One of these is in every text that _ASSIGN matches.
_ASSIGN_CUES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more: [0-9a-f]+ takes each run whole
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")


def _assign(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(cue in low for cue in _ASSIGN_CUES):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []


def _hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]


def _pem(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PEM.finditer(text)] if "-----BEGIN" in text else []


def _forge(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _FORGE.finditer(text)]


#: kind -> (version, parser); a changed parser takes a new version, and so is run over all blobs again.
RULES: dict[str, tuple[int, Callable[[str], list[tuple[int, int]]]]] = {
    "assign": (1, _assign),
    "access": (1, _access),
    "hex": (1, _hex),
    "pem": (1, _pem),
    "forge": (1, _forge),
}
BASE_KINDS = ("assign", "access", "hex")

LEDGER_SCHEMA = "blob string, rules array<string>, findings array<struct<rule: string, start: int, stop: int>>"


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob and text of every version; null text is the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan_new(history: DataFrame, ledger: DataFrame | None = None, rules: dict | None = None) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that ``ledger`` doesn't hold.

    ``history`` has path, blob and text. The copies of a blob meet in a partial aggregation, so a blob that a large part
    of all paths share is sent once by each task.
    """
    rules = rules or RULES
    names = [f"{k}@{v}" for k, (v, _) in rules.items()]
    wanted = F.array(*map(F.lit, names))
    blobs = _text.bounded(history).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("rules", wanted)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen")
        blobs = blobs.where(F.size("rules") > 0)
    parsers = {f"{k}@{v}": f for k, (v, f) in rules.items()}
    spans = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches):
            found = [
                [{"rule": r, "start": a, "stop": b} for r in todo for a, b in parsers[r](text)]
                for text, todo in zip(part.column("text").to_pylist(), part.column("rules").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("rules"), pa.array(found, spans)], ["blob", "rules", "findings"])

    return blobs.select("blob", "text", "rules").mapInArrow(scan, LEDGER_SCHEMA)


def secrets(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: dict | None = None) -> DataFrame:
    """Findings of every path: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``ledger_path`` names the ledger's folder, which is read if it has files and is added to; without it a new ledger
    is begun in the shared folder. One row for each row of ``docs``, repeated ids included; null text is the empty text.
    Other columns are not read.
    """
    spark = docs.sparkSession
    rules = rules or RULES
    history = versions(docs, id_col, text_col)
    ledger = None
    if ledger_path is None:
        ledger_path = _scratch.folder(spark, "ledger")
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    scan_new(history, ledger, rules).write.mode("append").parquet(ledger_path)

    current = [f"{k}@{v}" for k, (v, _) in rules.items()]
    kinds = list(rules)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    # A blob has a row for each run that had something to scan; rules of other versions are left out.
    rank = F.array_position(F.array(*map(F.lit, current)), F.col("f.rule")).cast("int")
    found = (
        ledger.select("blob", F.explode("findings").alias("f"))
        .where(F.col("f.rule").isin(current))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("f.start").alias("start"), rank.alias("rank"), F.col("f.stop").alias("stop")))).alias("found"))
    )
    listed = F.array(*map(F.lit, kinds))

    def joined(which) -> Column:
        return F.array_join(F.transform(which, lambda x: F.concat_ws(":", F.element_at(listed, x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")

    none = F.array().cast("array<struct<start: int, rank: int, stop: int>>")
    every = F.coalesce("found", none)
    base = F.filter(every, lambda x: F.element_at(listed, x["rank"]).isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(every, lambda x: F.element_at(listed, x["rank"]) == kind)).cast("long").alias(f"n_{kind}")

    return (
        history.select("path", "blob")
        .join(found, "blob", "left")
        .select(F.col("path").alias("doc_id"), *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
    )
