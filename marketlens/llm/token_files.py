"""Token-ID output: whole texts as Parquet list columns, in id order, that can be read selectively.

The files hold one row a document: ``shard`` (the writing partition; shards are in id order), ``shard_start`` (ids of
earlier documents of the shard), ``n_tokens`` and ``ids``. The list column is dictionary-encoded (its indices take as
many bits as the vocabulary needs) or delta-encoded; row groups and pages are of given sizes, and Parquet's page index
lets a reader skip pages by ``doc_id`` or by the counts without touching ``ids``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm import _text, _tokens

#: Bytes of (stored) input for a file of ids where the number of files isn't given, and the most files then.
FILE_BYTES, MOST_FILES = 128 << 20, 1_000_000


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoding: str = "dictionary",
    row_group_mb: int = 32,
    page_kb: int = 256,
    page_rows: int = 2000,
    partitions: int | None = None,
) -> None:
    """Encode every whole text, ``end_id`` after each, and write the ids in ascending ``id_col`` order.

    Null text is the empty text (only the end id). Rows of one id are written one after another, by text; a null id
    comes first. Other columns of ``docs`` are not read. An empty table gives an empty set of files.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is 'dictionary' or 'delta', not {encoding!r}")
    spark = docs.sparkSession
    tokenizer = tokenizer or _tokens.default_path()
    if not partitions:
        size = int(str(docs.select(id_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // FILE_BYTES), MOST_FILES))
    n = partitions
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        for part in _text.slices(batches, most=5 << 20):
            ids, bounds = _tokens.encode(part.column("text"), tokenizer, end_id)
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.full(rows, shard, dtype=np.int32)),
                    pa.array(before + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))),
                ],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )
            before += int(bounds[-1])

    (
        _text.bounded(docs)
        .select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, f"doc_id {kind}, shard int, shard_start long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of each document; the list column is not read.

    ``start`` counts the ids of all documents before it. Only one sum a shard is gathered to number the shards.
    """
    rows = spark.read.parquet(path).select("doc_id", "shard", "shard_start", "n_tokens")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    begin = sums.select("shard", (F.sum("_ids").over(Window.orderBy("shard")) - F.col("_ids")).alias("_begin"))
    return rows.join(F.broadcast(begin), "shard").select("doc_id", (F.col("_begin") + F.col("shard_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document, of those that fulfil ``where`` (pushed down to the pages)."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_ids"))
    begin = sums.select("shard", (F.sum("_ids").over(Window.orderBy("shard")) - F.col("_ids")).alias("_begin"))
    rows = rows.where(where) if where else rows
    return rows.join(F.broadcast(begin), "shard").select("doc_id", (F.col("_begin") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    others = [c for c in tokens.columns if c != "ids"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(crc, pa.int64())], [*others, "ids_crc32"])

    schema = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in others)
    return tokens.mapInArrow(sums, f"{schema}, ids_crc32 long")
