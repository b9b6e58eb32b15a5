"""From raw documents to packed training sequences, in stages that each work on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet and reads it for the next.
All but the last return the columns of ``documents``. Decisions are made by row, not by id: near copies and contaminated
texts are joined back by a stored number of each row, secrets by the SHA-256 of the text, so rows with a null or a
repeated id are treated like others; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import _scratch, _text, decontaminate, jaccard_join, language_id, packing, secrets

#: What stands for a secret in the texts.
MASK = "[REDACTED]"

#: No SQL can express the stages' models and tokenizer.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects: no letters, or unlike every language that it knows."""
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = language_id.learn(docs, train)
    labelled = language_id.predict(docs, model, keep=tuple(docs.columns))
    kept = labelled.where("not rejected")
    return kept.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


def _own(docs: DataFrame, name: str) -> str:
    """A name for a stage's own column that no column of its input has, in any spelling."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, stored, so that every later read has the same numbers; and its column."""
    row = _own(docs, "_row")
    return _scratch.stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (null last, then the first row)."""
    rows, row = _numbered(docs)
    with _scratch.scope(spark) as made:  # of the operator's tables only what it found stays
        linked = jaccard_join.jaccard_join(rows.select(row, "text"), id_col=row).where("component_id <> doc_id")
        members = _scratch.keep(linked.select("component_id", F.explode(F.array("doc_id", "component_id")).alias("member")).distinct(), "members", made)
    ids = rows.select(F.col(row).alias("member"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "member"))["member"]
    stay = members.join(ids, "member").groupBy("component_id").agg(first.alias("member")).select("member")
    gone = members.join(stay, "member", "left_anti").select(F.col("member").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row = _numbered(docs)
    with _scratch.scope(spark) as made:
        found = decontaminate.decontaminate(rows.select(row, "text"), benchmark, id_col=row).where("contaminated").select(F.col("doc_id").alias(row))
        gone = _scratch.keep(found, "gone", made)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def mask(text: str, spans: str) -> str:
    """The text with MASK for each stretch of overlapping spans (kind:start:end, comma-joined, by start)."""
    out, at = [], 0
    for x in spans.split(","):
        _, a, b = x.split(":")
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of each secret; n_chars is that of the new text."""
    key, spans = _own(docs, "_sha"), _own(docs, "_spans")
    keyed = _text.bounded(docs).withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    # Rows of one key have one text, and so the same spans.
    with _scratch.scope(spark) as made:
        found = secrets.secrets(keyed.select(key, "text"), id_col=key).where("spans <> ''").select(F.col("doc_id").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
        found = _scratch.keep(found, "found", made)
    marked = keyed.join(found, key, "left")
    names = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches):
            columns = {c: part.column(c) for c in names}
            rows = [(t if s is None else mask(t, s), s is not None) for t, s in zip(columns["text"].to_pylist(), part.column(spans).to_pylist(), strict=True)]
            columns["text"] = pa.array([t for t, _ in rows], pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if new else n for (t, new), n in zip(rows, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return marked.mapInArrow(redact, docs.schema)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 4096."""
    return packing.pack(packing.cut(docs))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, _scratch.stage(stage(spark, docs, sf_dir), name)
        if i:
            _scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
