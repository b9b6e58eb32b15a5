"""The pipeline's stages, each against what its operator finds."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.common import frame

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "secrets", "packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names and 0.8 * before < docs.count() <= before
        before = docs.count()
    assert docs.where("text like '%[REDACTED]%'").count() > 0
    assert docs.where("length(text) <> n_chars").count() <= spark.read.parquet(f"{SF}/documents.parquet").where("length(text) <> n_chars").count()
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_mask():
    assert corpus_pipeline.mask("ab secret cd", "x:3:9") == "ab [REDACTED] cd"
    assert corpus_pipeline.mask("abcdef", "x:0:3,y:2:4,z:5:6") == "[REDACTED]e[REDACTED]"


def test_empty(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_rows_with_null_and_repeated_ids(spark):
    secret = lambda n: f"{'x ' * n}token = abcdef{n}23456 end"
    rows = [(1, secret(3), "en", "s", 0), (1, secret(9), "en", "s", 0), (None, secret(5), "en", "s", 0), (None, "plain text", "en", "s", 0)]
    out = [r.text for r in corpus_pipeline.redact_secrets(spark, frame(spark, rows), SF).collect()]
    assert sum("[REDACTED]" in t for t in out) == 3 and not any("abcdef" in t for t in out) and "plain text" in out
    assert all(t.endswith(" end") for t in out if "[REDACTED]" in t)

    copy, other = "one two three four five six seven eight", "quite another text of a good many words here"
    rows = [(None, copy, "en", "a", 0), (None, copy, "en", "b", 0), (7, copy, "en", "c", 0), (7, other, "en", "d", 0), (3, copy, "en", "e", 0), (None, other + " and its end", "en", "f", 0), (None, None, "en", "g", 0), (None, None, "en", "h", 0)]
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), SF).collect()
    assert sorted(r.source for r in out) == ["d", "e", "f", "g", "h"]

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null and size(split(text, ' ')) > 12").first().text
    rows = [(1, item, "en", "a", 0), (1, other, "en", "b", 0), (None, item, "en", "c", 0), (None, copy, "en", "d", 0)]
    out = corpus_pipeline.drop_contaminated(spark, frame(spark, rows), SF).collect()
    assert sorted(r.source for r in out) == ["b", "d"]


def test_extra_columns_pass_unchanged(spark):
    """Columns with the names that stages and operators use inside come out of every stage as they went in."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    extra = ("spans", "_row", "_ROW_", "_key", "_sha", "_spans", "component_id", "blob", "row", "key", "member", "kept_text", "h", "hash")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in extra}).withColumn("n_extra", F.col("doc_id") * 2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[-len(extra) - 1 :] == [*extra, "n_extra"] and docs.count() > 50, name
        wrong = " or ".join(f"`{c}` <> concat('{c} ', doc_id)" for c in extra)
        assert docs.where(f"{wrong} or n_extra <> doc_id * 2").count() == 0, name
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0
