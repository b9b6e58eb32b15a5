"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The corpus is read once: a posting (term, row, position) is stored for each corpus word that some benchmark item holds,
and one posting of the empty term at each text's end. Each benchmark window's terms are ranked by their number of
postings. The postings of its rarest term, less the term's offset, are its candidate starts; they are intersected with
the offset-adjusted postings of the next rarest, and the few that are left with those of all other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm import _scratch

#: Rows of (term, number) or of windows that are broadcast; with more, the join is by a shuffle.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in lower case (A-Z): maximal runs of digits, letters and non-ASCII characters."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """With a broadcast hint if it has few rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(window, terms) of the distinct windows of all items, and (item_id, window).

    An item of fewer words, but not none, is one window.
    """
    own = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = own.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, size).alias("terms")).distinct()
    distinct = _scratch.stage(each.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return distinct, _scratch.stage(each.join(distinct, "terms").select("item_id", "window"), "items")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (term, row, pos, doc_id) of the words in ``vocabulary`` (word, term), from one read.

    Each row of ``docs`` has a number of its own, so repeated or null ids do no harm. The posting of the empty word
    (term 0) is at the text's number of words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    tokens = rows.select("row", "doc_id", F.posexplode("w").alias("pos", "word"))
    return _scratch.stage(tokens.join(_bounded(vocabulary), "word").select("term", "row", "pos", "doc_id"), "postings")


def matches(index: DataFrame, distinct: DataFrame, vocabulary: DataFrame, slop: int = 0) -> DataFrame:
    """(row, start, size, window) of the windows' occurrences.

    With ``slop`` a proximity match: each term within so many words of its place in the phrase, as seen from the rarest.
    """
    frequency = _scratch.stage(index.where("term > 0").groupBy("term").agg(F.count("*").alias("df")), "frequency")
    terms = distinct.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "word")).join(vocabulary, "word")
    rank = F.row_number().over(Window.partitionBy("window").orderBy("df", "off"))
    ranked = terms.join(_bounded(frequency), "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", rank)
    # A window with a word that the corpus doesn't have can't occur.
    possible = F.min("df").over(Window.partitionBy("window")) > 0
    needs = _scratch.stage(ranked.withColumn("possible", possible).where("possible").select("window", "size", "off", "term", "rank"), "needs")

    def postings(some: DataFrame) -> DataFrame:
        """Those of the terms in ``some``."""
        return index.join(_bounded(some.select("term").distinct()), "term", "left_semi").select("term", "row", "pos")

    def places(found: DataFrame, some: DataFrame) -> DataFrame:
        """Where the terms of ``some`` have to be for the starts in ``found``."""
        placed = found.join(_bounded(some.drop("size")), "window").withColumn("pos", F.col("start") + F.col("off"))
        return placed.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop))) if slop else placed

    first, second, others = needs.where("rank = 1"), needs.where("rank = 2"), needs.where("rank > 2")
    found = index.select("term", "row", "pos").join(_bounded(first), "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0").select("row", "start", "size", "window").distinct()
    found = _scratch.stage(found, "starts")
    two = places(found, second).join(postings(second), ["term", "row", "pos"]).select("row", "start", "size", "window").distinct()
    two = _scratch.stage(two.union(found.where("size = 1")), "starts")
    rows = two.where("size > 2").select("row").distinct()
    rest = places(two.where("size > 2"), others).join(postings(others).join(_bounded(rows), "row", "left_semi"), ["term", "row", "pos"])
    full = rest.groupBy("row", "start", "size", "window").agg(F.count_distinct("off").alias("n")).where("n = size - 2").drop("n")
    return full.union(two.where("size <= 2"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    A word is hit that lies in an occurrence of any window. Null texts have no words; null items and items without
    words have no windows; rows that repeat an item's id add their windows to it. No windows or no rows give no hits.
    Other columns are not read.
    """
    distinct, items = windows(benchmark, size, item_col, item_text_col)
    spark = docs.sparkSession
    vocabulary = distinct.select(F.explode("terms").alias("word")).distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    end = spark.range(1).select(F.lit("").alias("word"), F.col("id").alias("term"))
    vocabulary = _scratch.stage(vocabulary.union(end), "vocabulary")
    index = build_index(docs, vocabulary, id_col, text_col)
    found = _scratch.stage(matches(index, distinct, vocabulary, slop), "matches")

    hit = found.select("row", "start", "size").distinct().select("row", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos")).distinct()
    hits = hit.groupBy("row").agg(F.count("*").alias("hits"))
    names = found.select("row", "window").distinct().join(_bounded(items), "window").select("row", "item_id").distinct()
    listed = names.groupBy("row").agg(F.count("*").alias("named"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("sha"))
    return (
        index.where("term = 0")
        .join(hits, "row", "left")
        .join(listed, "row", "left")
        .select(
            "doc_id",
            F.col("pos").cast("long").alias("n_words"),
            F.coalesce("hits", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("named", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.coalesce(F.col("hits") > 0, F.lit(False)).alias("contaminated"),
        )
    )


#: DuckDB: word positions of both sides; windows of 10 words, joined as strings.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (win)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN names USING (doc_id)
"""
