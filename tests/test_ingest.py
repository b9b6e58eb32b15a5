"""Publishing as one version, and the ingest pass with a loss after each of its steps."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.scratch import folder
from marketlens.sources import publish
from marketlens.streaming import ingest


class Lost(RuntimeError):
    pass


def stop_at(k: int):
    """A hook that raises after the k-th step."""
    seen = []

    def step(name: str) -> None:
        seen.append(name)
        if len(seen) == k:
            raise Lost(name)

    return step


def rows(version: publish.Version | None) -> dict[str, list]:
    return {} if version is None else {k: sorted(map(tuple, v.collect()), key=repr) for k, v in version.tables.items()}


def test_a_reader_has_all_of_a_version(spark):
    root = folder(spark, "p")
    numbers = lambda a, b: spark.range(a, b)
    assert publish.read(spark, root) is None and publish.newest(spark, root) is None
    publish.publish(spark, root, {"a": numbers(0, 5), "b": numbers(0, 3)})
    old = rows(publish.read(spark, root))
    for k in range(1, 4):  # after a, after b, after the draft
        with pytest.raises(Lost):
            publish.publish(spark, root, {"a": numbers(0, 9), "b": numbers(5, 7)}, step=stop_at(k))
        assert rows(publish.read(spark, root)) == old
    with pytest.raises(Lost):  # in place, but not tidied up
        publish.publish(spark, root, {"a": numbers(0, 9)}, {"b": numbers(3, 4)}, step=stop_at(4))
    new = rows(publish.read(spark, root))
    assert len(new["a"]) == 9 and len(new["b"]) == 4
    reader = publish.read(spark, root)
    for k in range(3):  # a reader's version stays while two more come
        publish.publish(spark, root, {"a": numbers(k, k + 1)})
        if k < 2:
            assert rows(reader) == new
    assert publish._numbers(spark, root) == [3, 4, 5] and len(rows(publish.read(spark, root))["b"]) == 4


def test_two_writers(spark, monkeypatch):
    root = folder(spark, "p")
    publish.publish(spark, root, {"a": spark.range(1)})
    monkeypatch.setattr(publish, "_numbers", lambda *_: [])
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, {"a": spark.range(7)})
    monkeypatch.undo()
    assert publish.read(spark, root).tables["a"].count() == 1


def test_damaged_files(spark):
    root = folder(spark, "p")
    publish.publish(spark, root, {"a": spark.range(4)})
    publish.publish(spark, root, {"a": spark.range(9)})
    path = publish.newest(spark, root).manifest["tables"]["a"]["paths"][0]
    spark.range(8).write.mode("overwrite").parquet(path)
    with pytest.raises(publish.Damaged):
        publish.read(spark, root)
    assert publish.read(spark, root, strict=False).number == 1
    p, fs = publish._fs(spark, path)
    fs.delete(p, True)
    with pytest.raises(publish.Damaged):
        publish.read(spark, root)
    assert publish.read(spark, root, strict=False).tables["a"].count() == 4


def at(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, day, hour)


CARDS = "id long, price long, at timestamp_ntz, shard string, ok boolean"
#: Three passes; in the second a shard fails, in the third all are seen.
PASSES = [
    [(1, 10, at(1), "a", True), (2, 20, at(1), "b", True), (3, None, at(1, 1), "b", True), (4, 40, at(1), "a", True)],
    [(1, 10, at(6), "a", True), (2, 25, at(6), "b", True), (2, 24, at(6, 1), "b", True), (None, None, at(6), "b", False), (5, 50, at(6), "a", True)],
    [(1, None, at(12), "a", True), (3, 30, at(12), "b", True), (5, 50, at(12, 2), "a", True), (2, 24, at(11), "b", True)],
]


def store(spark, lose: int | None = None) -> dict[str, list]:
    root = folder(spark, "s")
    pages = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four")], "id long, title string")
    rules = ingest.Rules(details=1, days=3, most_gone=0.5, shards=("a", "b"))
    for k, cards in enumerate(PASSES):
        batch = spark.createDataFrame(cards, CARDS)
        if lose is not None:
            try:
                ingest.apply(root, batch, k, pages, rules, stop_at(lose))
            except Lost:
                pass
        ingest.apply(root, batch, k, pages, rules)
        assert ingest.apply(root, batch, k, pages, rules) is False
    return rows(publish.read(spark, root))


@pytest.fixture(scope="module")
def clean(spark):
    return store(spark)


def test_passes_by_hand(clean):
    assert clean["listings"] == [
        (1, 10, "one", at(1), at(12), 1, None, at(1, 1)),
        (2, 24, "two", at(1), at(11), 1, None, at(6, 1)),
        (3, 30, None, at(1, 1), at(12), 1, None, None),
        (4, 40, "four", at(1), at(1), 0, at(12, 2), at(12, 2)),
        (5, 50, None, at(6), at(12, 2), 1, None, None),
    ]
    assert clean["prices"] == [(1, 10, at(1), 0), (2, 20, at(1), 0), (2, 24, at(6, 1), 1), (3, 30, at(12), 2), (4, 40, at(1), 0), (5, 50, at(6), 1)]
    runs = [r[0:1] + r[3:] for r in clean["runs"]]
    assert runs == [(0, 4, 4, 0, 3, 1, 4, 0, 0, [], None), (1, 3, 1, 0, 2, 1, 5, 2, None, ["b"], "shards are missing"), (2, 4, 0, 0, 1, 1, 5, 1, 1, [], None)]


@pytest.mark.parametrize("step", range(1, 7))
def test_a_batch_that_runs_again_changes_nothing(spark, clean, step):
    """Lost after the start, after each table, after the draft and after the manifest is in place."""
    assert store(spark, step) == clean


def test_stream_equals_the_chain_of_batches(spark, clean):
    arrivals, root, state = (folder(spark, x) for x in ("in", "s", "c"))
    pages = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four")], "id long, title string")
    for cards in PASSES:
        spark.createDataFrame(cards, CARDS).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(spark.read.parquet(arrivals).schema).parquet(arrivals)
        ingest.ingest(stream, pages, ingest.Rules(1, 3, 0.5, ("a", "b")), root, state)
    assert rows(publish.read(spark, root)) == clean


def test_too_many_would_go(spark):
    listings = spark.createDataFrame([(i, 1, None, at(1), at(1), 1, None, at(1)) for i in range(5)], ingest.LISTINGS)
    batch = spark.createDataFrame([(0, 1, at(9), "a", True)], CARDS)
    pages = spark.createDataFrame([], "id long, title string")
    out = ingest.ingest_pass(listings, batch, pages, 7, ingest.Rules(shards=("a",)))
    assert out["runs"].first().blocked == "too many would go" and out["listings"].where("is_active = 0").count() == 0
    empty = ingest.ingest_pass(listings, batch.where("false"), pages, 8, ingest.Rules())
    assert empty["listings"].count() == 5 and empty["runs"].first().seen == 0
    assert empty["prices"].where(F.lit(True)).count() == 0
