"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching: each task merges the trees of its pages into a wrapper a host, and
the tasks' wrappers are merged into one in rounds. A place of a wrapper whose texts come again on other pages of the
host is template, and so is a text that half of the host's pages have in one place; places whose texts vary are content.
Elements that say what they are (menus, footers, forms, scripts, comments, adverts) are left out by their names, which
is all there is to go by for what varies without being content and for hosts of one page. Where a page marks its
article, only that is taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marketlens.llm import _dom, _scratch, _text

#: Nodes of a wrapper; what doesn't fit begins another one.
NODES = 3000
#: Nodes of all wrappers that a task holds before it passes them on.
HELD = 150_000
#: Shapes of pages whose alignment a task remembers for a wrapper.
SHAPES = 500
#: Wrappers that a task merges in a round.
FAN_IN = 24
#: Rows of decisions that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 20_000

_SCHEMA = "wrapper long, host string, page_id {kind}, url string, lead long, slots array<int>, hashes array<long>, allowed array<boolean>, main array<boolean>, texts array<string>, tree string"


class _Host:
    """A wrapper that grows, and where the texts of each shape of page belong."""

    def __init__(self, number: int):
        self.number, self.tree, self.shapes, self.nodes = number, _dom.Node("#root"), {}, 0
        self.slots = count()

    def place(self, page: _dom.Page) -> list[int]:
        order = _dom.order(page.root)
        # Two trees of a shape have as many nodes in the same order; a folded text stands for any number of texts.
        leaves, todo = [], [page.root]
        while todo:
            x = todo.pop()
            if x.tag == "#":
                leaves.append(x)
            todo += x.kids
        slots = self.shapes.get(page.root.shape)
        if slots is None or len(slots) != len(leaves):
            place = _dom.merge(self.tree, page.root, lambda: next(self.slots))
            slots = [place[x.leaves[0]] for x in leaves]
            self.nodes = _dom.size(self.tree)
            if len(self.shapes) < SHAPES:
                self.shapes[page.root.shape] = slots
        out = [0] * len(order)
        for x, slot in zip(leaves, slots, strict=True):
            for n in x.leaves:
                out[n] = slot
        return out


def _align(pages: DataFrame) -> DataFrame:
    """A row a page with its texts and their places in the task's wrapper of the host, and a row a wrapper with its tree."""
    schema = _SCHEMA.format(kind=pages.schema["page_id"].dataType.simpleString())
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return pages.mapInArrow(lambda batches: _aligned(batches, fields, TaskContext.get().partitionId() << 32), schema)


def _aligned(batches: Iterator[pa.RecordBatch], fields: pa.Schema, first: int) -> Iterator[pa.RecordBatch]:
    numbers = count(first)
    hosts: dict[str, _Host] = {}

    def wrappers(some: list[tuple[str, _Host]]) -> pa.RecordBatch:
        rows = {"wrapper": [h.number for _, h in some], "host": [name for name, _ in some], "tree": [json.dumps(_dom.dump(h.tree), separators=(",", ":")) for _, h in some]}
        return pa.RecordBatch.from_arrays([pa.array(rows.get(f.name, [None] * len(some)), f.type) for f in fields], schema=fields)

    nodes = 0
    for part in _text.slices(batches, "html"):
        own, done = [], []
        slots: list[int] = []
        texts: list[str] = []
        allowed: list[bool] = []
        main: list[bool] = []
        longest: list[str] = []
        ends = [0]
        for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
            page = _dom.Page(html)
            h = hosts.get(host)
            if h is None:
                h = hosts[host] = _Host(next(numbers))
            before = h.nodes
            slots += h.place(page)
            nodes += h.nodes - before
            own.append(h.number)
            texts += page.texts
            allowed += page.allowed
            main += page.main
            longest.append(max(page.texts, key=len, default=""))
            ends.append(len(texts))
            if h.nodes > NODES:
                done.append((host, hosts.pop(host)))
                nodes -= h.nodes
        each = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        column = pa.array(texts, pa.string())
        rows = {
            "wrapper": pa.array(own),
            "lead": pa.array(_hashes(pa.array(longest, pa.string()))),
            "slots": each(pa.array(slots, pa.int32())),
            # Figures don't make another text.
            "hashes": each(pa.array(_hashes(pc.replace_substring_regex(column, "[0-9]+", "0")))),
            "allowed": each(pa.array(allowed, pa.bool_())),
            "main": each(pa.array(main, pa.bool_())),
            "texts": each(column),
            "tree": pa.nulls(part.num_rows, pa.string()),
        }
        yield pa.RecordBatch.from_arrays([rows[f.name] if f.name in rows else part.column(f.name) for f in fields], schema=fields)
        if nodes > HELD:
            done += hosts.items()
            hosts, nodes = {}, 0
        if done:
            yield wrappers(done)
    for at in range(0, len(hosts), 64):
        yield wrappers(list(hosts.items())[at : at + 64])


def _hashes(column: pa.Array) -> np.ndarray:
    data, offsets = _text.column_bytes(column)
    return _text.hashes(data, offsets[:-1], offsets[1:], fold=False).view(np.int64)


def _merged(wrappers: DataFrame) -> DataFrame:
    """wrapper, into and slots: the last wrapper that each wrapper was merged into, and where its places are there.

    ``wrappers`` has wrapper, host and tree. Each round merges groups of about FAN_IN wrappers of a host, so no task gets
    all wrappers of a host; the rounds end when every host has one, or when those left are too large to be merged.
    """
    now = wrappers.select("wrapper", "host", "tree")
    out = None

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["wrapper", "host", "tree"]).to_pylist(), key=lambda r: r["wrapper"])
        found: list[dict] = []
        into, host = None, rows[0]["host"]
        for r in rows:
            tree = _dom.load(json.loads(r["tree"]))
            if into is None or into.nodes > NODES:
                into = _Host(r["wrapper"])
                found.append({"wrapper": into.number, "host": host, "tree": into})
            place = _dom.merge(into.tree, tree, lambda into=into: next(into.slots))
            into.nodes = _dom.size(into.tree)
            found.append({"wrapper": r["wrapper"], "into": into.number, "slots": [place[i] for i in range(len(place))]})
        trees = [x | {"tree": json.dumps(_dom.dump(x["tree"].tree), separators=(",", ":"))} if "tree" in x else x for x in found]
        kinds = {"wrapper": pa.int64(), "host": pa.string(), "tree": pa.string(), "into": pa.int64(), "slots": pa.list_(pa.int32())}
        return pa.table({c: pa.array([x.get(c) for x in trees], t) for c, t in kinds.items()})

    many = now.count()
    while True:
        per = now.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).alias("groups"))
        grouped = now.join(per, "host").withColumn("g", F.pmod(F.xxhash64("wrapper"), F.col("groups")))
        step = _scratch.stage(grouped.groupBy("host", "g").applyInArrow(merge, "wrapper long, host string, tree string, into long, slots array<int>"), "wrappers")
        maps = step.where("tree is null").select("wrapper", "into", "slots")
        if out is None:
            out = maps
        else:
            through = F.transform(F.col("a.slots"), lambda x: F.get(F.col("b.slots"), x))
            out = _scratch.stage(out.alias("a").join(maps.alias("b"), F.col("a.into") == F.col("b.wrapper")).select("a.wrapper", "b.into", through.alias("slots")), "places")
        now = step.where("tree is not null").select("wrapper", "host", "tree")
        before, many = many, now.count()
        if many == before or not now.groupBy("host").count().where("count > 1").head(1):
            return out


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def host_of(url: Column) -> Column:
    """The host of an address in small letters, without user and port; the empty text if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, text, n_chars and n_template of every row: the article's blocks in page order, and how many
    texts were left out as the host's template.

    Evidence counts once for all pages of a host with one longest text, so copies of an article don't make it template.
    Outside of marked articles a place is template if half of its texts come on two pages or more; everywhere a text is
    template that at least half of the host's pages have in one place, 3 pages at least, 5 in a marked article. Null html
    and pages without text give the empty text; repeated rows give repeated rows; pages without a host are aligned with
    each other; other columns are not read. Each page lies in one task while it is read, other pages only as wrappers.
    """
    rows = _text.bounded(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    aligned = _scratch.stage(_align(rows), "aligned")
    page = aligned.where("tree is null").drop("tree")
    places = _sent(_scratch.stage(_merged(aligned.where("tree is not null")), "places"))

    # How often a text has a place on pages of different articles.
    put = page.select("wrapper", "lead", F.arrays_zip("slots", "hashes", "main").alias("z")).join(places, "wrapper")
    put = put.select("into", "lead", F.explode(F.transform("z", lambda z: F.struct(F.get(F.col("slots"), z["slots"]).alias("slot"), z["hashes"].alias("hash"), z["main"].alias("main")))).alias("x"))
    once = put.groupBy("into", "lead", "x.slot", "x.hash").agg(F.max("x.main").alias("main"))
    texts = _scratch.stage(once.groupBy("into", "slot", "hash").agg(F.count("*").alias("n"), F.max("main").alias("main")), "texts")
    articles = page.select("wrapper", "lead").join(places.select("wrapper", "into"), "wrapper").select("into", "lead").distinct().groupBy("into").agg(F.count("*").alias("pages"))
    slots = texts.groupBy("into", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("again"))
    fixed = slots.where("2 * again >= n and again > 0").groupBy("into").agg(F.collect_list("slot").alias("fixed"))
    often = texts.join(articles, "into").where(F.col("n") >= F.greatest(F.col("pages") / 2, F.when(F.col("main"), 5).otherwise(3)))
    often = often.groupBy("into").agg(F.collect_list(F.xxhash64("slot", "hash")).alias("often"))
    decided = articles.select("into").join(fixed, "into", "left").join(often, "into", "left")
    none = F.array()
    of = places.join(decided, "into", "left").select("wrapper", F.coalesce("fixed", none.cast("array<int>")).alias("fixed"), F.coalesce("often", none.cast("array<bigint>")).alias("often"), F.col("slots").alias("to"))
    of = _sent(_scratch.stage(of, "decided"))

    z = F.arrays_zip("slots", "hashes", "allowed", "main", "texts")
    judged = page.join(of, "wrapper").select(
        "page_id",
        "url",
        "host",
        F.transform(
            z,
            lambda x: F.struct(
                x["texts"].alias("text"),
                x["allowed"].alias("allowed"),
                x["main"].alias("main"),
                (F.array_contains("often", F.xxhash64(F.get(F.col("to"), x["slots"]), x["hashes"])) | (~x["main"] & F.array_contains("fixed", F.get(F.col("to"), x["slots"])))).alias("template"),
            ),
        ).alias("x"),
    )
    kept = F.filter("x", lambda x: x["allowed"] & ~x["template"])
    # A marked article of which nothing would be left is no template.
    kept = F.when((F.size(kept) == 0) & F.exists("x", lambda x: x["main"]), F.filter("x", lambda x: x["main"])).otherwise(kept)
    text = F.array_join(F.transform(kept, lambda x: x["text"]), " ")
    return judged.select("page_id", "url", "host", text.alias("text"), F.size(F.filter("x", lambda x: x["allowed"] & x["template"])).cast("long").alias("n_template")).withColumn("n_chars", F.length("text").cast("long"))
