"""Repeated byte strings of a corpus and their removal, with enhanced suffix arrays.

Windows of ``length`` bytes are dealt out by their anchor: the 32-gram of least hash in them (the leftmost of equal
ones). Equal windows have equal anchors at equal places, so they meet. An anchor seen once has no repeated window; only
around the others are bytes moved, one row for each run of windows with one anchor.

Rows that meet are sorted into a suffix array (of the suffixes that hold a whole window) with the lengths of common
prefixes of neighbours. A scan with a stack walks the tree of common-prefix intervals; an interval whose suffixes are
preceded by different bytes, or begin a row, can't be extended to the left: it is a maximal repeat of its rows. Rows
with equal bytes are one row there, and a repeat's occurrences are those of all rows that it stands for.

An anchor of very many different rows is dealt out once more: its suffixes by their first window, as no interval holds
suffixes of different ones, and what is too large still by one byte more at a time, each such node of the tree being an
aggregation. So no task gets an unbounded group, and the repeats are the same.

``repeats`` joins those that go on from run to run in the same places, and gives each with all its occurrences;
``dedup`` removes all occurrences but the first. Copies of whole texts are met by their hash and searched once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm import _scratch, _text

GRAM = 32
#: Bits of a position within a text; the bits above tell texts of one id apart.
START_BITS = 36
#: Anchors that a task gathers before it sends them on.
GATHERED = 1_000_000
#: Different rows that a task gathers before it sends them on.
HELD_ROWS = 200_000
#: Rows of one anchor, or suffixes of one window, that go to one suffix array.
BUCKET_ROWS = 4_000
#: Suffixes that are sorted at once (whole buckets, so a bucket may exceed it).
SUFFIXES = 150_000
#: Ids of documents whose texts are wanted are broadcast up to this number (a hash each: 8 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: A row whose suffixes are all to be sorted has this in place of the byte before it.
WHOLE = -2
_SCAN = "key long, print long, off int, before int, doc_id long, at long, many boolean, bytes binary"


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, and the anchor's place; and all 32-gram hashes."""
    n = len(data)
    padded = np.zeros(n + 2 * GRAM, dtype=np.uint8)
    padded[:n] = data
    h = np.ndarray(n + GRAM, dtype="<u8", buffer=padded, strides=(1,)).copy()
    with np.errstate(over="ignore"):
        for step in (8, 16):
            h[: n + GRAM - step] = (h[: n + GRAM - step] ^ (h[: n + GRAM - step] >> np.uint64(31))) * np.uint64(_text.BASE) + h[step:] * np.uint64(_text.STEP)
    h = _text.mix(h[:n])
    # Least hash first, then leftmost: 38 bits of hash above 26 bits of place.
    bits = np.uint64(max(26, int(n).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        key[: n - width] = np.minimum(key[: n - width], key[width:])
        width *= 2
    if span > width:
        key[: n - span + width] = np.minimum(key[: n - span + width], key[span - width :])
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][row]
    anchor = (key[at] & low).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    return np.stack([at[begin], at[end], anchor[begin]]), h, row[begin]


def _all_anchors(docs: DataFrame, length: int) -> DataFrame:
    """hash, print (of the text), start and known (the task has seen it twice) of anchors.

    Of a hash that a task sees more than once, all places are known to be repeated, and one more row asks for it.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts, held = [], 0

        def send() -> pa.RecordBatch:
            h, fp, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, fp, start = h[order], fp[order], start[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = h[1:] != h[:-1]
            alone = first & np.append(first[1:], True)
            ask, known = np.flatnonzero(first), np.flatnonzero(~alone)
            take = np.concatenate([ask, known])
            flag = np.arange(len(take)) >= len(ask)
            return pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(fp[take]), pa.array(start[take]), pa.array(flag)], ["hash", "fp", "start", "known"])

        for part in _text.slices(batches, most=1 << 20):
            prints = part.column("fp").to_numpy()
            new = [i for i, x in enumerate(prints.tolist()) if x not in seen and not seen.add(x)]
            if len(seen) > GATHERED:
                seen.clear()
            part = part.take(pa.array(new, pa.int64()))
            if not part.num_rows:
                continue
            data, offsets = _text.column_bytes(part.column("text"))
            (_, _, anchor), h, row = _anchors(data, offsets, length)
            parts.append((h[anchor], part.column("fp").to_numpy()[row], (anchor - offsets[:-1][row]).astype(np.int32)))
            held += len(anchor)
            if held > GATHERED:
                yield send()
                parts, held = [], 0
        if held:
            yield send()

    return docs.select("text", "fp").mapInArrow(find, "hash long, fp long, start int, known boolean")


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """A row for each run of windows around a repeated anchor (``starts`` lists them), without bytes; and one with bytes
    for each different run that a task sees, with its smallest place there and whether it has more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "print", "doc_id", "at", "many", "bytes"]
        heads: dict[tuple[int, int], list] = {}

        def send() -> pa.RecordBatch:
            keys, rows = list(zip(*heads, strict=True)), list(zip(*heads.values(), strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (*keys, *rows[:2])), pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.binary())], names)

        for part in _text.slices(batches, most=1 << 20):
            data, offsets = _text.column_bytes(part.column("text"))
            (first, last, anchor), h, row = _anchors(data, offsets, length)
            starts = part.column("starts")
            flagged = np.repeat(offsets[:-1], np.diff(starts.offsets.to_numpy())) + starts.flatten().to_numpy()
            keep = np.isin(anchor, flagged)
            first, last, anchor, row = first[keep], last[keep], anchor[keep], row[keep]
            if not len(first):
                continue
            doc = part.column("doc_id").to_numpy()[row].astype(np.int64)
            at = (part.column("mark").to_numpy()[row] << START_BITS) | (first - offsets[:-1][row])
            end = last + length
            bucket, print_ = h[anchor].view(np.int64), _text.hashes(data, first, end, fold=False).view(np.int64)
            order = np.lexsort((at, doc, print_, bucket))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (print_[order][1:] != print_[order][:-1])
            raw = data.tobytes()
            several = (np.diff(np.append(np.flatnonzero(new), len(new))) > 1).tolist()
            for b, p, d, x, i, j, k in zip(*(v[order[new]].tolist() for v in (bucket, print_, doc, at, first, end)), several, strict=True):
                own = heads.get((b, p))
                if own is None:
                    heads[b, p] = [d, x, k, raw[i:j]]
                    continue
                own[2] = True
                if (d, x) < (own[0], own[1]):
                    own[:2] = d, x
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (bucket, print_, doc, at)), pa.nulls(len(doc), pa.bool_()), pa.nulls(len(doc), pa.binary())], names)
            if len(heads) > HELD_ROWS:
                yield send()
                heads.clear()
        if heads:
            yield send()

    return docs.mapInArrow(cut, "bucket long, print long, doc_id long, at long, many boolean, bytes binary")


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of a suffix array with these common prefixes of neighbours.

    ``lcp[i]`` is that of the suffixes i and i + 1. A scan with a stack, children before parents.
    """
    stack: list[list[int]] = []  # [common prefix, first]
    for i, x in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > x:
            depth, first = stack.pop()
            yield depth, first, i
        if x and (not stack or stack[-1][0] < x):
            stack.append([x, first])


def maximal_repeats(data: np.ndarray, place: np.ndarray, end: np.ndarray, before: np.ndarray, many: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(length, suffixes in order, first, last) of the maximal repeats of at least ``length`` bytes among some suffixes.

    A suffix is ``data[place:end]`` after the byte ``before`` (-1: none, which counts as not to be extended to the left);
    suffixes[first : last + 1] are the numbers of those that begin with the repeat. One that stands for ``many`` places is
    a repeat by itself, unless others begin with it.
    """
    if not len(place):
        return
    left = end - place
    width = int(left.max())
    # 1 is added to all bytes (UTF-8 has none over 0xF7), so that 0 ends a suffix.
    padded = np.zeros(len(data) + width, dtype=np.uint8)
    padded[: len(data)] = data + 1
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[place]
    table[np.arange(width)[None, :] >= left[:, None]] = 0
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    table, left, before = table[order], left[order], before[order]
    same = table[1:] == table[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    near = np.concatenate([[0], common, [0]])
    for i in np.flatnonzero(many[order] & (np.maximum(near[1:], near[:-1]) < left)).tolist():
        yield int(left[i]), order, i, i
    # Blocks of suffixes that share a window; those that all have one byte before them lie in longer repeats.
    cuts = np.flatnonzero(common < length) + 1
    begin, stop = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(place)]])
    changes = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
    heads = np.concatenate([[0], np.cumsum(before < 0)])
    several = np.flatnonzero((stop - begin > 1) & ((changes[stop - 1] > changes[begin]) | (heads[stop] > heads[begin])))
    for a, b in zip(begin[several].tolist(), stop[several].tolist(), strict=True):
        if b - a == 2:
            yield int(common[a]), order, a, a + 1
            continue
        for depth, x, y in intervals(common[a : b - 1].tolist()):
            if changes[a + y] > changes[a + x] or heads[a + y + 1] > heads[a + x]:
                yield depth, order, a + x, a + y


_FOUND = "repeat long, size long, print long, off int, first_doc long, first_at long"


def _scan(rows: DataFrame, length: int) -> DataFrame:
    """The maximal repeats among the rows of each key: repeat (a hash of its bytes), size, and each row (print, off) that
    has it, with the first occurrence of all (doc, at). Whole keys meet in a task, sorted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def resolve(table: pa.Table) -> pa.RecordBatch:
            key, print_, off = (table.column(c).to_numpy() for c in ("key", "print", "off"))
            new = np.ones(len(key), dtype=bool)  # the rows are sorted: the first of equal ones stays
            new[1:] = (key[1:] != key[:-1]) | (print_[1:] != print_[:-1]) | (off[1:] != off[:-1])
            several = np.add.reduceat(np.where(table.column("many").to_numpy(zero_copy_only=False), 2, 1), np.flatnonzero(new)) > 1
            table = table.filter(pa.array(new))
            print_, off, before, doc, at = (table.column(c).to_numpy() for c in ("print", "off", "before", "doc_id", "at"))
            data, offsets = _text.column_bytes(table.column("bytes"))
            whole = before == WHOLE
            each = np.where(whole, np.maximum(np.diff(offsets) - length + 1, 0), 1)
            row = np.repeat(np.arange(len(each)), each)
            step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            place = offsets[:-1][row] + step
            left = np.where(step > 0, data[np.maximum(place - 1, 0)].astype(np.int64), np.where(whole[row], -1, before[row]))
            sizes, members, begin = [], [], []
            for size, order, a, b in maximal_repeats(data, place, offsets[1:][row], left, several[row] & (left < 0), length):
                own = order[a : b + 1]
                sizes.append(size)
                members.append(own)
                begin.append(place[own[0]])
            if not sizes:
                return pa.RecordBatch.from_pylist([], pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in _FOUND.split(", ")]))
            node = np.repeat(np.arange(len(sizes)), [len(x) for x in members])
            own, sizes, begin = np.concatenate(members), np.array(sizes), np.array(begin)
            repeat = _text.hashes(data, begin, begin + sizes, fold=False).view(np.int64)
            row, off_ = row[own], (off[row[own]] + step[own])
            start = at[row] + off_
            by = np.lexsort((start, doc[row], node))
            head = by[np.searchsorted(node[by], np.arange(len(sizes)))]
            out = [repeat[node], sizes[node], print_[row], off_.astype(np.int32), doc[row[head]][node], start[head][node]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], [x.split()[0] for x in _FOUND.split(", ")])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = table.column("key").to_numpy()
            edges = np.flatnonzero(key[1:] != key[:-1]) + 1
            whole = table.column("before").to_numpy() == WHOLE
            sizes = pc.binary_length(table.column("bytes")).to_numpy()
            total = np.concatenate([[0], np.cumsum(np.where(whole, sizes - length + 1, 1))])
            at = 0
            while len(edges) and edges[-1] > at:  # the last key may go on in the next batch
                to = edges[max(0, np.searchsorted(total[edges], total[at] + SUFFIXES, side="right") - 1)]
                to = int(to if to > at else edges[np.searchsorted(edges, at, side="right")])
                yield resolve(table.slice(at, to - at))
                at = to
            rest = table.slice(at).combine_chunks()
        if rest is not None and rest.num_rows:
            yield resolve(rest)

    return rows.repartition("key").sortWithinPartitions("key", "print", "off", "doc_id", "at").mapInArrow(scan, _FOUND)


def _keyed(rows: DataFrame, depth: int, length: int) -> DataFrame:
    """Suffixes (of WHOLE rows: each with a whole window) by the hash of their first ``depth`` bytes, and the next byte (-1: none)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, "bytes", 1 << 18):
            data, offsets = _text.column_bytes(part.column("bytes"))
            before = part.column("before").to_numpy()
            whole = before == WHOLE
            each = np.where(whole, np.diff(offsets) - length + 1, np.diff(offsets) >= depth)
            row = np.repeat(np.arange(len(each)), each)
            step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            place, end = offsets[:-1][row] + step, offsets[1:][row]
            keys = _text.hashes(data, place, place + depth, fold=False).view(np.int64)
            left = np.where(step > 0, data[np.maximum(place - 1, 0)], np.where(whole[row], -1, before[row])).astype(np.int32)
            follow = np.where(place + depth < end, data[np.minimum(place + depth, max(len(data) - 1, 0))].astype(np.int32), -1).astype(np.int32)
            raw, taken = data.tobytes(), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    part.column("print").take(taken),
                    pa.array((part.column("off").to_numpy()[row] + step).astype(np.int32)),
                    pa.array(left),
                    part.column("doc_id").take(taken),
                    part.column("at").take(taken),
                    pa.array(part.column("many").to_numpy(zero_copy_only=False)[row] & (left < 0)),
                    pa.array([raw[a:b] for a, b in zip(place.tolist(), end.tolist(), strict=True)], pa.binary()),
                    pa.array(follow),
                ],
                ["key", "print", "off", "before", "doc_id", "at", "many", "bytes", "follow"],
            )

    columns = [x.split()[0] for x in _SCAN.split(", ")]
    return rows.select(*columns).mapInArrow(key, f"{_SCAN}, follow int")


def _split(rows: DataFrame, length: int) -> list[DataFrame]:
    """What ``_scan`` gives for WHOLE rows of anchors with very many of them, as several tables."""
    same = rows.groupBy("print").agg(F.first("bytes").alias("bytes"), F.min(F.struct("doc_id", "at")).alias("x"), (F.max("many") | (F.count("*") > 1)).alias("many"))
    rows = same.select(F.lit(0).cast("long").alias("key"), "print", F.lit(0).alias("off"), F.lit(WHOLE).alias("before"), "x.doc_id", "x.at", "many", "bytes")
    depth, out = length, []
    place = F.struct("doc_id", (F.col("at") + F.col("off")).alias("at"))
    while True:
        suffixes = _scratch.stage(_keyed(rows, depth, length), "suffixes")
        nodes = suffixes.groupBy("key").agg(
            F.count("*").alias("n"), F.min(place).alias("first"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("follow").alias("f0"), F.max("follow").alias("f1"), F.max("many").alias("more")
        )
        nodes = _scratch.stage(nodes.where("n > 1 or more"), "nodes")
        out.append(_scan(suffixes.join(nodes.where(F.col("n") <= BUCKET_ROWS), "key", "left_semi").drop("follow"), length))
        large = nodes.where(F.col("n") > BUCKET_ROWS)
        if not (count := large.count()):
            return out
        large = large.drop("more")
        within = _scratch.stage(suffixes.join(F.broadcast(large) if count <= BROADCAST_IDS // 10 else large, "key"), "within")
        node = within.where("(b0 <> b1 or b0 = -1) and (f0 <> f1 or f0 = -1)")
        out.append(node.select(F.col("key").alias("repeat"), F.lit(depth).cast("long").alias("size"), "print", "off", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at")))
        rows, depth = within.where("follow >= 0"), depth + 1


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may have these (doc_id, mark), if the ids are few enough to be sent to all tasks.

    It only spares a shuffle of other texts before the join on both columns, so one hash of them will do.
    """
    key = F.xxhash64("doc_id", "mark")
    few = ids.select(key.alias("_key")).distinct()
    return docs.withColumn("_key", key).join(F.broadcast(few), "_key", "left_semi").drop("_key") if ids.count() <= BROADCAST_IDS else docs


def _marks(signed: DataFrame) -> DataFrame:
    """doc_id, sha and mark of the texts of ids that have several: their numbers in the order of their SHA-256.

    An id may have very many; they are numbered within slices of hashes, and a slice starts where those before it end.
    """
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    texts = signed.join(several, "doc_id", "left_semi").select("doc_id", "sha").distinct().withColumn("slice", F.substring("sha", 1, 3))
    sizes = texts.groupBy("doc_id", "slice").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("doc_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 slices at most
    sizes = sizes.select("doc_id", "slice", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("doc_id", "slice").orderBy("sha")) - 1
    return texts.withColumn("number", number).join(sizes, ["doc_id", "slice"]).select("doc_id", "sha", (F.col("before") + F.col("number")).alias("mark"))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, mark and fp (of the text), and a stored table of their hashes and sizes.

    The mark tells the texts of an id apart; it is 0 where an id has one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = _text.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("fp", F.xxhash64("text"))
    sha = F.sha2("text", 256)
    signed = _scratch.stage(docs.select("doc_id", "fp", sha.alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "signed")
    marks = _scratch.stage(_marks(signed), "marks")
    if not (n := marks.count()):
        none = F.lit(0).cast("long").alias("mark")
        return docs.select("*", none), signed.select("*", none)
    if n <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    marked = lambda rows: rows.join(marks, ["doc_id", "sha"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    return marked(docs.withColumn("sha", sha)).drop("sha"), marked(signed)


def _first(signed: DataFrame, length: int) -> DataFrame:
    """Of equal texts that hold a window, the smallest id."""
    named = signed.where(f"doc_id is not null and n_bytes >= {length}")
    return named.groupBy("sha").agg(F.min("doc_id").alias("first"), F.first("mark").alias("mark"), F.first("fp").alias("fp"))


def _occurrences(docs: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """repeat, size, doc_id, at, first_doc and first_at: where the texts in ``first`` have maximal repeats of runs."""
    anchors = _scratch.stage(_all_anchors(docs.where(f"doc_id is not null and octet_length(text) >= {length}"), length), "anchors")
    asked = anchors.where("not known")
    # A task asks once for each hash, so a hash that many documents share has few rows here.
    repeated = asked.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("fp", "start")).alias("low"), F.max(F.struct("fp", "start")).alias("high")).where("n > 1 and low <> high").select("hash")
    flagged = asked.join(repeated, "hash").select("fp", "start").union(anchors.where("known").select("fp", "start"))
    starts = flagged.groupBy("fp").agg(F.collect_set("start").alias("starts"))
    wanted = _scratch.stage(first.select(F.col("first").alias("doc_id"), "mark", "fp").join(starts, "fp").select("doc_id", "mark", "starts"), "starts")
    _scratch.drop(anchors)

    around = _among(docs.select("doc_id", "mark", "text"), wanted.select("doc_id", "mark")).dropDuplicates(["doc_id", "mark"]).join(wanted, ["doc_id", "mark"])
    runs = _scratch.stage(_runs(around, length), "runs")
    heads = runs.where("bytes is not null")
    hot = _scratch.stage(heads.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select("bucket"), "hot")
    many = hot.count()
    if many <= BROADCAST_IDS // 10:
        hot = F.broadcast(hot)
    rows = heads.join(hot, "bucket", "left_anti") if many else heads
    found = [_scan(rows.select(F.col("bucket").alias("key"), "print", F.lit(0).alias("off"), F.lit(WHOLE).alias("before"), "doc_id", "at", "many", "bytes"), length)]
    if many:
        found += _split(heads.join(hot, "bucket"), length)
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    every = _scratch.stage(every, "found")
    places = runs.where("bytes is null").select("print", "doc_id", "at").join(every, "print")
    out = _scratch.stage(places.select("repeat", "size", "doc_id", (F.col("at") + F.col("off")).alias("at"), "first_doc", "first_at"), "occurrences")
    _scratch.drop(runs)
    return out


_START = (1 << START_BITS) - 1


def repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeat, kind, size, doc_id and start of every occurrence of every group of repeated strings.

    A group of kind ``part`` is a string of at least ``length`` bytes with all places in the corpus that have it; of the
    strings that have just these places, windows that follow each other make one group, however long. Nested groups (a
    longer string with fewer places) are groups of their own. A group of kind ``text`` is a whole text with the ids that
    have it. Null ids and texts take no part; repeated rows of one id and text are one document. See ``dedup``.
    """
    docs, signed = _signed(docs, id_col, text_col)
    first = _scratch.stage(_first(signed, length), "first")
    found = _occurrences(docs, first, length)
    mark, start = F.shiftright("at", START_BITS), F.col("at").bitwiseAND(_START)
    begin = F.col("first_at").bitwiseAND(_START)
    # Groups with the same places but for a shift: one number and two hashes of the places as seen from the first.
    of = lambda seed: F.bit_xor(F.xxhash64("doc_id", mark, start - begin, F.lit(seed)))
    sets = found.distinct().groupBy("repeat", "size", "first_doc", "first_at").agg(F.count("*").alias("n"), of(1).alias("s1"), of(2).alias("s2")).where("n > 1")
    same = Window.partitionBy("first_doc", F.shiftright("first_at", START_BITS), "n", "s1", "s2").orderBy(begin, "size")
    reach = F.max(begin + F.col("size")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    sets = sets.withColumn("new", F.coalesce(begin > reach - length + 1, F.lit(True)).cast("int")).withColumn("end", begin + F.col("size"))
    sets = sets.withColumn("chain", F.sum("new").over(same))
    by = ["first_doc", F.shiftright("first_at", START_BITS).alias("m"), "n", "s1", "s2", "chain"]
    groups = sets.groupBy(*by).agg(F.min_by(F.struct("repeat", "size"), begin).alias("head"), (F.max("end") - F.min(begin)).alias("long"))
    groups = groups.select("head.repeat", "head.size", "long")
    placed = found.select("repeat", "size", "doc_id", "at").distinct().join(groups, ["repeat", "size"]).select(F.xxhash64("repeat", "long").alias("repeat"), F.col("long").alias("size"), F.col("doc_id").alias("own"), mark.alias("mark"), start.alias("start"))
    # All copies of a text have what the one that was searched has.
    copies = signed.where(f"doc_id is not null and n_bytes >= {length}").select("sha", "doc_id", "n_bytes").distinct().join(first.select("sha", "first", "mark"), "sha")
    parts = placed.join(copies.select(F.col("first").alias("own"), "mark", "doc_id"), ["own", "mark"]).select("repeat", F.lit("part").alias("kind"), "size", "doc_id", "start")
    several = copies.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    whole = copies.join(several, "sha", "left_semi").select(F.xxhash64("sha").alias("repeat"), F.lit("text").alias("kind"), F.col("n_bytes").alias("size"), "doc_id", F.lit(0).cast("long").alias("start"))
    return parts.union(whole)


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Texts are UTF-8 bytes (null: empty). A byte goes if a string of ``length`` bytes over it starts earlier too: in a
    smaller id, or before in the same text; texts of one id are in the order of their SHA-256, and rows that repeat both
    id and text are one document. A row with a null id is compared with nothing and kept whole. Other columns are not
    read. ``length`` is at least 64.
    """
    docs, signed = _signed(docs, id_col, text_col)
    first = _scratch.stage(_first(signed, length), "first")
    found = _occurrences(docs, first, length)
    later = found.where("doc_id <> first_doc or at <> first_at")
    spans = later.groupBy("doc_id", F.shiftright("at", START_BITS).alias("mark")).agg(F.collect_set(F.struct(F.col("at").bitwiseAND(_START).alias("start"), "size")).alias("spans"))
    spans = _scratch.stage(spans, "spans")
    _scratch.drop(found)

    cut = _among(docs.select("doc_id", "mark", "text"), spans.select("doc_id", "mark")).dropDuplicates(["doc_id", "mark"]).join(spans, ["doc_id", "mark"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, most=1 << 20):
            data, offsets = _text.column_bytes(part.column("text"))
            spans = part.column("spans")
            inner = spans.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
            a = offsets[:-1][row] + inner.field("start").to_numpy()
            step = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(step, a, 1)
            np.add.at(step, a + inner.field("size").to_numpy(), -1)
            gone = np.cumsum(step[:-1]) > 0
            out = []
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = gone[x:y]
                out.append((int(own.sum()), int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()), hashlib.sha256(data[x:y][~own].tobytes()).hexdigest()))
            removed, count, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "mark", "removed", "n", "kept"])

    partly = cut.mapInArrow(remove, "doc_id long, mark long, removed long, n long, kept string")
    copy = F.col("first").isNotNull() & (F.col("first") != F.col("doc_id"))
    return (
        signed.join(first.select("sha", "first"), "sha", "left")
        .join(partly, ["doc_id", "mark"], "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )
