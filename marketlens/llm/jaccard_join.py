"""Near-duplicate documents: a set-similarity join on word shingles with adaptive multi-match prefixes.

The shingles of all documents are put in one order, rare ones first; how common each is comes from a count sketch over
all documents. Two sets of Jaccard similarity t or more share at least l of the first ``n - ceil(t * n) + l`` shingles
of each, for any l. Each document takes the l, and so the prefix, for which prefix and expected candidates cost least;
a pair is a candidate if its prefixes share min(l, l') shingles and enough for the overlap that t asks for.

Groups of copies are never paired out. Rows with equal sets are one class from the start. Pairs with one hub for each
shared shingle and size band come first; after the components of those links, only pairs from different components are
formed, and where these are many, first those with a few hubs, then with eight times as many, and so on. A row that
links with a share of its group has joined it before it meets many of them, so a large group of near copies finds a few
links a member and round, and not the square of its size. The last round forms all pairs of components that are still
different. No link between different components is lost, so the components are exact.

A shingle may be in a third of all prefixes. No window holds all rows of one: those that the sketch finds common are
dealt out by the set's print, hubs are aggregates that are joined back, and of a shingle's largest component the rows
are never paired with each other. The joins read stored tables, so that adaptive execution can split a heavy key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm import _graph, _scratch, _sums, _text

#: The sketch has 2**SKETCH_BITS counters, in chunks of CHUNK.
SKETCH_BITS, CHUNK = 18, 1 << 12
#: Prefix extensions that are weighed.
MOST_MATCHES = 4
#: Ids of documents to verify are broadcast up to this number (8 bytes each), and joined by a shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: Rows of one shingle that are put in order together; a shingle that more documents share is dealt out.
SPLIT = 100_000
#: Hubs of a token and band that the rows of other components meet in the second step, and how many times more a round.
HUBS, MORE_HUBS = 4, 8
#: All pairs that are left are formed at once if they are fewer than these, or than the rows that form them.
FEW_PAIRS = 10_000


def _sets(part: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    data, offsets = _text.column_bytes(part.column("text"))
    starts, ends, first = _text.words(data, offsets)
    hashed, begin = _text.shingles(_text.hashes(data, starts, ends), first, words)
    row = np.repeat(np.arange(part.num_rows), np.diff(begin))
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    new = np.ones(len(hashed), dtype=bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    hashed, row = hashed[new], row[new]
    return np.split(hashed, np.searchsorted(row, np.arange(1, part.num_rows))) if part.num_rows else []


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """A row a document with its set's size and 128-bit print, and each task's part of the sketch, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slots = 1 << SKETCH_BITS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, names = np.zeros(slots, dtype=np.int64), ["doc_id", "n", "fp", "fp2", "chunk", "counts"]
        for part in _text.slices(batches):
            sets = _sets(part, words)
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            prints = np.zeros((2, len(sets)), dtype=np.uint64)
            flat = np.concatenate(sets)
            if len(flat):
                sketch += np.bincount(flat & np.uint64(slots - 1), minlength=slots)
                full = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[full]
                prints[0, full] = np.add.reduceat(_text.mix(flat), begin)
                prints[1, full] = np.bitwise_xor.reduceat(_text.mix(flat ^ np.uint64(_text.STEP)), begin)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *(pa.array(p.view(np.int64)) for p in prints), none.cast(pa.int32()), none.cast(pa.binary())], names)
        chunks = slots // CHUNK
        none = pa.nulls(chunks)
        kinds = part.column("doc_id").type if sketch.any() else pa.int64()
        if sketch.any():
            yield pa.RecordBatch.from_arrays([none.cast(kinds), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(np.arange(chunks, dtype=np.int32)), pa.array([x.tobytes() for x in sketch.reshape(chunks, CHUNK)])], names)

    return docs.mapInArrow(sign, f"doc_id {kind}, n long, fp long, fp2 long, chunk int, counts binary")


def _sketch(signed: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters: 2**SKETCH_BITS numbers, whatever the input's size."""
    chunks = _sums.sum_arrays(signed.where("chunk is not null").select(F.col("chunk").alias("part"), "counts"), "int64")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for chunk, counts in chunks.items():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = counts
    return out


def _least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _prefixes(docs: DataFrame, sketch: np.ndarray, words: int, percent: int) -> DataFrame:
    """token, doc_id, n, l, place, fp, deal for each shingle of each document's prefix; place counts from 0.

    ``deal`` is 0, but for shingles that share a counter with a common one: for these it is one of 1, 2, ... by the
    set's print, so that about SPLIT documents have the same.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)  # 2 MB
    kind = docs.schema["doc_id"].dataType.simpleString()
    slots, split = 1 << SKETCH_BITS, SPLIT

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        usual = float(np.median(common))
        # What a counter holds beyond the usual load and its scatter is taken for the documents that share the shingle.
        excess = np.maximum(common - usual - 4 * np.sqrt(usual + 1), 0)
        deals = np.where(excess > split, np.ceil(excess / split), 0).astype(np.uint64)
        for part in _text.slices(batches):
            sets = _sets(part, words)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            prints = _text.mix(flat)
            keep_token, keep_row, size, match, fp = [], [], [], [], []
            at = 0
            for i, own in enumerate(sets):
                n = len(own)
                if not n:
                    continue
                slot = own & np.uint64(slots - 1)
                order = np.lexsort((own, common[slot]))
                cost, best, least = np.inf, 1, int(_least(n, percent))
                longest = min(n, n - least + MOST_MATCHES)
                shared_with = excess[slot[order[:longest]]]
                sums = np.cumsum(shared_with)
                for m in range(1, min(MOST_MATCHES, least) + 1):
                    p = n - least + m
                    # The order is ascending, so the most shared shingles of the prefix are its last ones.
                    expected = sums[p - m] / m if p > m else 0.0
                    if p + expected < cost:
                        cost, best = p + expected, m
                p = n - least + best
                keep_token.append(own[order[:p]])
                keep_row.append(i)
                size.append(p)
                match.append(best)
                fp.append(int(np.add.reduce(prints[at : at + n]).view(np.int64)))
                at += n
            if not keep_row:
                continue
            repeat = np.repeat(np.arange(len(keep_row)), size)
            rows = np.array(keep_row)
            counts = np.array([len(sets[i]) for i in keep_row])
            tokens, prints = np.concatenate(keep_token), np.array(fp)[repeat]
            ways = deals[tokens & np.uint64(slots - 1)]
            deal = np.where(ways > 0, _text.mix(prints.view(np.uint64)) % np.maximum(ways, np.uint64(1)) + np.uint64(1), np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), part.column("doc_id").take(pa.array(rows[repeat])), pa.array(counts[repeat].astype(np.int32)), pa.array(np.array(match, dtype=np.int32)[repeat]), pa.array(np.concatenate([np.arange(p, dtype=np.int32) for p in size])), pa.array(prints), pa.array(deal.astype(np.int32))],
                ["token", "doc_id", "n", "l", "place", "fp", "deal"],
            )

    return docs.mapInArrow(prefix, f"token long, doc_id {kind}, n int, l int, place int, fp long, deal int")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity: u, v. Only the texts of their documents are moved."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if (count := ids.count()) <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    if not count:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    texts = _scratch.stage(docs.join(ids, "doc_id", "left_semi"), "texts")
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches, most=2 << 20):
            right = _sets(part, words)
            left = _sets(part.drop_columns("text").rename_columns(["a", "text", "b"]), words)
            inter = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)])
            total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)])
            ok = pa.array((100 * inter >= percent * (total - inter)) & (total > 0))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["u", "v"])

    return both.select("a", "text_a", "b", "text").mapInArrow(verify, f"u {kind}, v {kind}").distinct()


#: Columns of a row that says that a and b share a token of their prefixes.
_SIDE = ("doc_id", "n", "l", "place", "top")


def _side(x: str, of: str = "") -> list[Column]:
    return [F.col(f"{of}{c}").alias(x if c == "doc_id" else f"{c}_{x}") for c in _SIDE]


def _candidates(rows: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, whose sets can still have the overlap, from rows of shared tokens, one a token and pair.

    Of sets with that overlap o, the k-th token that they share has at least o - k + 1 tokens from it on in both. So of
    the first m shared ones none comes later than a place where o - m + 1 tokens are left, and m = min(l, l') of them
    have to be there. Then all tokens that the two prefixes share are counted: with what follows a prefix they must
    make up the overlap.
    """
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    m = F.least("l_a", "l_b")
    near = rows.where(F.least("top_a", "top_b") >= need).where(left + m - 1 >= need)
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("c"), F.first(m).alias("m")).where("c >= m").select("a", "b")
    for x in "ab":
        pairs = pairs.join(lists.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("tokens", "n", "l"))), x)
    after = F.greatest(*(F.ceil(F.col(f"n_{x}") * percent / 100) - F.col(f"l_{x}") for x in "ab"))
    return pairs.where(F.size(F.array_intersect("tokens_a", "tokens_b")) + after >= need).select("a", "b")


def _few(sizes: DataFrame, hubs: int) -> bool:
    """Whether the rows that are left (counts of token, band, main) make about as few pairs as rows, or as with ``hubs``."""
    of = sizes.groupBy("token", "band").agg(*(F.coalesce(F.sum(F.when(F.col("main") == x, F.col("many"))), F.lit(0)).alias(name) for x, name in ((True, "inside"), (False, "outside"))))
    pairs = F.sum(F.col("outside") * (F.col("inside") + F.col("outside") / 2))
    now = of.agg(F.sum(F.col("inside") + F.col("outside")).alias("rows"), pairs.alias("pairs"), F.max(F.greatest("inside", "outside")).alias("most")).first()
    return now.rows is None or now.most <= hubs or now.pairs <= max(now.rows, FEW_PAIRS)


def _crossing(placed: DataFrame, sizes: DataFrame, hubs: int | None) -> DataFrame:
    """Rows of different components that share a token, as ``_candidates`` takes them.

    Each row outside its token's largest component meets the rows inside and the others outside, or of both those that
    are hubs: by their ids' hashes about ``hubs`` of a token and band, mostly the same ones for all tokens of a group.
    """
    hub = F.lit(True)
    if hubs:
        placed = placed.join(sizes, ["token", "band", "main"])
        hub = F.pmod(F.xxhash64(F.lit("hub"), "doc_id"), F.lit(1 << 20)) * F.col("many") < hubs << 20
    placed = placed.withColumn("hub", hub)
    a = placed.where("not main").select("token", "band", *_side("a"), F.col("c").alias("c_a"), F.col("hub").alias("hub_a"))
    near = F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band")
    b = placed.where("hub").select("token", near, *_side("b"), F.col("c").alias("c_b"), "main")
    # The conditions of _candidates are part of the join, so it makes no rows that they would drop.
    return a.join(b, ["token", "band"]).where("c_a <> c_b and (main or not hub_a or a < b)")


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are lower-cased (A-Z) and parted by white space; a set holds the distinct runs of ``words`` words, or the
    whole sequence if there are fewer. Rows link when 100 * intersection >= percent * union; component_id is the
    smallest id reachable. Null and blank texts have empty sets and link with nothing. Rows of one id are one node:
    a link of any of its texts is a link of it. Rows with a null id have a null component. Other columns aren't read.
    """
    docs = _text.bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = _scratch.stage(_signed(docs, words), "signed")
    rows = signed.where("chunk is null").select("doc_id", "n", "fp", "fp2")
    # Rows with one set are a class; its smallest id stands for it.
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "fp", "fp2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = _scratch.stage(classes.where("first <> last"), "classes")
    if copied.count() <= BROADCAST_IDS:
        copied = F.broadcast(copied)
    copies = rows.join(copied, ["n", "fp", "fp2"]).select(F.col("doc_id").alias("u"), F.col("first").alias("v"))

    named = docs.where("doc_id is not null")
    postings = _prefixes(named, _sketch(signed), words, percent)
    token = Window.partitionBy("token", "deal")
    ordered = token.orderBy("fp", "doc_id")
    # Tokens of one class alone are dropped (unless dealt out: they only make ``top`` larger), and of each class all but
    # one row; equal sets have equal prints, and so the same deal.
    shared = _scratch.stage(
        postings.withColumn("copy", F.lag("fp").over(ordered) == F.col("fp"))
        .withColumn("many", (F.col("deal") > 0) | (F.first("fp").over(token.orderBy("fp")) != F.max("fp").over(token)))
        .where("many and not coalesce(copy, false)")
        # Prefix shingles that no other set has are in no intersection: ``top`` is the most that any overlap can be.
        .withColumn("own", F.count("*").over(Window.partitionBy("doc_id")))
        .withColumn("top", F.ceil(F.col("n") * percent / 100) - F.col("l") + F.col("own"))
        .where(F.col("top") * 100 >= F.col("n") * percent)
        .select("token", "doc_id", "n", "l", "place", "top"),
        "shared",
    )

    # Each document's tokens, a stored table, so that a hub's many rows can be split in the joins with it.
    lists = _scratch.stage(shared.groupBy("doc_id").agg(F.collect_set("token").alias("tokens"), F.first("n").alias("n"), F.first("l").alias("l")), "lists")

    # First the pairs with one hub for each token and size band, in two overlapping series of bands.
    # Sets that can link are in one band or in bands side by side; the bands are a little wider than needed, for rounding.
    size = F.log("n") / float(1.000001 * np.log(100 / min(percent, 99)))
    keys = ["token", "series", "band"]
    banded = shared.select("*", F.posexplode(F.array(F.floor(size), F.floor(size + 0.5))).alias("series", "band"))
    hubs = banded.groupBy(*keys).agg(F.min(F.struct(*_SIDE)).alias("hub"), F.count("*").alias("many")).where("many > 1")
    hubs = _scratch.stage(hubs.select(*keys, "hub"), "hubs")
    spokes = banded.join(hubs, keys).where("hub.doc_id <> doc_id").select("token", *_side("a", "hub."), *_side("b")).distinct()
    star = _scratch.stage(_candidates(spokes, lists, percent), "pairs")
    links = _scratch.stage(_verified(star, docs, words, percent).union(copies), "links")
    reached = _scratch.stage(_graph.components(links), "components")

    # Then the pairs of different components, in rounds: those with some hubs, with more of them, and in the last all.
    tested, hubs = star, HUBS
    placed = shared.select("token", *_SIDE, F.floor(size).alias("band"))
    while True:
        placed = placed.join(reached, F.col("doc_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "doc_id"))
        kinds = placed.groupBy("token", "c").agg(F.count("*").alias("many"))
        largest = kinds.groupBy("token").agg(F.max_by("c", F.struct("many", "c")).alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
        largest = _scratch.stage(largest.select("token", "largest"), "largest")
        placed = placed.join(largest, "token").select("token", *_SIDE, "band", "c", (F.col("c") == F.col("largest")).alias("main"))
        placed = _scratch.stage(placed, "placed")
        sizes = _scratch.stage(placed.groupBy("token", "band", "main").agg(F.count("*").alias("many")), "sizes")
        last = _few(sizes, hubs)
        crossing = _crossing(placed, sizes, None if last else hubs)
        pairs = _scratch.stage(_candidates(crossing, lists, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
        reached = _graph.components(reached.select(F.col("node").alias("u"), F.col("component").alias("v")).union(_verified(pairs, docs, words, percent)))
        if last:
            break
        tested, hubs = tested.union(pairs), hubs * MORE_HUBS
        placed = placed.select("token", *_SIDE, "band")
    return (
        rows.join(reached, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )
