"""Approximate nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals.

Vectors are scaled to length 1. Each is filed under its nearest coarse centroid, and what is left is coded by one byte
for each few dimensions. A query visits the lists of the centroids nearest to it; a table of its products with all code
words gives each code's approximate cosine by a few additions (asymmetric distances). Only codes and ids move for that.
The best of all that a query visits are then ranked again by their exact cosine, in double precision on the original
vectors, which move for those alone.

What these leave out is decided by bounds, whatever the vectors are like. The worst of a query's k + 1 nearest so far is
its floor. A list whose centroid is too far for its radius to reach the floor isn't visited, nor is an entry scored whose
approximate cosine and coding error stay below it; all others are, so the k nearest are the true ones.

Equal vectors are one entry of the index, with its number of rows and the k + 1 smallest ids, which are all that the
k nearest of any query can be among them. So copies don't fill a list, and lists are searched in shards of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm import _scratch, _text

#: Vectors on which centroids and code words are fitted.
SAMPLE = 20_000
#: Entries of the lists, and queries, whose codes meet in one task; a longer list is split.
SHARD, QUERIES = 8192, 4096
#: Queries that are ranked again together in one task (each with its ``rerank`` vectors).
RANKED = 128
#: Added to bounds for the rounding of sums in single precision, and pairs that are scored exactly at once.
ROUNDING, PAIRS = 1e-5, 1 << 15


@dataclass
class Quantizer:
    coarse: np.ndarray  # list, dimension
    codes: np.ndarray  # part, word, dimension of the part

    def residuals(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The nearest code word of each part of what the coarse centroid leaves."""
        rest = (unit - self.coarse[lists]).reshape(len(unit), len(self.codes), -1)
        return np.stack([_nearest(rest[:, p], words) for p, words in enumerate(self.codes)], axis=1).astype(np.uint8)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for."""
        return self.coarse[lists] + np.concatenate([words[codes[:, p]] for p, words in enumerate(self.codes)], axis=1)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids**2).sum(axis=1)
    return np.concatenate([(points[i : i + 4096] @ centroids.T - half).argmax(axis=1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one moves to a random point."""
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, weights=points[:, d], minlength=len(centroids)) for d in range(points.shape[1])], axis=1)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        centroids[~full] = points[rng.choice(len(points), (~full).sum())]
    return centroids


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))


def commonest_dimension(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The length that most vectors that can take part have (the least of equally common ones); 0 without any."""
    sizes = _sound(vectors, id_col, vector_col).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sizes.d if sizes else 0


def usable(vectors: DataFrame, dimension: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (its doubles as bytes) of the vectors that take part.

    Null or zero vectors and those with null or non-finite components don't, nor do those of another length than
    ``dimension``, nor rows with a null id. Rows that repeat an id and its vector count once.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat = np.ascontiguousarray(vectors.flatten().to_numpy() + 0.0).tobytes()  # -0.0 becomes 0.0
            cut = len(flat) // max(batch.num_rows, 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([flat[i * cut : (i + 1) * cut] for i in range(batch.num_rows)], pa.binary())], ["vec_id", "vector"])

    return _sound(vectors, id_col, vector_col).where(F.size("vector") == dimension).mapInArrow(pack, "vec_id long, vector binary")


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data, offsets = _text.column_bytes(column)
    return np.frombuffer(data.tobytes(), dtype=np.float64).reshape(len(offsets) - 1, -1)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors scaled to length 1; by the largest component first, so that no square overflows or vanishes."""
    x = _vectors(column)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(rows: DataFrame, total: int, lists: int | None = None, part: int = 4, seed: int = 7) -> Quantizer:
    """Coarse centroids and code words from at most about SAMPLE vectors, taken by a hash of their id.

    There are about as many lists as the square root of the number of vectors, from 4 to 4,096, if ``lists`` doesn't say.
    """
    share = min(1.0, SAMPLE / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    gathered = [r.vector for r in sample.select("vector").collect()] or [rows.select("vector").first().vector]
    points = _unit(pa.array([bytes(x) for x in gathered], pa.binary()))
    rng = np.random.default_rng(seed)
    lists = lists or int(np.clip(2 ** round(np.log2(max(total, 1)) / 2), 4, 4096))
    coarse = _means(points, lists, 12, rng)
    rest = points - coarse[_nearest(points, coarse)]
    d = points.shape[1]
    parts = d // part if d % part == 0 else 1
    codes = [_means(x, 256, 8, rng) for x in np.split(rest, parts, axis=1)]
    return Quantizer(coarse, np.stack(codes))


def build(entries: DataFrame, quantizer: Quantizer) -> DataFrame:
    """The staged index: list, entry, ids, code, vector and distance to the list's centroid of each distinct vector."""
    shared = entries.sparkSession.sparkContext.broadcast(quantizer)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column("vector"))
            lists = _nearest(unit, q.coarse)
            codes = q.residuals(unit, lists)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column("entry"), batch.column("ids"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vector"), pa.array(np.linalg.norm(unit - q.coarse[lists], axis=1))], ["list", "entry", "ids", "code", "vector", "far"])

    return _scratch.stage(entries.mapInArrow(code, "list int, entry long, ids array<long>, code binary, vector binary, far double"), "index")


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """entry (smallest id), ids (the ``most`` smallest) and vector of each distinct vector."""
    # The limit on the rank is applied before the shuffle too, so a vector that many rows share is sent a few times.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "vector")


def _shards(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each list's first shard and number of shards, so that a shard holds about SHARD entries; and how many there are."""
    first, parts, shard, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > SHARD:
            shard, held = shard + bool(held), 0
            first[i], parts[i] = shard, -(-n // SHARD)
            shard += int(parts[i])
            continue
        if held + n > SHARD:
            shard, held = shard + 1, 0
        first[i], held = shard, held + n
    return first, parts, shard + 1


def _by_codes(q: Quantizer, unit: np.ndarray, visited: pa.ListArray, kinds: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate cosines of queries and entries (sorted by list) by asymmetric distances; -inf where a list isn't visited."""
    tables = np.einsum("qpd,pwd->pqw", unit.reshape(len(unit), len(q.codes), -1), q.codes.astype(np.float32))
    row = np.repeat(np.arange(len(unit)), np.diff(visited.offsets.to_numpy()))
    asks = np.zeros((len(kinds), len(unit)), dtype=bool)
    seat = np.minimum(np.searchsorted(kinds, visited.flatten().to_numpy()), len(kinds) - 1)
    found = kinds[seat] == visited.flatten().to_numpy()
    asks[seat[found], row[found]] = True
    near = np.full((len(unit), len(codes)), -np.inf, dtype=np.float32)
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        who = np.flatnonzero(asks[i])
        if not len(who):
            continue
        total = (unit[who] @ q.coarse[kinds[i]].astype(np.float32))[:, None]
        for p in range(len(q.codes)):
            total = total + tables[p][who][:, codes[a:b, p]]
        near[who, a:b] = total
    return near


def _scores(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors; each is the same in whatever company."""
    cuts = range(0, len(i), PAIRS)
    return np.concatenate([(right[j[c : c + PAIRS]] * left[i[c : c + PAIRS]]).sum(axis=1) for c in cuts] or [np.zeros(0)])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: float = 0.6, rerank: int = 100, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", bounds: bool = True) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest to each query, without the query's own id.

    A query visits the share ``probes`` of all lists, and more until these hold k + 1 ids (all, if there are fewer). Of
    all entries that it visits, the ``rerank`` with the best codes are scored exactly. Then so is everything else that
    the bounds can't exclude; without ``bounds`` that is left out, and some of the nearest are missed. Equal scores are
    ranked by the smaller id. A vector that takes no part (see ``usable``; the length that counts is the commonest in ``vectors``) is
    neither found nor answered; no vectors or no queries give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    dimension = commonest_dimension(vectors, id_col, vector_col)
    rows = usable(vectors, dimension, id_col, vector_col)
    asked = usable(queries, dimension, id_col, vector_col).distinct()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = _scratch.stage(_distinct(rows, k + 1), "entries")
    total = entries.count()
    if not total:
        return nothing
    quantizer = fit(entries.select(F.col("entry").alias("vec_id"), "vector"), total, lists)
    index = build(entries, quantizer)
    n_lists = len(quantizer.coarse)
    held, sizes, reach = np.zeros(n_lists, dtype=np.int64), np.zeros(n_lists, dtype=np.int64), np.full(n_lists, -np.inf)
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max("far").alias("far")).collect():  # a row a list
        held[r.list], sizes[r.list], reach[r.list] = r.ids, r.n, r.far
    first, parts, n_shards = _shards(sizes)

    # Equal queries are asked once.
    groups = _scratch.stage(asked.groupBy("vector").agg(F.min("vec_id").alias("query")), "queries")
    n_queries = groups.count()
    if not n_queries:
        return nothing
    visits = max(1, round(probes * n_lists))
    shared = spark.sparkContext.broadcast((quantizer, held, reach, first, parts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard with lists that a query visits: their numbers, the query and its floor.

        Queries with a floor (``least``) visit the lists that can reach it, others the nearest ones.
        """
        q, held, reach, first, parts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                unit = _unit(part.column("vector"))
                order = np.argsort(0.5 * (q.coarse**2).sum(axis=1) - unit @ q.coarse.T, axis=1, kind="stable")
                if "least" in part.schema.names:
                    least = part.column("least").to_numpy()
                    row, rank = np.nonzero((unit @ q.coarse.T + reach >= least[:, None] - ROUNDING)[np.arange(len(unit))[:, None], order])
                else:
                    least = np.full(len(unit), -np.inf)
                    enough = np.cumsum(held[order], axis=1) - held[order] < k + 1
                    row, rank = np.nonzero(enough | (np.arange(order.shape[1]) < visits))
                lists = order[row, rank]
                times = parts[lists]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, lists = np.repeat(row, times), np.repeat(lists, times)
                shard = first[lists] + step
                by = np.lexsort((lists, shard, row))
                row, lists, shard = row[by], lists[by], shard[by]
                begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[begin].astype(np.int32)),
                        part.column("query").take(pa.array(row[begin])),
                        part.column("vector").take(pa.array(row[begin])),
                        pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32))),
                        pa.array(least[row[begin]]),
                    ],
                    ["shard", "query", "vector", "lists", "least"],
                )

    # So many queries meet a shard that they are dealt out too; the shard's codes are sent to each part of them.
    n_parts = -(-n_queries // QUERIES)
    part_of = F.pmod(F.xxhash64("query"), F.lit(n_parts)).cast("int")
    routed = lambda asked: asked.mapInArrow(route, "shard int, query long, vector binary, lists array<int>, least double").withColumn("part", part_of)
    of = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("list") + 1)  # noqa: E731  at most 4,096 numbers
    shard = (of(first) + F.pmod(F.xxhash64("entry"), of(parts))).cast("int")
    placed = index.select(shard.alias("shard"), "list", "entry", "code", "ids", "vector", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    depth = max(rerank, k + 1)

    def by_list(entries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order of a shard's entries by list, their ids and codes, and each list's number, begin and end."""
        lists = entries.column("list").to_numpy()
        by = np.argsort(lists, kind="stable")
        kinds, begin = np.unique(lists[by], return_index=True)
        codes = np.frombuffer(b"".join(entries.column("code").to_pylist()), dtype=np.uint8).reshape(len(lists), -1)[by]
        return by, entries.column("entry").to_numpy()[by], codes, kinds, begin, np.append(begin[1:], len(lists))

    def meet(queries: pa.Table, entries: pa.Table) -> pa.Table:
        """The ``depth`` entries of a shard with the best codes for each query, by asymmetric distances."""
        q, names = shared.value[0], ["query", "entry", "near"]
        if not queries.num_rows or not entries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names)
        _, entry, codes, kinds, begin, end = by_list(entries)
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, queries.num_rows, 256):
            part = queries.slice(at, 256).combine_chunks()
            near = _by_codes(q, _unit(part.column("vector")).astype(np.float32), part.column("lists").combine_chunks(), kinds, begin, end, codes)
            n = min(depth, len(entry))
            best = np.argpartition(-near, n - 1, axis=1)[:, :n]
            score = np.take_along_axis(near, best, axis=1)
            i, j = np.nonzero(score > -np.inf)
            for x, y in zip(out, (part.column("query").to_numpy()[i], entry[best[i, j]], score[i, j]), strict=True):
                x.append(y)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names)

    def sift(queries: pa.Table, entries: pa.Table) -> pa.Table:
        """Of a shard, the k + 1 nearest to each query by the exact cosine, among all that may reach its floor."""
        q, names = shared.value[0], ["query", "vec_id", "score"]
        if not queries.num_rows or not entries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        by, entry, codes, kinds, begin, end = by_list(entries)
        of = _unit(entries.column("vector"))[by]
        error = np.linalg.norm(of - q.decoded(np.repeat(kinds, end - begin), codes), axis=1).astype(np.float32) + np.float32(ROUNDING)
        ids = entries.column("ids").combine_chunks().take(pa.array(by))
        flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, queries.num_rows, 256):
            part = queries.slice(at, 256).combine_chunks()
            unit = _unit(part.column("vector"))
            near = _by_codes(q, unit.astype(np.float32), part.column("lists").combine_chunks(), kinds, begin, end, codes)
            floor = part.column("least").to_numpy().copy()
            # The entries of the shard with the best codes may lift the floor.
            if (n := min(depth, len(entry))) > k:
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                i = np.repeat(np.arange(len(unit)), n)
                score = _scores(unit, i, of, best.ravel()).reshape(best.shape)
                score[np.take_along_axis(near, best, axis=1) == -np.inf] = -np.inf
                floor = np.maximum(floor, -np.partition(-score, k, axis=1)[:, k])
            i, j = np.nonzero((near + error >= (floor - ROUNDING)[:, None]) & (near > -np.inf))
            score = _scores(unit, i, of, j)
            # The k + 1 nearest entries, then of their ids again.
            order = np.lexsort((entry[j], -score, i))
            order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order], side="left") <= k]
            i, j, score = i[order], j[order], score[order]
            times = offsets[j + 1] - offsets[j]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found = flat[np.repeat(offsets[j], times) + step]
            i, score = np.repeat(i, times), np.repeat(score, times)
            order = np.lexsort((found, -score, i))
            order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order], side="left") <= k]
            for x, y in zip(out, (part.column("query").to_numpy()[i[order]], found[order], score[order]), strict=True):
                x.append(y)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names)

    keys = ["shard", "part"]
    found = routed(groups).groupBy(*keys).cogroup(placed.drop("ids", "vector").groupBy(*keys)).applyInArrow(meet, "query long, entry long, near float")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "entry"))
    chosen = found.withColumn("place", best).where(F.col("place") <= depth).select("query", "entry")
    buckets = max(1, n_queries // RANKED)
    bucket = F.pmod(F.xxhash64("query"), F.lit(buckets)).cast("int").alias("bucket")
    pairs = chosen.join(index.select("entry", "ids", "vector"), "entry").select(bucket, "query", "ids", "vector")

    def rank(queries: pa.Table, pairs: pa.Table) -> pa.Table:
        """The k + 1 nearest of each query's pairs by the exact cosine."""
        names = ["query", "vec_id", "score"]
        if not queries.num_rows or not pairs.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        query = queries.column("query").to_numpy()
        by = np.argsort(query)
        mine = by[np.searchsorted(query[by], pairs.column("query").to_numpy())]
        score = _scores(_unit(queries.column("vector")), mine, _unit(pairs.column("vector")), np.arange(len(mine)))
        ids = pairs.column("ids").combine_chunks()
        times = np.diff(ids.offsets.to_numpy())
        mine, score, ids = np.repeat(mine, times), np.repeat(score, times), ids.flatten().to_numpy()
        by = np.lexsort((ids, -score, mine))
        mine, score, ids = mine[by], score[by], ids[by]
        start = np.searchsorted(mine, mine, side="left")
        keep = np.arange(len(mine)) - start <= k
        return pa.table([pa.array(query[mine[keep]]), pa.array(ids[keep]), pa.array(score[keep])], names)

    nearest = groups.select(bucket, "query", "vector").groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(rank, "query long, vec_id long, score double")
    if bounds:
        # A query's floor is the last of its k + 1 nearest so far.
        floors = nearest.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") > k).select("query", "least")
        floors = groups.join(floors, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        nearest = routed(_scratch.stage(floors, "floors")).groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(sift, "query long, vec_id long, score double")
    # Back to all queries with that vector; each leaves itself out.
    own = asked.join(groups, "vector").select("query", F.col("vec_id").alias("query_id"))
    answers = own.join(nearest, "query").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
