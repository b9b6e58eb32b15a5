"""The trie of all prefixes of conversations, without building it: each conversation owns a suffix of its path.

A node of the trie is a distinct sequence of first turns; its owner is the smallest conversation that begins with it. As
what begins with a longer prefix also begins with a shorter one, the nodes that a conversation owns are the end of its
path. So with windows that mark owned nodes, one group-by over prefixes gives all subtree sums: occurrences less owned
nodes for the tokens that sharing saves, and a flag of each path's owned last node for the leaves.

Conversations with the same turns are one path with a count, windows over a prefix are split by a salt and then joined
by one row a salt, and sums are combined before they are shuffled, so a first turn that all conversations share is no
hot spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketlens.llm import _scratch

#: Parts into which the window of a prefix is split.
SALTS = 64
#: Ids in a piece of a node's list of ends.
PIECE = 4096
#: Nodes of more children meet their children by a broadcast of the node, if there are at most BROADCAST_NODES such nodes.
MANY_CHILDREN, BROADCAST_NODES = 10_000, 100_000
#: Words of ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def branching(conv: Column, block: int = 20, most: int = 4) -> tuple[Column, Column]:
    """The conversation whose first turns begin this one, and how many: the first of its block of ids, by a hash of its id."""
    return conv - conv % block, (F.crc32(conv.cast("string")) % most).cast("int")


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), sha (of role and text) and words of every turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        # The length keeps ("ab", "c") and ("a", "bc") apart.
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "sha")
    return rows.select("conv", F.row_number().over(order).alias("pos"), "sha", "words")


def rebuilt(ordered: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns of each conversation behind the first turns of its block's first one, and conv and size of all of them."""
    base, heads = branching(F.col("conv"), block, most)
    lengths = ordered.groupBy("conv").agg(F.max("pos").alias("own"))
    plan = lengths.select("conv", "own", base.alias("base"), heads.alias("h"))
    # Of a base at most most - 1 turns are wanted, by at most block - 1 others.
    first = ordered.where((F.col("conv") % block == 0) & (F.col("pos") < most))
    held = lengths.where(F.col("conv") % block == 0).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plan = plan.join(held, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = _scratch.stage(plan.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "plan")
    inherited = plan.where("taken > 0").join(first.withColumnRenamed("conv", "base"), "base").where("pos <= taken").select("conv", "pos", "sha", "words")
    own = ordered.join(plan.select("conv", "h", "taken"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "sha", "words")
    return inherited.union(own), plan.select("conv", "size")


def _paths(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, depth, k1 and k2 (of the prefix), words of every turn and of each conversation's root; and the ends."""
    so_far = Window.partitionBy("conv").orderBy("pos")
    # 128 bits of a prefix: its turns' hashes, each mixed with its place.
    keys = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "sha")).over(so_far).alias(f"k{seed}") for seed in (1, 2)]
    roots = sizes.select("conv", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("words"))
    nodes = _scratch.stage(rows.select("conv", F.col("pos").alias("depth"), *keys, "words").union(roots), "prefixes")
    ends = nodes.join(sizes.select("conv", F.col("size").alias("depth")), ["conv", "depth"]).select("conv", "depth", "k1", "k2")
    return nodes, _scratch.stage(ends, "ends")


NODE = ["depth", "k1", "k2"]


def _owned(paths: DataFrame) -> DataFrame:
    """conv, depth and last (whether no conversation goes on) of the owned nodes of every path.

    ``paths`` has conv, size and the node. The first window has a salted part of a prefix's paths, the second a row each part.
    """
    salt = F.pmod(F.xxhash64("conv"), F.lit(SALTS)).alias("salt")
    part = Window.partitionBy(*NODE, "salt")
    local = paths.select("conv", "size", *NODE, salt).withColumns({"least": F.min("conv").over(part), "longest": F.max("size").over(part)}).where("conv = least")
    whole = Window.partitionBy(*NODE)
    return local.withColumns({"least": F.min("conv").over(whole), "longest": F.max("longest").over(whole)}).where("conv = least").select("conv", "depth", (F.col("longest") == F.col("depth")).alias("last"))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """The node and ends_sha256 of every node at which a conversation ends.

    The ids of a node are put in order by ranges, each range gives pieces of text, and one pass over the pieces in order
    feeds the hash, so a task holds one piece however many conversations end at a node.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": pa.array([key[0]], pa.int32()), "k1": pa.array([key[1]], pa.int64()), "k2": pa.array([key[2]], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

        out: list[pa.RecordBatch] = []
        for batch in batches:
            for *k, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv")), strict=True):
                if k != key or len(ids) >= PIECE:
                    if ids:
                        out.append(row())
                    key, ids = k, []
                ids.append(conv)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        schema = pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if k != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, digest.hexdigest()), schema.types, strict=True)], schema=schema)

    ranged = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    listed = ranged.mapInArrow(pieces, "depth int, k1 long, k2 long, first long, ids string")
    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth int, k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations (``rows``: conv, pos, sha, words; ``sizes``: conv, size of each, 0 too).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; all
    numbers of a node are about its members or its subtree, itself included.
    """
    nodes, ends = _paths(rows, sizes)
    # One path for all conversations with the same turns.
    path = _scratch.stage(ends.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("same")).select("conv", F.col("depth").alias("size"), "same"), "paths")
    kept = _scratch.stage(nodes.join(path, "conv"), "kept")
    owned = _scratch.stage(_owned(kept), "owned")
    begin = owned.groupBy("conv").agg(F.min("depth").alias("begin"), F.max(F.col("last").cast("int")).alias("leaf"))
    on = kept.join(begin, "conv", "left")
    rest = Window.partitionBy("conv").orderBy(F.desc("depth"))
    before = Window.partitionBy("conv").orderBy("depth")
    own = F.coalesce(F.col("depth") >= F.col("begin"), F.lit(False))
    on = on.select(
        "conv",
        *NODE,
        "same",
        (F.col("same") * F.sum("words").over(rest) - F.sum(F.when(own, F.col("words")).otherwise(0)).over(rest)).alias("saved"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
        # The next node of the path is one more child where the path owns it.
        F.coalesce(((F.col("depth") < F.col("size")) & (F.col("depth") + 1 >= F.col("begin"))).cast("int"), F.lit(0)).alias("child"),
        F.struct(F.lag("k1").over(before).alias("k1"), F.lag("k2").over(before).alias("k2")).alias("up"),
    )
    sums = on.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"),
        F.sum("same").alias("n_convs"),
        F.sum("child").cast("long").alias("n_children"),
        F.sum("leaf").cast("long").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
        F.min("up").alias("up"),  # all members have the same node above
    )
    sums = _scratch.stage(sums, "nodes")
    above = sums.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = above.where(F.col("n_children") > MANY_CHILDREN).drop("n_children")
    few = above.where(F.col("n_children") <= MANY_CHILDREN).drop("n_children")
    out = sums.select("*", F.col("up.k1").alias("u1"), F.col("up.k2").alias("u2")).drop("up")
    key = ["depth", "u1", "u2"]
    if (n := many.limit(BROADCAST_NODES + 1).count()) == 0 or n > BROADCAST_NODES:
        out = out.join(above.drop("n_children"), key, "left")
    else:
        out = out.join(F.broadcast(many.withColumnRenamed("parent_conv_id", "hot")), key, "left")
        # Those that have met their node need no partner.
        rest_of = out.where("hot is null").drop("hot").join(few, key, "left")
        out = out.where("hot is not null").withColumnRenamed("hot", "parent_conv_id").select(rest_of.columns).union(rest_of)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.join(_scratch.stage(_end_hashes(ends), "hashes"), NODE, "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def branched(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 20, most: int = 4) -> DataFrame:
    """The trie of the conversations as they are rebuilt: the first turns of each come from the first of its block of ids.

    Turns of one conversation are in order of turn (null first), those of one turn by role and then by hash, so repeated
    rows are turns of their own. Null role or text is empty; rows with a null conversation are left out; an empty table
    gives no rows; a conversation that keeps no turn is a member of the root. Other columns are not read.
    """
    ordered = _scratch.stage(turns(conversations, id_col, turn_col, role_col, text_col), "turns")
    return trie(*rebuilt(ordered, block, most))


_TURN = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
#: The query's rows, by listing all prefixes of all conversations.
ORACLE_SQL = rf"""WITH own AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT CAST(range AS UINTEGER) AS n, CAST(range AS UINTEGER) AS v, 0 AS k FROM range(256)),
steps AS (
  WITH RECURSIVE s(n, v, k) AS (SELECT n, v, k FROM bits UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UINTEGER)) ELSE v >> 1 END, k + 1 FROM s WHERE k < 8)
  SELECT n, v FROM s WHERE k = 8),
crc AS (
  WITH RECURSIVE s(c, rest, v) AS (
    SELECT c, CAST(c AS VARCHAR), CAST(4294967295 AS UINTEGER) FROM (SELECT DISTINCT c FROM own)
    UNION ALL SELECT c, rest[2:], xor(steps.v, s.v >> 8) FROM s JOIN steps ON steps.n = xor(s.v & 255, CAST(ascii(rest) AS UINTEGER)) WHERE rest <> '')
  SELECT c, CAST(xor(v, CAST(4294967295 AS UINTEGER)) % 4 AS BIGINT) AS h FROM s WHERE rest = ''),
heads AS (SELECT crc.c, o.i, o.r, o.t FROM crc JOIN own o ON o.c = crc.c - crc.c % 20 AND o.i <= crc.h),
turns AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, r, t FROM (
    SELECT c, 0 AS part, i, r, t FROM heads UNION ALL SELECT o.c, 1, o.i, o.r, o.t FROM own o JOIN crc ON crc.c = o.c WHERE o.i > crc.h)),
paths AS MATERIALIZED (
  SELECT c, d, list({{'r': r, 't': t}}) OVER (PARTITION BY c ORDER BY d) AS p, len({_TURN}) AS w FROM turns
  UNION ALL SELECT c, 0, [], 0 FROM crc),
ends AS (SELECT c, max(d) AS l FROM paths GROUP BY c),
nodes AS MATERIALIZED (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w,
    coalesce(string_agg(CASE WHEN l = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ids
  FROM paths JOIN ends USING (c) GROUP BY p, d),
numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM nodes),
known AS MATERIALIZED (SELECT paths.c, paths.d, numbered.n FROM paths JOIN numbered USING (p, d)),
up AS MATERIALIZED (SELECT DISTINCT a.n, b.n AS parent FROM known a JOIN known b ON a.c = b.c AND b.d = a.d - 1),
below AS MATERIALIZED (SELECT DISTINCT a.n AS top, b.n FROM known a JOIN known b ON a.c = b.c AND b.d >= a.d),
kids AS (SELECT parent AS n, count(*) AS k FROM up GROUP BY parent),
sums AS (
  SELECT top AS n, count_if(k IS NULL) AS n_leaves, sum((n_convs - 1) * w) AS saved
  FROM below JOIN numbered USING (n) LEFT JOIN kids USING (n) GROUP BY top)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(k, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ids) AS ends_sha256
FROM numbered x LEFT JOIN up USING (n) LEFT JOIN numbered y ON y.n = up.parent LEFT JOIN kids ON kids.n = x.n JOIN sums ON sums.n = x.n"""
