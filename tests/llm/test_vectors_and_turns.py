"""Integer clustering and the prefix trie, against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketlens.llm import centroids, prefix_trie, queries
from tests.llm.common import sha, words
from tests.oracle import connect, rows_of, rows_of_sql

VECTORS = "vec_id long, embedding array<float>"
TURNS = "conv_id long, turn long, role string, text string"


def lloyd(rows: list[tuple], clusters: int, rounds: int, size: int) -> list[tuple]:
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((sha(f"1:{i}"), x) for i, x in kept if i is not None)[:clusters]
    middle = [x for _, x in first]
    if not middle:
        return []
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(middle))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        middle = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else m for k, m in enumerate(middle)]
    last = [(i, *near(x)) for i, x in kept]
    each = defaultdict(int)
    for _, d, k in last:
        each[k] += d
    return sorted(((i, k, d, each[k], sum(each.values()), sha(",".join(map(str, middle[k])))) for i, d, k in last), key=repr)


@pytest.mark.parametrize("clusters", [3, 16])
def test_clusters_equal_plain_ones(spark, clusters):
    rng = random.Random(3)
    point = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.3, 2.0]) for _ in range(4)]
    rows = [(i, point()) for i in range(60)] + [(7, point()), (7, point()), (9, [0.0] * 4), (9, [0.0] * 4), (None, point())]
    rows += [(70, None), (71, []), (72, [1.0] * 3), (73, [1.0, None, 1.0, 1.0]), (74, [float("nan")] * 4), (75, [float("-inf")] + [0.0] * 3), (76, [1.0] * 5)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("cluster", "x", "sha", "distance", "column", "value")})
    for parts in (1, 5):
        out = sorted((tuple(r) for r in centroids.cluster(df.repartition(parts), clusters=clusters, size=4).collect()), key=repr)
        assert out == lloyd(rows, clusters, 3, 4)


def test_clusters_of_hardly_any_rows(spark):
    few = [(1, [1.0] * 4), (2, [2.0] * 4)]
    for rows in (few, [], [(None, [1.0] * 4)], [(5, [3e38] * 4)]):
        out = sorted(tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, VECTORS), size=4).collect())
        assert out == (lloyd(few, 16, 3, 4) if rows == few else [])


def trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", sha(f"{len(role or '')}:{role or ''}{text or ''}"), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below)]
        saved = sum((len(members[q]) - 1) * len(_words(q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def _words(text: str) -> list[str]:
    return words(text)


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    say = lambda: rng.choice(["hello there", "a b  c", "é x\ty", "", None, "long " * 50])
    rows = []
    for c in rng.sample(range(100), 45):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), say()))
    # one conversation many times, one first turn for many, repeated rows, ids without conversation
    for c in range(200, 260):
        rows += [(c, 0, "user", "same start"), (c, 1, "assistant", "same end")]
    for c in range(300, 330):
        rows += [(c, 0, "user", "same start"), (c, 1, "assistant", f"end {c}")]
    rows += rows[:5] + [(None, 0, "user", "nobody"), (40, 1, "ab", "c"), (41, 1, "a", "bc")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_one(spark, monkeypatch, seed):
    rows = conversations(seed)
    if seed == 2:
        monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 3)
        monkeypatch.setattr(prefix_trie, "PIECE", 4)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("conv", "pos", "k1", "words", "base", "size", "depth")})
    out = sorted((tuple(r) for r in prefix_trie.branched(df.repartition(5)).collect()), key=repr)
    assert out == trie(rows)


def test_trie_of_no_rows(spark):
    assert prefix_trie.branched(spark.createDataFrame([], TURNS)).count() == 0
    # crc32("3") % 4 is 3 or less and there is no conversation 0: nothing may be left of a short conversation
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 5, 7)]
    assert sorted((tuple(r) for r in prefix_trie.branched(spark.createDataFrame(rows, TURNS)).collect()), key=repr) == trie(rows)


@pytest.mark.parametrize("name", ["op12_centroids", "op13_prefix_trie"])
def test_query_equals_its_twin(spark, name):
    sf = "/root/testdata/sf0.001"
    assert rows_of(queries.queries()[name](spark, sf)) == rows_of_sql(connect(sf), queries.oracles()[name])


def test_empty_ends_hash():
    assert hashlib.sha256(b"").hexdigest() == sha("")
