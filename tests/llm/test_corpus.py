"""Operators over the whole corpus, against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import _graph, _scratch, _sums, _text, ann, decontaminate, hmm_score, jaccard_join, language_id, queries, suffix_dedup
from tests.llm.common import SCHEMA, clashing, corpus, frame, letters, sha, words
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def item_windows(text: str) -> list[list[str]]:
    w = letters(text)
    return [w[i : i + 10] for i in range(max(len(w) - 9, 1))] if w else []


def test_decontamination(spark):
    rows = corpus()
    texts = {i: t for i, t, *_ in rows}
    items = [(1, " ".join(letters(texts[80])[3:40])), (2, "one"), (3, None), (4, "!!"), (5, "never seen words at all"), (11, "TIE tie Tie"), (1, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(clashing(spark), benchmark).collect()}
    assert len(out) == len(rows)
    for i, text in texts.items():
        w, hit, found = letters(text), set(), set()
        for item, own in items:
            for window in item_windows(own):
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        found.add(str(item))
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    none = decontaminate.decontaminate(frame(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate.decontaminate(frame(spark, []), benchmark).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a x b c d e"), (3, "a x y z b c d e")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    near = decontaminate.decontaminate(docs, benchmark, slop=1).where("contaminated")
    assert {r.doc_id for r in near.collect()} == {1, 2}


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit) for r in decontaminate.decontaminate(docs, benchmark).collect()) == [(0, 2), (1, 0), (1, 2), (1, 2)]


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def components(nodes, links) -> dict:
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("split", [100_000, 2])
def test_jaccard_join(spark, monkeypatch, split):
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    rows = corpus()
    rng = random.Random(3)
    base = rows[0][1].split()[:60] + ["w%d" % i for i in range(60)]
    for k in range(40):  # a group of near copies with more or fewer edits
        own = list(base)
        for _ in range(k % 5):
            own[rng.randrange(len(own))] = rng.choice(["q", "r", f"u{k}"])
        rows.append((300 + k, " ".join(own), None, None, 0))
    line = ["common%d" % i for i in range(9)]
    for k in range(60):  # one line in all texts, which link by it alone, or with much or little else
        own = line + ["e%d" % (k // 3 + i) for i in range(k % 4)] + ["f%d.%d" % (k // 2, i) for i in range(k % 30)]
        rows.append((400 + k, " ".join(own), None, None, 0))
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components(ids, links)
    out = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert {i: r.component_id for i, r in out.items()} == expected
    assert {i: r.n_shingles for i, r in out.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(expected.values())) < len(ids) - 20


def test_jaccard_edges(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(blank).collect()} == {1: (0, 1), 2: (0, 2), 3: (0, 3)}
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (7, "A B C D E F"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_join(twice).collect()) == [(0, 0), (5, 5), (5, 5), (7, 5)]
    assert jaccard_join.jaccard_join(clashing(spark)).count() == len(corpus())


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    out = {r.node: r.component for r in _graph.components(links).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert _graph.components(links.where("u < 0")).count() == 0


def plain_dedup(rows, length=100):
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if (w := data[k : k + length]) in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, x in zip(data, gone, strict=True) if not x)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, sha(kept))
    return out


@pytest.mark.parametrize("rows_a_bucket", [4_000, 12])
def test_suffix_dedup(spark, monkeypatch, rows_a_bucket):
    """With few rows a bucket, anchors are dealt out again by windows, and those by one byte more at a time."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", rows_a_bucket)
    rng = random.Random(9)
    rows = [(i, t) for i, t, *_ in corpus()]
    shared = ["".join(rng.choice("abé ") for _ in range(rng.randint(90, 260))) for _ in range(6)]
    rows += [(400 + i, "".join(rng.choice(shared)[rng.randint(0, 60) :] + rng.choice(["", "x", "\x00y"]) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(600, "ab" * 400), (601, "ab" * 60), (602, "\x00" * 250)]
    expected = plain_dedup(sorted(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert out == expected
    assert sum(r[1] for r in expected.values()) > 5000


@pytest.mark.parametrize("rows_a_bucket", [4_000, 12])
def test_repeat_groups(spark, monkeypatch, rows_a_bucket):
    """Against all windows of all texts: each group has every place of its string, every repeated window lies in a
    group at each of its places, and windows that share their places and follow each other are in one group."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", rows_a_bucket)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (130, 400, 900, 2000)]
    texts = [word(40) + rng.choice(shared)[rng.randint(0, 90) :] + word(30) + (rng.choice(shared) if i % 3 else "") for i in range(24)]
    texts += [texts[3], texts[3] + word(9), "xy" * 150, shared[2] + shared[1], None, word(50)]
    docs = {i: (t or "").encode() for i, t in enumerate(texts)}
    out = suffix_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    groups: dict = {}
    for r in out:
        groups.setdefault((r.kind, r.repeat, r.size), set()).add((r.doc_id, r.start))
    assert {frozenset(d for d, _ in v) for (kind, *_), v in groups.items() if kind == "text"} == {frozenset([3, 24])}
    groups = {k: v for k, v in groups.items() if k[0] == "part"}
    places: dict = {}
    for i, d in docs.items():
        for k in range(len(d) - 99):
            places.setdefault(d[k : k + 100], set()).add((i, k))
    covered, shapes = set(), []
    for (_, _, size), own in groups.items():
        (string,) = {docs[i][k : k + size] for i, k in own}
        assert len(string) == size and len(own) > 1
        assert own == {(i, k) for i, k in places[string[:100]] if docs[i][k : k + size] == string}
        covered |= {(i, k + s) for i, k in own for s in range(size - 99)}
        i, k = min(own)
        shapes.append((i, k, k + size, frozenset((j, x - k) for j, x in own)))
    alone = {p for w in places.values() if len(w) == 2 and {i for i, _ in w} == {3, 24} for p in w}  # only in the copied text
    assert {p for w in places.values() if len(w) > 1 for p in w} - alone <= covered
    for a in shapes:
        assert not any(b != a and b[0] == a[0] and b[3] == frozenset((j, x + a[1] - b[1]) for j, x in a[3]) and a[1] < b[1] <= a[2] - 99 for b in shapes)
    assert max(size for _, _, size in groups) >= 1800


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    assert suffix_dedup.dedup(clashing(spark)).count() == len(corpus())
    text = "z" + "".join(map(str, range(100)))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None), (3, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, len(text))]


def test_maximal_repeats_and_intervals():
    assert sorted(suffix_dedup.intervals([1, 3, 3, 0, 2])) == [(1, 0, 3), (2, 4, 5), (3, 1, 3)]
    texts = [b"xx" + b"abcdefgh" * 10 + b"1", b"y" + b"abcdefgh" * 10 + b"2", b"z" + b"abcdefgh" * 9]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    place = np.concatenate([np.arange(a, b - 69) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    end = offsets[np.searchsorted(offsets, place, side="right")]
    before = np.where(np.isin(place, offsets), -1, data[place - 1].astype(int))
    found = {(n, tuple(sorted(place[order[a : b + 1]].tolist()))) for n, order, a, b in suffix_dedup.maximal_repeats(data, place, end, before, np.zeros(len(place), bool), 70)}
    assert (80, (2, len(texts[0]) + 1)) in found
    for n, places in found:
        assert len({data[p : p + n].tobytes() for p in places}) == 1


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[50:60] = x[50]  # equal vectors
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15 + [None]), (904, [1.0]), (905, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.search(vectors, vectors.where("vec_id % 5 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found: dict[int, list] = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 and r.vec_id != r.query_id
    assert set(found) == set(range(0, 400, 5)) and all(len(v) == 5 for v in found.values())
    hits = 0
    for q, got in found.items():
        score = unit @ unit[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len(set(best) & set(got))
    assert hits / (5 * len(found)) >= 0.9
    assert found[50] == [51, 52, 53, 54, 55] and found[55] == [50, 51, 52, 53, 54]


def test_few_neighbours(spark):
    schema = "vec_id long, embedding array<double>"
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (50, None)], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(three, three.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(three.where("vec_id < 0"), three).count() == 0
    assert ann.search(three, three.where("vec_id < 0")).count() == 0


def test_neighbours_of_mixed_lengths_and_clashing_columns(spark):
    """The length that counts is that of the corpus, whatever the queries have; each list may fill several shards."""
    rows = [(i, [float(i % 7 + 1), float(i), 1.0], 1, 1) for i in range(60)] + [(100 + i, [1.0, float(i)], 1, 1) for i in range(5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, entry int")
    out = ann.search(vectors, vectors.where("vec_id >= 100 or vec_id < 3")).collect()
    assert {r.query_id for r in out} == {0, 1, 2} and len(out) == 15
    assert ann.commonest_dimension(vectors) == 3 and ann.commonest_dimension(vectors.where("vec_id < 0")) == 0
    twice = ann.search(vectors.union(vectors), vectors.where("vec_id = 1")).collect()
    assert sorted((r.rank, r.vec_id) for r in twice) == sorted((r.rank, r.vec_id) for r in out if r.query_id == 1)


def test_shards_of_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 10)
    first, parts, n = ann._shards(np.array([4, 5, 25, 3, 8, 0]))
    assert (first.tolist(), parts.tolist(), n) == ([0, 0, 1, 4, 5, 5], [1, 1, 3, 1, 1, 1], 6)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {(r.query_id, r.vec_id) for r in ann.search(vectors, vectors.where("vec_id % 10 = 0"), probes=1.0, lists=4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {(q, int(i)) for q in range(0, 300, 10) for i in np.argsort(-(unit @ unit[q]) + 9 * (np.arange(300) == q))[:5]}
    assert len(out & best) >= 0.97 * len(best)


def test_neighbours_of_rows_that_codes_cannot_tell_apart(spark):
    """Tight groups, scaled copies, a length that no part divides, and few lists visited: the nearest are still the true ones."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(3, 13))
    tight = centre[rng.integers(0, 3, 1500)] + 1e-4 * rng.normal(size=(1500, 13))
    x = np.concatenate([tight, rng.normal(size=(500, 13)) * rng.uniform(1e-6, 1e6, (500, 1)), tight[:20] * 4.0])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.search(vectors, vectors.where("vec_id % 50 = 0"), probes=0.1).toPandas().sort_values(["query_id", "rank"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, own in out.groupby("query_id"):
        score = unit @ unit[q]
        score[q] = -9
        assert np.abs(own.score.to_numpy() - np.sort(score)[: -6 : -1]).max() < 1e-12
        assert np.abs(own.score.to_numpy() - score[own.vec_id]).max() < 1e-12 and own["rank"].tolist() == [1, 2, 3, 4, 5]
    assert out.query_id.nunique() == 41


def test_stored_tables_leave_no_shuffle_files(spark):
    """A run writes many tables; the shuffle files of one go before the next, whenever the driver collects garbage."""
    from pathlib import Path
    from time import sleep

    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: {str(f) for f in local.rglob("shuffle_*")}
    before = files()
    out = _scratch.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(100):  # they go in the background
        if not files() - before:
            break
        sleep(0.1)
    assert not files() - before
    assert sorted(r["count"] for r in out.collect()) == [142] + [143] * 6 and spark.conf.get(_scratch.CLEANUP) == "false"


def test_sums_of_rounds_leave_no_shuffle_files(spark):
    """Each part of a round of training sums up arrays; their files go before the next."""
    from pathlib import Path
    from time import sleep

    local = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: {str(f) for f in local.rglob("shuffle_*")}
    before = files()
    ones = spark.range(0, 1000, 1, 8).select(F.lit(0).alias("part"), F.lit(np.ones(3).tobytes()).alias("counts"))
    assert _sums.sum_arrays(ones)[0].tolist() == [1000.0] * 3
    for _ in range(100):  # they go in the background
        if not files() - before:
            break
        sleep(0.1)
    assert not files() - before


def test_language_identification(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert out.score.between(0, 1).all()
    assert out.rejected.mean() < 0.01


def test_language_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, "123 !?"), (3, "the and of it is"), (4, "ζψξ " * 60), (3, "the and of it is"), (None, "der die und")], "doc_id long, text string")
    out = {(r.doc_id, r.lang_pred): r for r in language_id.predict(odd, model).collect()}
    assert out[1, "und"].rejected and out[2, "und"].score == 0
    assert not out[3, "en"].rejected and out[None, "de"]
    assert next(r for (i, _), r in out.items() if i == 4).rejected  # unlike every language that it knows
    assert language_id.predict(odd.limit(0), model).count() == 0
    assert language_id.learn(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_every_language_has_a_cutoff(spark):
    rng = random.Random(3)
    word = lambda of: "".join(rng.choice(of) for _ in range(rng.randint(2, 7)))
    text = lambda of, n=60: " ".join(word(of) for _ in range(n))
    # 30 texts of one language, one of a second, and a third that only has a text of several segments.
    rows = [(i, text("abcde"), "aa", "s", 0) for i in range(30)] + [(50, text("fghij"), "ff", "s", 0), (51, text("klmno", 9000), "kk", "s", 0)]
    model = language_id.learn(frame(spark, rows), F.lit(True))
    assert model.languages == ["aa", "ff", "kk"] and np.isfinite(model.cutoff).all()
    odd = spark.createDataFrame([(1, text("abcde")), (2, text("klmno")), (3, "\u03b6\u03c8\u03be\u03c9 " * 60), (4, text("abcde", 9000))], "doc_id long, text string")
    out = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 4)] == ["aa", "kk", "aa"] and not any(out[i].rejected for i in (1, 2, 4))
    assert out[3].rejected


def test_letters_beyond_16_bits(spark):
    assert language_id.characters("\U00020000b\U0001e900").tolist() == [32, 0xD840, 0xDC00, ord("b"), 0xD83A, 0xDD22, 32]  # Adlam has lower case
    assert len(language_id.characters("\U0001f916 \U0001f600!")) == 1  # no letter
    adlam = "\U0001e922\U0001e923\U0001e924 \U0001e925\U0001e926 " * 9
    docs = frame(spark, [(i, adlam if i % 2 else "plain words of a text " * 9, "ff" if i % 2 else "en", "s", 0) for i in range(60)])
    model = language_id.learn(docs, F.lit(True))
    odd = spark.createDataFrame([(1, adlam), (2, "\U0001f916\U0001f600"), (3, "plain words")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(odd, model).collect()} == {1: "ff", 2: "und", 3: "en"}


def test_kneser_ney_is_a_distribution(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abca ") for _ in range(3000))
    gram, n = np.unique(language_id.keys(language_id.characters(text)), return_counts=True)
    model = language_id.estimate({"x": (gram, n.astype(float))})
    head = np.uint64(gram[10]) >> np.uint64(16)
    every = np.array([(int(head) << 16) | ord(c) for c in " abc\u03b6"], dtype=np.uint64)  # one stands for all unseen ones
    assert abs(np.exp(model.score(every)).sum() - 1.0) < 1e-6


def plain_kneser_ney(counts: Counter, text: str) -> list[float]:
    """Log probabilities of a text's characters by the textbook recursion, from counts of 4-grams."""
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])  # in how many contexts
    alphabet = len(levels[1]) + 1

    def p(gram: str) -> float:
        n = len(gram)
        if not n:
            return 1 / alphabet
        own = levels[n]
        ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        total = sum(c for g, c in own.items() if g[:-1] == gram[:-1])
        if not total:
            return p(gram[1:])
        kinds = sum(g[:-1] == gram[:-1] for g in own)
        return max(own.get(gram, 0) - d, 0) / total + d * kinds / total * p(gram[1:])

    padded = "   " + text
    return [math.log(p(padded[i - 3 : i + 1])) for i in range(3, len(padded))]


def test_kneser_ney_equals_the_plain_recursion():
    rng = random.Random(8)
    text = "".join(rng.choice("abbca ") for _ in range(400))
    gram, n = np.unique(language_id.keys(language_id.characters(text)), return_counts=True)
    model = language_id.estimate({"x": (gram, n.astype(float))})
    decode = lambda g: "".join(chr((int(g) >> s) & 0xFFFF) for s in (48, 32, 16, 0))
    counts = Counter({decode(g): int(c) for g, c in zip(gram, n, strict=True)})
    other = " ".join("".join(rng.choice("abcd") for _ in range(4)) for _ in range(12)) + " "
    got = model.score(language_id.keys(language_id.characters(other)))[:, 0]
    assert np.allclose(got, plain_kneser_ney(counts, other), atol=1e-4)


def test_labels_are_bounded(spark):
    docs = frame(spark, [(i, f"some words of text {i}", f"l{i // 3}" if i < 30 else "en", "s", 0) for i in range(90)])
    assert language_id.learn(docs, F.lit(True), most_languages=3).languages == ["en", "l0", "l1"]


def test_scores(spark):
    rows = corpus()
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = {r.doc_id: r for r in hmm_score.score(clashing(spark), held).collect()}
    tokens = {i: [*words(t), None] for i, t, *_ in rows}
    counts = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    total = sum(counts.values())
    for i, own in tokens.items():
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), total)
        assert abs(r.base_score - base) < 1e-6 and math.isfinite(r.score) and r.score < 0


def test_rare_words_are_joined(spark, monkeypatch):
    """The same sums when hardly a word's count is held by the tasks."""
    monkeypatch.setattr(hmm_score, "HELD_WORDS", 3)
    docs = frame(spark, corpus()[:30] + corpus()[:2])
    few = {r.doc_id: (round(r.base_score, 6), r.n_known) for r in hmm_score.score(docs, F.lit(False), rounds=1).collect()}
    monkeypatch.setattr(hmm_score, "HELD_WORDS", 1 << 17)
    many = {r.doc_id: (round(r.base_score, 6), r.n_known) for r in hmm_score.score(docs, F.lit(False), rounds=1).collect()}
    assert few == many and len(few) == 30


def test_score_edges(spark):
    assert hmm_score.score(frame(spark, []), F.lit(False)).count() == 0
    none = hmm_score.score(frame(spark, corpus()[:3]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def _model(states=3, kinds=5, seed=0):
    rng = np.random.default_rng(seed)
    row = lambda *n: rng.dirichlet(np.ones(n[-1]), n[:-1])
    return hmm_score.Model(rng.dirichlet(np.ones(states)), row(states, states), row(states, kinds).T)


def test_forward_is_exact():
    model = _model()
    codes, lengths = np.array([0, 1, 4, 2, 3, 3]), np.array([4, 2])
    begin = np.array([0, 4])
    got = hmm_score.forward(model, codes, begin, lengths)
    for i in range(2):
        own = codes[begin[i] : begin[i] + lengths[i]]
        total = 0.0
        for path in np.ndindex(*[3] * len(own)):
            p = model.start[path[0]]
            for t, s in enumerate(path):
                p *= model.emit[own[t], s] * (model.move[path[t - 1], s] if t else 1)
            total += p
        assert abs(got[i] - math.log(total)) < 1e-9


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(1)
    codes, lengths = rng.integers(0, 5, 300) // 2 * 2, np.array([100, 150, 50])
    begin = np.array([0, 100, 250])
    model, last = _model(), -np.inf
    for _ in range(6):
        start, move, emit, log = hmm_score.expect(model, codes, begin, lengths)
        assert log >= last - 1e-9 and abs(log - hmm_score.forward(model, codes, begin, lengths).sum()) < 1e-6
        assert abs(emit.sum() - 300) < 1e-6 and abs(move.sum() - 297) < 1e-6 and abs(start.sum() - 3) < 1e-6
        last, emit = log, emit + 1e-9
        model = hmm_score.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_segments_change_nothing(monkeypatch):
    """Long texts in segments: the likelihood and all expected counts of the whole recursion."""
    rng = np.random.default_rng(6)
    codes, lengths = rng.integers(0, 5, 400), np.array([150, 7, 200, 1, 42])
    begin = np.cumsum(lengths) - lengths
    model = _model()
    whole, log = hmm_score.expect(model, codes, begin, lengths), hmm_score.forward(model, codes, begin, lengths)
    for long, segment, most in ((40, 16, 1 << 19), (1, 1, 1 << 19), (149, 149, 50), (10, 7, 3)):
        monkeypatch.setattr(hmm_score, "LONG", long)
        monkeypatch.setattr(hmm_score, "SEGMENT", segment)
        parts = hmm_score.expect(model, codes, begin, lengths, most)
        assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))
        assert np.allclose(log, hmm_score.forward(model, codes, begin, lengths))


def test_score_equals_a_plain_recursion(spark, monkeypatch):
    """The query's score: class probabilities by a plain forward recursion, and each word's share of its class."""
    kept = []
    train = hmm_score.train
    monkeypatch.setattr(hmm_score, "train", lambda *a, **k: kept.append(train(*a, **k)) or kept[-1])
    rows = corpus()[:40]
    out = {r.doc_id: r.score for r in hmm_score.score(frame(spark, rows), F.col("doc_id") % 5 == 0, states=3).collect()}
    model = kept[0]
    counts = Counter(w for i, t, *_ in rows if i % 5 for w in [*words(t), None])
    hashed = {w: _text.word_hash(w) for i, t, *_ in rows for w in words(t)} | {None: hmm_score.END}
    top = [w for w in sorted((w for w in counts if w), key=lambda w: (-counts[w], hashed[w]))][:4096]
    kinds = {w: i for i, w in enumerate(top)}
    kinds[None] = len(top) + 256
    groups: dict = {}
    for w, n in counts.items():
        if w not in kinds:
            own = groups.setdefault(hashed[w] % 256, [0, 0])
            own[0], own[1] = own[0] + n, own[1] + 1
    for i, text, *_ in rows:
        alpha, total = model.start, 0.0
        for k, w in enumerate([*words(text), None]):
            kind = kinds.get(w, len(top) + hashed[w] % 256)
            alpha = (alpha @ model.move if k else alpha) * model.emit[kind]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w is not None and w not in kinds:
                n, v = groups.get(hashed[w] % 256, (0, 0))
                total += math.log10((counts[w] + 1) / (n + v + 1))
        assert abs(out[i] - total) < 1e-6


def test_training_beats_word_counts(spark):
    """Texts of two topics whose words alternate in kind: on held-out texts the model is far better than counts."""
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(30)] for k in ("an", "bn", "av", "bv")]
    rows = []
    for i in range(400):
        topic = rng.randrange(2)
        rows.append((i, " ".join(rng.choice(kinds[topic + 2 * (j % 2)]) for j in range(rng.randint(20, 80))), None, None, 0))
    out = hmm_score.score(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).where("held_out").toPandas()
    assert (out.score - out.base_score).sum() / out.n_tokens.sum() > 0.4  # log10 a token; a factor of 4 is 0.6


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_twins(spark, name):
    assert rows_of(queries.queries()[name](spark, SF)) == rows_of_sql(connect(SF), queries.oracles()[name])


def test_schema_of_the_corpus():
    assert SCHEMA.startswith("doc_id long")


def test_suffix_dedup_of_many_texts_of_one_id(spark, monkeypatch):
    """Each of the texts of an id gets its own bytes back, in the order of their hashes where they share a passage."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef ") for _ in range(130))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(rng.randint(90, 140))) for _ in range(300)] + [f"{i} {passage} {i}" for i in range(12)]
    rows = [(i, t, None, None, 0) for t in texts for i in (7, None)] + [(7, texts[0], None, None, 0), (9, "alone", None, None, 0)]
    for most in (1_000_000, 0):
        monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", most)
        out = suffix_dedup.dedup(frame(spark, rows)).collect()
        assert len(out) == len(rows)
        got = {(r.doc_id, r.kept_sha256) for r in out if not r.n_removed}
        assert {(None, sha(t)) for t in texts} | {(7, sha(t)) for t in texts[:300]} | {(9, sha("alone"))} <= got
        # Of the texts with the passage the one with the smallest hash keeps it.
        first = min(texts[300:], key=sha)
        assert (7, sha(first)) in got and sum(r.n_removed >= 130 for r in out if r.doc_id == 7) == 11


def test_scores_of_many_texts_of_one_id(spark, monkeypatch):
    """Rare words of rows that share an id, null included, are summed up row by row."""
    monkeypatch.setattr(hmm_score, "HELD_WORDS", 2)
    rng = random.Random(9)
    rows = [(rng.choice([None, 5]), " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 20))), None, None, 0) for _ in range(200)]
    counts = Counter(w for _, t, *_ in rows for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in [*words(t), None]), 6) for _, t, *_ in rows)
    out = hmm_score.score(frame(spark, rows), F.lit(False), rounds=1).collect()
    assert np.allclose(sorted(r.base_score for r in out), want, atol=2e-6) and all(r.n_known == r.n_tokens for r in out)
