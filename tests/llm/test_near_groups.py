"""A large group of near copies whose pairs lie on either side of the threshold."""

from __future__ import annotations

import random

from marketlens.llm import _scratch, jaccard_join
from tests.llm.common import frame, words


def test_links_of_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0, raising=False)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        for k in rng.sample(range(200), 2 if i >= 100 and rng.random() < 0.9 else rng.choice((3, 4, 5))):
            text[k] = f"x{i}_{k}"
        rows.append((i, " ".join(text), "en", "s", 1))
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(t) for _, t, *_ in rows)]
    links = [(a, b) for a in range(300) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = list(range(300))
    for _ in range(300):  # the smallest id spreads along the links
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    made, stage = [], _scratch.stage

    def counted(df, name):
        out = stage(df, name)
        if name == "links":
            made.append(out.count())
        return out

    monkeypatch.setattr(_scratch, "stage", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert got == dict(enumerate(root))
    assert len(links) > 10_000 and 1 < len(set(root)) < 300
    assert max(made) < 10 * 300, (max(made), len(links))
