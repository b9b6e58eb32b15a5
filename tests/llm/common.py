"""Small tables with every awkward row, for all operators."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def letters(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def corpus(n: int = 60, seed: int = 5) -> list[tuple]:
    """Random texts, copies, near copies, shared passages, a very long text, nulls, blanks and a null language."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiéü") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = text(60), text(80)
    rows = [(i, text(rng.randint(1, 120)), "en" if i % 2 else "de") for i in range(n)]
    rows += [(n + i, base if i < 4 else " ".join(w if k != 7 * i else "zz" for k, w in enumerate(base.split())), "en") for i in range(9)]
    rows += [(n + 20 + i, f"{text(5)} {passage} {text(9)}", "de") for i in range(5)]
    rows += [(n + 30, None, "en"), (n + 31, "", None), (n + 32, " \n\t ", "en"), (n + 33, "One", "en"), (n + 34, "ÀB ẞ A\x00b 12 -- «x»", "de"), (n + 35, text(9000), "en"), (n + 36, "a" * 700, "en"), (n + 37, "tie tie tie tie tie tie tie", "en")]
    return [(i, t, lang, f"s{i % 3}", len(t) if t else 0) for i, t, lang in rows]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def clashing(spark):
    """The corpus with extra columns that have the names the operators use inside."""
    df = frame(spark)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("row", "pos", "token", "n", "key", "fp", "hash", "start", "rank", "path", "blob", "query", "node", "component", "mark")})
