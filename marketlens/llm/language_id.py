"""Language identification with character language models.

For each language an interpolated Kneser-Ney model of characters is learned. The models of all languages share sorted
arrays of packed n-grams, one array a length, with a column of log probabilities a language, so one binary search a
character serves all languages. The language with the lowest cross-entropy a character is chosen; a text is rejected
whose cross-entropy is beyond what texts of that language have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import _text

#: Longest n-gram; four symbols of 16 bits fill the 64 bits of a key.
ORDER = 4
#: Languages with fewer segments of text are cross-validated; a cut-off of a language's own needs so many scores.
FEW, HELD = 200, 20
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letter[0]


def characters(text: str) -> np.ndarray:
    """Lower-case letters of a text as 16-bit symbols, each stretch of anything else as one blank; a blank at both ends.

    A letter beyond U+FFFF is two symbols, its surrogates.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = _letters()[codes]
    codes = np.where(keep, codes, np.uint32(32))
    first = np.ones(len(codes), dtype=bool)
    first[1:] = keep[1:] | keep[:-1]
    codes = codes[first]
    wide = codes > 0xFFFF
    if wide.any():
        codes = np.repeat(codes, 1 + wide)
        high = np.flatnonzero(wide) + np.arange(wide.sum())
        beyond = codes[high] - np.uint32(0x10000)
        codes[high], codes[high + 1] = 0xD800 + (beyond >> 10), 0xDC00 + (beyond & 0x3FF)
    codes = codes.astype(np.uint16)
    return np.concatenate([codes[:0] if len(codes) and codes[0] == 32 else np.array([32], np.uint16), codes, np.array([32] * bool(len(codes) and codes[-1] != 32), np.uint16)])


def keys(codes: np.ndarray) -> np.ndarray:
    """The packed ORDER-gram that ends at each character but the first blank; blanks stand before the text."""
    wide = np.concatenate([np.full(ORDER - 2, 32, np.uint64), codes.astype(np.uint64)])
    n = len(codes) - 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | wide[i : i + n]
    return out


@dataclass
class Model:
    """keys[n], logs[n]: n-grams and a column of log probabilities a language; contexts[n], backs[n]: what is left for shorter ones."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray  # a number a language
    cutoff: np.ndarray
    spread: np.ndarray

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each gram, a column a language."""
        out = np.zeros((len(grams), len(self.languages)), dtype=np.float32)
        live, low = np.arange(len(grams)), grams
        for n in range(ORDER, 0, -1):
            at = np.minimum(np.searchsorted(self.keys[n], low), len(self.keys[n]) - 1)
            hit = self.keys[n][at] == low
            if n == ORDER and hit.all():
                return self.logs[n][at]
            out[live[hit]] += self.logs[n][at[hit]]
            live, low = live[~hit], low[~hit]
            if not len(live):
                return out
            if n > 1:
                head = low >> np.uint64(16)
                at = np.minimum(np.searchsorted(self.contexts[n], head), len(self.contexts[n]) - 1)
                seen = self.contexts[n][at] == head
                out[live[seen]] += self.backs[n][at[seen]]
                low = low & np.uint64((1 << (16 * (n - 1))) - 1)
        out[live] += self.floor
        return out


def _sums(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the sum of their counts and how many they were."""
    distinct, inverse = np.unique(values, return_inverse=True)
    return distinct, np.bincount(inverse, weights=counts), np.bincount(inverse)


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from the counts of ORDER-grams of each language."""
    languages = sorted(counts)
    levels: dict[str, dict[int, tuple]] = {}
    for lang in languages:
        gram, count = counts[lang]
        levels[lang] = {}
        for n in range(ORDER, 0, -1):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))
            head, total, kinds = _sums(gram >> np.uint64(16), count)
            levels[lang][n] = gram, np.maximum(count - discount, 0), head, total, discount * kinds / total
            if n > 1:  # shorter n-grams count in how many contexts they occur
                gram, _, kinds = _sums(gram & np.uint64((1 << (16 * (n - 1))) - 1), count)
                count = kinds.astype(float)
    alphabet = len(np.unique(np.concatenate([levels[x][1][0] for x in languages]))) + 1
    all_keys, logs, contexts, backs = [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros(0)] * (ORDER + 1), [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros(0)] * (ORDER + 1)
    shorter = None
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[x][n][0] for x in languages]))
        heads = np.unique(union >> np.uint64(16))
        if n == 1:
            below = np.full((len(union), len(languages)), 1 / alphabet)
        else:
            below = shorter[np.searchsorted(all_keys[n - 1], union & np.uint64((1 << (16 * (n - 1))) - 1))]
        p = np.zeros((len(union), len(languages)))
        rest = np.ones((len(heads), len(languages)))
        for k, lang in enumerate(languages):
            gram, kept, head, total, left = levels[lang][n]
            rest[np.searchsorted(heads, head), k] = left
            p[np.searchsorted(union, gram), k] = kept / total[np.searchsorted(head, gram >> np.uint64(16))]
        p += rest[np.searchsorted(heads, union >> np.uint64(16))] * below
        all_keys[n], logs[n], contexts[n], backs[n], shorter = union, np.log(p).astype(np.float32), heads, np.log(rest).astype(np.float32), p
    # The alphabet has one more character, which stands for all that no language has: it gets what the empty context leaves.
    floor = (backs[1][0] - np.log(alphabet)).astype(np.float32)
    return Model(languages, all_keys, logs, contexts, backs, floor, np.full(len(languages), np.inf), np.zeros(len(languages)))


def learn(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", a_language: int = 2000, longest: int = 20_000, most_languages: int = 200
) -> Model | None:
    """A model from the rows that fulfil ``train``; None if none has a label and letters.

    At most ``most_languages`` labels are learned, those of most segments (then in alphabetical order), so a noisy label
    column makes neither the model nor what is gathered larger.

    Texts are taken in segments of ``longest`` characters, the last one shorter. The model is fitted on a bounded sample:
    about ``a_language`` segments of each language, by the hash of their id, place and text. A quarter of these is held
    back to set the cut-offs: a text is rejected whose cross-entropy is over the highest of the language there by a
    tenth, with more slack for short texts. Languages of fewer than FEW segments are fitted on all of them, and each
    quarter is scored by a model without it. Where fewer than HELD scores are left, the cut-off is that of all
    languages' scores together; without any score, that of even odds over the alphabet.
    """
    labelled = _text.bounded(docs).where(train & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.length(text_col) - 1, F.lit(0)) / longest))
    cut_up = labelled.select(F.col(label_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.explode(places).alias("place"))
    cut_up = cut_up.withColumn("text", F.expr(f"substring(text, int(place * {longest} + 1), {longest})"))
    usable = cut_up.select("lang", "text", F.pmod(F.xxhash64("id", "place", "text"), F.lit(1 << 40)).alias("h"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return None
    few = [r.lang for r in sizes if min(r.n, a_language) < FEW]
    cuts = docs.sparkSession.createDataFrame([(r.lang, int(max(min(1.0, a_language / r.n) * (1 << 40), r.least + 1)), r.lang in few) for r in sizes], "lang string, cut long, few boolean")
    # At most ``most_languages`` rows.
    sample = usable.join(F.broadcast(cuts), "lang").where("h < cut").select("lang", "text", "h", "few", F.pmod("h", F.lit(4)).alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.slices(batches):
            grams = [keys(characters(t)) if t else np.zeros(0, np.uint64) for t in part.column("text").to_pylist()]
            groups: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, fold, own in zip(part.column("lang").to_pylist(), part.column("part").to_pylist(), grams, strict=True):
                groups.setdefault((lang, fold), []).append(own)
            for (lang, fold), own in groups.items():
                gram, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array([fold] * len(gram), pa.int32()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "part", "gram", "n"])

    # The folds of languages with few segments are counted apart.
    fitted = sample.where("few or fold > 0").select("lang", F.expr("int(if(few, fold, -1))").alias("part"), "text")
    rows = fitted.mapInArrow(count, "lang string, part int, gram long, n long").groupBy("lang", "part", "gram").agg(F.sum("n").alias("n")).toPandas()

    def fit(without: int | None = None) -> Model | None:
        counts = {}
        for lang, own in rows[rows.part != without].groupby("lang"):
            own = own.groupby("gram", as_index=False).n.sum()
            own = own.assign(gram=own.gram.to_numpy(np.int64).view(np.uint64)).sort_values("gram")
            counts[lang] = own.gram.to_numpy(np.uint64), own.n.to_numpy(float)
        return estimate(counts) if counts else None

    def scores(held: DataFrame, model: Model):
        return predict(held.select(F.col("h").alias("doc_id"), "text", "lang"), model, keep=("lang",)).where("lang_pred = kept_lang and n_chars >= 50").select(F.col("kept_lang").alias("lang"), "entropy").toPandas()

    model = fit()
    if model is None:
        return None
    held = [scores(sample.where("fold = 0 and not few"), model)]
    if few:
        for fold in range(4):
            if (part := fit(fold)) is not None:
                held.append(scores(sample.where("few").where(F.col("fold") == fold), part))
    found = {lang: np.concatenate([x.entropy[x.lang == lang].to_numpy(float) for x in held]) for lang in model.languages}
    every = np.concatenate(list(found.values()))
    even = float(np.log(len(model.keys[1]) + 1))
    for k, lang in enumerate(model.languages):
        own = found[lang] if len(found[lang]) >= HELD else every
        model.cutoff[k], model.spread[k] = (1.1 * own.max(), own.mean()) if len(own) else (even, even)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, entropy, n_chars and rejected for each row; columns of ``keep`` come as kept_<name>.

    ``und`` with score 0, rejected, if the text is null or has no letter, or if there is no model. A tie goes to the
    first language in alphabetical order. The score is the posterior of the language from even odds, of a text of at
    most 50 characters of the same cross-entropy. Repeated rows get a row each. Only languages that the model has learned
    are named: the ``most_languages`` commonest labels of ``learn``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    kind = docs.schema[id_col].dataType.simpleString()
    letters = lambda codes: len(codes) > 1  # noqa: E731  a text without letters is one blank

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in _text.slices(batches, most=1 << 20):
            codes = [characters(t) if t else np.zeros(0, np.uint16) for t in part.column("text").to_pylist()]
            has = np.array([letters(c) for c in codes], dtype=bool)
            n = len(codes)
            lang, score, entropy, size, out = np.full(n, "und", dtype=object), np.zeros(n), np.full(n, np.nan), np.zeros(n, np.int64), np.ones(n, dtype=bool)
            if model is not None and has.any():
                own = np.flatnonzero(has)
                grams = [keys(codes[i]) for i in own]
                size[own] = [len(g) for g in grams]
                begin = np.cumsum(size[own]) - size[own]
                logs = np.add.reduceat(model.score(np.concatenate(grams)), begin, axis=0, dtype=np.float64)
                cross = -logs / size[own][:, None]
                best = cross.argmin(axis=1)
                least = cross[np.arange(len(own)), best]
                lang[own] = np.array(model.languages, dtype=object)[best]
                score[own] = 1 / np.exp((least[:, None] - cross) * np.minimum(size[own], 50)[:, None]).sum(axis=1)
                entropy[own] = least
                out[own] = least > model.cutoff[best] + 4 * model.spread[best] / np.sqrt(size[own])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(size), pa.array(out), *(part.column(f"keep_{c}") for c in keep)],
                ["doc_id", "lang_pred", "score", "entropy", "n_chars", "rejected", *(f"kept_{c}" for c in keep)],
            )

    rows = _text.bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    extra = "".join(f", kept_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, entropy double, n_chars long, rejected boolean{extra}")
