"""Scores of texts by a hidden Markov language model, and by add-one word counts.

Words are counted over all training texts. The model's latent states emit word classes: each of the commonest words is
a class, all other words fall into classes by their hash, and within such a class a word has its add-one share of the
class's counts. States, transitions and emissions are trained by Baum-Welch: each task runs forward and backward over
its texts and adds up expected counts, which are summed across tasks in steps. The states begin apart, as clusters of
classes that have like neighbours. A text's score is its exact log probability by the scaled forward recursion over the
whole text.

Long texts are worked on in segments at once without a loss: the product of a segment's step matrices carries the state
before it to the state behind it, so each segment gets what the whole recursion has at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import _scratch, _sums, _text

#: The hash that stands for the end of a text.
END = 0
#: Words whose counts every task holds (16 bytes each); the counts of rarer words are joined by a shuffle.
HELD_WORDS = 1 << 17
#: Distinct words that a task gathers before it sends their counts on.
GATHERED = 1_500_000
#: Texts of more than LONG tokens are worked on in segments; what comes out is that of the whole text.
LONG, SEGMENT = 4096, 1024
#: Tokens whose states' shares are added up by class at once, so that they stay in a processor's cache.
CHUNK = 1 << 14
#: Dimensions in which the neighbours of a class, on either side, are summed up to find the first states.
TRAITS = 24
#: Parts in which a round of training takes the texts, by hash; and the part of the texts that are held out.
PARTS, HELD_OUT = 6, -1


@dataclass
class Classes:
    """held: sorted word hashes, with count and class of each; other words: class ``first_bucket + hash mod buckets``."""

    held: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    first_bucket: int
    buckets: int
    #: log10 of 1 for a class of one word, of its counts, its words and one more for a class of many
    share: np.ndarray
    unigram: np.ndarray


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class, state
    #: what each round of training gained on held-out texts (natural log, a token)
    gains: tuple[float, ...] = ()


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, END after each row's, and the n + 1 offsets of the rows."""
    data, offsets = _text.column_bytes(part.column("text"))
    starts, ends, first = _text.words(data, offsets)
    hashed = _text.hashes(data, starts, ends)
    hashed[hashed == END] = 1
    return np.insert(hashed, first[1:], END), first + np.arange(len(first))


def count_words(docs: DataFrame) -> DataFrame:
    """token (hash) and n over all texts, the ends included; each task sends a row a distinct word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in _text.slices(batches):
            new, n = np.unique(_tokens(part)[0], return_counts=True)
            both, inverse = np.unique(np.concatenate([words, new]), return_inverse=True)
            words, counts = both, np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            if len(words) > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["token", "n"])
                words, counts = words[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["token", "n"])

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def make_classes(counts: DataFrame, singles: int = 4096, buckets: int = 256) -> Classes:
    """Word classes from all counts: at most HELD_WORDS counts are gathered, whatever the input's size."""

    def least(most: int) -> int:
        """The smallest count that at most ``most`` words have or exceed."""
        level = F.floor(F.log2("n") * 16).cast("int")  # a few hundred levels
        total, out = 0, 1 << 62
        for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
            total += r.words
            if total > most:
                break
            out = r.n
        return out

    held = counts.where(F.col("n") >= least(HELD_WORDS)).toPandas()
    words, n = held.token.to_numpy(np.int64).view(np.uint64), held.n.to_numpy(np.int64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    top = np.lexsort((words, -n))
    top = top[words[top] != END][:singles]
    first = len(top)
    kinds = (first + words % np.uint64(buckets)).astype(np.int64)
    kinds[top] = np.arange(first)
    kinds[words == END] = first + buckets
    # Counts and words of each class of many: all words less those with a class of their own.
    bucket = F.pmod(F.col("token"), F.lit(buckets)).cast("int")  # 2**64 is a multiple: the same as for the unsigned hash
    total, kinds_in = np.zeros(buckets), np.zeros(buckets)
    for r in counts.where(F.col("token") != END).groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        total[r.b], kinds_in[r.b] = r.n, r.v
    np.subtract.at(total, (words[top] % np.uint64(buckets)).astype(int), n[top])
    np.subtract.at(kinds_in, (words[top] % np.uint64(buckets)).astype(int), 1)
    share = np.zeros(first + buckets + 1)
    share[first : first + buckets] = np.log10(total + kinds_in + 1)
    ends = n[words == END].sum()
    unigram = np.concatenate([n[top], total, [ends]]) + 1.0
    return Classes(words, n, kinds, first, buckets, share, unigram / unigram.sum())


def encode(docs: DataFrame, classes: Classes) -> DataFrame:
    """A number for each row, its classes as bytes, the sums that need no rare word, and its rare words.

    The number is that of the task and of the row in it; it holds for the table as it is stored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        plus = np.log10(c.counts + 1.0)
        before = TaskContext.get().partitionId() << 36
        for part in _text.slices(batches):
            tokens, bounds = _tokens(part)
            distinct, inverse = np.unique(tokens, return_inverse=True)
            at = np.minimum(np.searchsorted(c.held, distinct), max(len(c.held) - 1, 0))
            held = c.held[at] == distinct if len(c.held) else np.zeros(len(distinct), dtype=bool)
            sort = (c.first_bucket + distinct % np.uint64(c.buckets)).astype(np.int64)
            sort[held] = c.kinds[at[held]]
            sort[distinct == END] = c.first_bucket + c.buckets
            log = np.zeros(len(distinct))
            log[held] = plus[at[held]]
            many = (sort >= c.first_bucket) & (sort < c.first_bucket + c.buckets)
            inside = np.where(many, log - c.share[sort], 0.0)
            row = bounds[:-1]
            rare = ~held & (distinct != END)
            is_rare = rare[inverse]
            rares = np.concatenate([[0], np.cumsum(is_rare)])[bounds]
            codes = sort.astype("<u2")[inverse].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(before + np.arange(part.num_rows)),
                    part.column("held_out"),
                    pa.array(np.diff(bounds)),
                    pa.array([codes[2 * a : 2 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()),
                    pa.array(np.add.reduceat(log[inverse], row)),
                    pa.array(np.add.reduceat(inside[inverse], row)),
                    pa.array(np.add.reduceat(held[inverse].astype(np.int64), row)),
                    pa.ListArray.from_arrays(pa.array(rares.astype(np.int32)), pa.array(tokens[is_rare].view(np.int64))),
                ],
                ["doc_id", "row", "held_out", "n_tokens", "codes", "log_held", "log_inside", "n_held", "rare"],
            )
            before += part.num_rows

    return docs.mapInArrow(code, f"doc_id {kind}, row long, held_out boolean, n_tokens long, codes binary, log_held double, log_inside double, n_held long, rare array<long>")


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by falling length, and how many rows have a token at each step."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(lengths.max() if len(lengths) else 0), side="left")


def _forward(model: Model, codes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled states behind each row's last token and the log of the scales; ``before`` predicts the first token's state."""
    order, active = _ragged(lengths)
    begin = begin[order]
    kind = model.start.dtype
    total, last, ones = np.zeros(len(order)), np.empty((len(order), len(model.start)), kind), np.ones(len(model.start), kind)
    alpha = before[order].astype(kind)
    for t, n in enumerate(active.tolist()):
        if t:
            last[n : len(alpha)] = alpha[n:]
            alpha = alpha[:n] @ model.move
        alpha = alpha[:n]
        alpha *= model.emit.take(codes.take(begin[:n] + t), axis=0)
        scale = alpha @ ones
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    last[: len(alpha)] = alpha
    out, log = np.empty_like(last), np.empty(len(order))
    out[order], log[order] = last, total
    return out, log


@dataclass
class Segments:
    """Stretches of texts: each one's text, first code and length, the states before it (none for a text's first) and
    the weights of the states behind it (all alike for a text's last); and each text's log probability if asked for."""

    row: np.ndarray
    begin: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    prev: np.ndarray
    after: np.ndarray
    #: log probabilities of the texts of several segments: (text, log)
    known: dict[int, float]


def segments(model: Model, codes: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> Segments:
    """The texts in segments, each with what the recursions over the whole text have at its ends."""
    states = len(model.start)
    pieces = np.where(lengths > LONG, -(-lengths // SEGMENT), 1)
    row = np.repeat(np.arange(len(lengths)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.where(pieces[row] > 1, np.minimum(lengths[row] - piece * SEGMENT, SEGMENT), lengths[row])
    out = Segments(row, begin[row] + piece * SEGMENT, size, piece == 0, np.zeros((len(row), states)), np.ones((len(row), states)), {})
    several = np.flatnonzero(pieces[row] > 1)
    if not len(several):
        return out
    heads, rest = several[out.first[several]], several[~out.first[several]]
    alpha, log = _forward(model, codes, out.begin[heads], size[heads], np.broadcast_to(model.start, (len(heads), states)))
    # From each single state before a segment.
    each = np.repeat(rest, states)
    moved, scales = _forward(model, codes, out.begin[each], size[each], np.tile(model.move, (len(rest), 1)))
    moved, scales = moved.reshape(-1, states, states), scales.reshape(-1, states)
    most = scales.max(axis=1)
    moved = moved * np.exp(scales - most[:, None])[:, :, None]
    seat = dict(zip(rest.tolist(), range(len(rest)), strict=True))
    for h, now, total in zip(heads.tolist(), alpha, log.tolist(), strict=True):
        n = int(pieces[row[h]])
        for k in range(h + 1, h + n):
            out.prev[k] = now
            now = now @ moved[seat[k]]
            total += most[seat[k]] + np.log(now.sum())
            now = now / now.sum()
        behind = np.ones(states)
        for k in range(h + n - 1, h, -1):
            out.after[k] = behind
            behind = moved[seat[k]] @ behind
            behind = behind / behind.max()
        out.after[h] = behind
        out.known[int(row[h])] = total
    return out


def _as(model: Model, kind: type) -> Model:
    return Model(model.start.astype(kind), model.move.astype(kind), model.emit.astype(kind))


def forward(model: Model, codes: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each row's codes: one step a token, over all rows that still have one."""
    long = lengths > LONG
    out = np.empty(len(lengths))
    short = np.flatnonzero(~long)
    out[short] = _forward(model, codes, begin[short], lengths[short], np.broadcast_to(model.start, (len(short), len(model.start))))[1]
    known = segments(model, codes, begin[long], lengths[long]).known
    out[long] = [known[i] for i in range(len(known))]
    return out


def expect(model: Model, codes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, most: int = 1 << 19, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of whole texts, and their log probability; about ``most`` tokens at once.

    The recursions, whose numbers are scaled to 1, are in numbers of ``kind``; sums are in double precision.
    """
    model = _as(model, kind)
    parts = segments(model, codes, begin, lengths)
    states, kinds = len(model.start), len(model.emit)
    starts, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((kinds, states)), 0.0
    # Stretches of like length together: what is worked on at once takes as many steps as its longest one has tokens.
    order = np.argsort(-parts.lengths, kind="stable")
    cuts = np.searchsorted(np.cumsum(parts.lengths[order]), np.arange(most, parts.lengths.sum(), most))
    for own in np.split(order, np.unique(cuts + 1)):
        if len(own):
            a, b, c, d = _expect(model, codes, parts.begin[own], parts.lengths[own], parts.first[own], parts.prev[own].astype(kind), parts.after[own].astype(kind))
            starts, move, emit, log = starts + a, move + b, emit + c, log + d
    return starts, move, emit, log


def _expect(model: Model, codes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, first: np.ndarray, prev: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    order, active = _ragged(lengths)
    begin, first, prev, after = begin[order], first[order], prev[order], after[order]
    states, kind = len(model.start), model.start.dtype
    steps = np.concatenate([[0], np.cumsum(active)])
    # All tokens by step, and by row within one.
    kinds = codes.take(np.concatenate([begin[:n] + t for t, n in enumerate(active.tolist())])) if len(active) else codes[:0]
    emitted, ones = model.emit.take(kinds, axis=0), np.ones(states, kind)
    alphas, scales = np.empty((steps[-1], states), kind), np.empty(steps[-1], kind)
    alpha = np.where(first[:, None], model.start, prev @ model.move)
    for t, n in enumerate(active.tolist()):
        a, b = steps[t], steps[t + 1]
        alpha = np.multiply(alpha[:n] @ model.move if t else alpha, emitted[a:b], out=alphas[a:b])
        scale = np.matmul(alpha, ones, out=scales[a:b])
        alpha /= scale[:, None]
    emitted /= scales[:, None]
    move, starts = np.zeros((states, states)), np.zeros(states)
    gammas, back = alphas.copy(), np.ascontiguousarray(model.move.T)
    beta = np.ones((0, states), kind)
    for t in range(len(active) - 1, -1, -1):
        n, a, b = int(active[t]), steps[t], steps[t + 1]
        if (m := len(beta)) < n:  # rows whose last token this is
            new = after[m:n] / (alphas[a + m : b] * after[m:n]).sum(axis=1, keepdims=True)
            beta = np.concatenate([beta, new])
        gammas[a:b] *= beta
        beta *= emitted[a:b]
        if t:
            move += alphas[steps[t - 1] : steps[t - 1] + n].T @ beta
            beta = beta @ back
        else:
            starts += gammas[a:b][first].sum(axis=0)
            move += prev[~first].T @ beta[~first]
    emit = np.zeros((states, len(model.emit)))
    for c in range(0, len(kinds), CHUNK):
        for of, weights in zip(emit, np.ascontiguousarray(gammas[c : c + CHUNK].T), strict=True):
            of += np.bincount(kinds[c : c + CHUNK], weights=weights, minlength=len(of))
    return starts, move * model.move, emit.T, float(np.log(scales.astype(np.float64)).sum())


def _rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of about ``most`` tokens: the part, all codes, and each row's first code and length."""
    for part in _text.slices(batches, "codes", 2 * most):
        data, offsets = _text.column_bytes(part.column("codes"))
        codes = np.frombuffer(data.tobytes(), dtype="<u2").astype(np.int64)
        yield part, codes, offsets[:-1] // 2, np.diff(offsets) // 2


def _gather(coded: DataFrame, size: int, work, most: int = 1 << 20) -> np.ndarray | None:
    """The sum over all rows of what ``work(codes, begin, lengths)`` gives for parts of them: ``size`` numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, codes, begin, lengths in _rows(batches, most):
            total += work(codes, begin, lengths)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    sums = _sums.sum_arrays(coded.select("codes").mapInArrow(gather, "part int, counts binary"))
    return sums[0] if sums else None


def first_states(coded: DataFrame, classes: Classes, states: int, seed: int = 7) -> np.ndarray:
    """Emissions of states that are clusters of classes with like neighbours on both sides (k-means)."""
    rng = np.random.default_rng(seed)
    kinds = len(classes.unigram)
    traits = coded.sparkSession.sparkContext.broadcast(rng.normal(size=(kinds, TRAITS)))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(kinds * kinds, dtype=np.int32)  # how often each class follows each
        for _, codes, begin, lengths in _rows(batches, 1 << 20):
            inner = np.ones(len(codes), dtype=bool)
            inner[begin + lengths - 1] = False  # the end has no next token
            a = np.flatnonzero(inner)
            np.add.at(many, codes[a] * kinds + codes[a + 1], 1)
        pair = np.flatnonzero(many)
        n, left, right = many[pair].astype(np.float64), pair // kinds, pair % kinds
        of = np.ascontiguousarray(traits.value.T)
        sums = [np.bincount(own, weights=x[other] * n, minlength=kinds) for own, other in ((left, right), (right, left)) for x in of]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate(sums).tobytes()], pa.binary())], ["part", "counts"])

    sums = _sums.sum_arrays(coded.select("codes").mapInArrow(neighbours, "part int, counts binary")).get(0)
    share = np.full((kinds, states), 1 / states)
    if sums is not None:
        at = sums.reshape(2 * TRAITS, kinds).T / (classes.unigram / classes.unigram.min())[:, None]
        at -= np.average(at, axis=0, weights=classes.unigram)
        at /= np.linalg.norm(at, axis=1, keepdims=True) + 1e-12
        weight = np.sqrt(classes.unigram)
        centre = at[rng.choice(kinds, states, replace=kinds < states, p=weight / weight.sum())]
        for _ in range(20):
            own = (at @ centre.T).argmax(axis=1)
            sums = np.stack([np.bincount(own, weights=at[:, d] * weight, minlength=states) for d in range(at.shape[1])], axis=1)
            full = np.bincount(own, minlength=states) > 0
            centre[full] = sums[full] / (np.linalg.norm(sums[full], axis=1, keepdims=True) + 1e-12)
        share = 0.8 * (own[:, None] == np.arange(states)) + 0.2 * rng.dirichlet(np.ones(states), kinds)
    emit = classes.unigram[:, None] * share
    return emit / emit.sum(axis=0)


def train(coded: DataFrame, classes: Classes, states: int = 16, parts: int = PARTS, rounds: int = 20, least_gain: float = 1e-2, seed: int = 7) -> Model:
    """Baum-Welch over all rows of ``coded`` that aren't held out, until a round gains less than ``least_gain``.

    A round takes all texts, a part of them (0 to ``parts`` - 1 in the column ``part``) at a time. The expected counts of each part are kept until the
    part's turn comes again, and after each part the model is that of the counts of all parts, so a round does what as many
    rounds over all texts as there are parts would nearly do, at the cost of one. The gain is that of held-out texts, of
    training texts if none are held out (natural log, a token; 0.01 is 1 % of the perplexity).
    """
    kinds = len(classes.unigram)
    rng = np.random.default_rng(seed)
    move = rng.uniform(0.5, 1.5, (states, states))
    own = coded.where(F.col("part") != HELD_OUT)
    model = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), first_states(own, classes, states, seed))
    spark = coded.sparkSession
    known: list[np.ndarray | None] = [None] * parts
    gains: list[float] = []
    before = -np.inf
    held = coded.where(F.col("part") == HELD_OUT)
    judged = held if held.head(1) else None
    for _ in range(rounds):
        for k in range(parts):
            shared = spark.sparkContext.broadcast(model)

            def counts(codes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, shared=shared) -> np.ndarray:
                starts, moves, emits, log = expect(shared.value, codes, begin, lengths, kind=np.float32)
                return np.concatenate([starts, moves.ravel(), emits.ravel(), [log]])

            sums = _gather(coded.where(F.col("part") == k), states + states * states + kinds * states + 1, counts)
            if sums is None:
                continue
            known[k] = sums
            total = np.sum([x for x in known if x is not None], axis=0)
            starts, moves, emits, log = np.split(total, np.cumsum([states, states * states, kinds * states]))
            starts, moves = starts + 1, moves.reshape(states, states) + 1
            # Every class keeps a little of its frequency in each state, so no text has probability 0.
            emits = emits.reshape(kinds, states)
            trained = log[0] / max(emits.sum(), 1)
            emits = emits + 0.01 * classes.unigram[:, None] * (emits.sum(axis=0) + 1)
            model = Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
        if not any(x is not None for x in known):
            break
        now = trained
        if judged is not None:
            shared = spark.sparkContext.broadcast(model)

            def likelihood(codes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, shared=shared) -> np.ndarray:
                return np.array([forward(_as(shared.value, np.float32), codes, begin, lengths).sum(), lengths.sum()])

            log, tokens = _gather(judged, 2, likelihood)
            now = log / max(tokens, 1)
        if np.isfinite(before):
            gains.append(now - before)
            if gains[-1] < least_gain:
                break
        before = now
    model.gains = tuple(gains)
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 16, rounds: int = 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows where ``held_out`` is not true train the model; all are scored. Null text is the empty text: one token, the
    end. Rows are told apart by a number of their own, so ids may be null or repeated; rows that repeat get equal rows.
    Without training rows every word is unknown and the counts are 0. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = _text.bounded(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    counts = _scratch.stage(count_words(docs.where("not held_out")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    classes = make_classes(counts)
    part = F.when(F.col("held_out"), HELD_OUT).otherwise(F.pmod(F.xxhash64("codes"), F.lit(PARTS)).cast("int"))
    # Each step of the training reads the files of its part alone.
    coded = _scratch.stage(encode(docs, classes).withColumn("part", part), "coded", "part")
    model = train(coded, classes, states, rounds=rounds)

    # Rare words meet their counts; a row's are summed up again.
    words = coded.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    seen = F.coalesce("n", F.lit(0))
    rare = words.groupBy("row").agg(F.sum(F.log10(seen + 1)).alias("rare_log"), F.count_if(seen > 0).alias("rare_known"))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "row", "held_out", "n_tokens", "log_held", "log_inside", "n_held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes, begin, lengths in _rows(batches, 1 << 22):
            log = forward(shared.value, codes, begin, lengths) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(log)], [*columns, "log_classes"])

    inputs = coded.select(*columns, "codes")
    schema = ", ".join(f"{c} {inputs.schema[c].dataType.simpleString()}" for c in columns)
    joined = inputs.mapInArrow(run, f"{schema}, log_classes double").join(rare, "row", "left")
    rest = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_held") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("log_held") + rest - F.col("n_tokens") * float(np.log10(total.n + total.v + 1))).alias("base_score"),
        (F.col("log_classes") + F.col("log_inside") + rest).alias("score"),
    )
