"""Token ids of whole texts, each distinct word encoded once a batch."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from marketlens.llm import _text

#: Words that are one piece of letters, or one and then one piece of marks: their ids end where a piece ends.
#: U+0130 is left out, since lower-casing it gives a mark of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([,.;:!?()\"-]*)")
#: Blanks that part pieces for the tokenizer as well as here.
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 13]] = False

_loaded: dict[str, tuple] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_word(path: str) -> bool:
    """Whether a text's ids are those of its words one after another; else whole texts have to be encoded.

    So it is if the pre-tokenizer leaves blanks, in any spelling, out of its pieces.
    """
    parts = _tokenizer(path)[0].pre_tokenizer
    return parts is not None and not any(mark in piece for piece, _ in parts.pre_tokenize_str("a bc  d,\n e 1 2") for mark in " \nĠĊ▁")


def _tokenizer(path: str) -> tuple:
    """The tokenizer and a flag per id that says if it ends a piece."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        for token, i in tokenizer.get_vocab().items():
            last[i] = token.endswith("</w>")
        _loaded[path] = tokenizer, last
    return _loaded[path]


#: Words that a Python worker keeps the ids of; when there are more, it begins anew.
KEPT_WORDS = 1_000_000
_kept: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}


def _encode_words(distinct: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some words, one after another, and how many each has."""
    tokenizer, last = _tokenizer(path)
    # A plain word's ids are those of its letters in lower case, then those of its marks; each such piece is encoded once.
    seats: dict[str, int] = {}
    stem, mark, odd = np.full(len(distinct), -1), np.full(len(distinct), -1), []
    for i, m in enumerate(map(_PLAIN.fullmatch, distinct)):
        if m is None:
            odd.append(i)
            continue
        letters, marks = m.groups()
        stem[i] = seats.setdefault(letters.lower(), len(seats))
        if marks:
            mark[i] = seats.setdefault(marks, len(seats))
    ids = np.asarray(tokenizer.encode_batch_fast([" ".join(seats)], add_special_tokens=False)[0].ids, dtype=np.int64)
    cut = np.concatenate([[0], np.flatnonzero(last[ids]) + 1])
    if len(cut) != len(seats) + 1:  # a vocabulary of another kind, without such marks
        stem[:], mark[:], odd, ids, cut = -1, -1, list(range(len(distinct))), ids[:0], np.zeros(1, np.int64)
    rest = [e.ids for e in tokenizer.encode_batch_fast([distinct[i] for i in odd], add_special_tokens=False)]
    more = np.cumsum([0, *map(len, rest)])
    begin, size = np.zeros((len(distinct), 2), dtype=np.int64), np.zeros((len(distinct), 2), dtype=np.int64)
    for k, part in enumerate((stem, mark)):
        has = np.flatnonzero(part >= 0)
        begin[has, k], size[has, k] = cut[part[has]], cut[part[has] + 1] - cut[part[has]]
    begin[odd, 0], size[odd, 0] = len(ids) + more[:-1], np.diff(more)
    pool = np.concatenate([ids, np.fromiter((i for x in rest for i in x), dtype=np.int64)])
    return pool[_spans(begin.ravel(), size.ravel())].astype(np.uint32), size.sum(axis=1)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of all spans in order."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def encode(col: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids in one array, ``end_id`` after each row's, and the n + 1 offsets of the rows.

    Equal to encoding every whole text by itself: where no piece of a tokenizer spans a blank, a text's ids are those of
    its blank-separated words in order; others encode whole texts. Null is the empty text: only the end id.
    """
    if not _by_word(path):
        texts = [t or "" for t in col.to_pylist()]
        each = [[*e.ids, end_id] for e in _tokenizer(path)[0].encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in each for i in x), dtype=np.uint32), np.cumsum([0, *map(len, each)])
    data, offsets = _text.column_bytes(col)
    starts, ends, first = _text.words(data, offsets, _WORD)
    hashed = _text.hashes(data, starts, ends, fold=False)

    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([end_id], np.uint32)
    known, begin, size, pool = _kept.get((path, end_id), empty)
    if len(known) > KEPT_WORDS:
        known, begin, size, pool = empty
    distinct, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
    missing = np.flatnonzero(known[at] != distinct) if len(known) else np.arange(len(distinct))
    if len(missing):
        new, where = distinct[missing], where[missing]
        raw = data.tobytes()
        ids, sizes = _encode_words([raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], path)
        seat = np.searchsorted(known, new)
        known, size = np.insert(known, seat, new), np.insert(size, seat, sizes)
        begin, pool = np.insert(begin, seat, len(pool) + np.cumsum(sizes) - sizes), np.concatenate([pool, ids])
        at = np.searchsorted(known, distinct)
    _kept[path, end_id] = known, begin, size, pool

    # Each row's words, then the end id (the pool's first).
    n = len(offsets) - 1
    count = np.diff(first)
    seat = np.arange(len(hashed)) + np.repeat(np.arange(n), count)
    sizes, places = np.ones(len(hashed) + n, dtype=np.int64), np.zeros(len(hashed) + n, dtype=np.int64)
    sizes[seat], places[seat] = size[at][inverse], begin[at][inverse]
    bounds = np.zeros(n + 1, dtype=np.int64)
    bounds[1:] = np.cumsum(sizes)[np.cumsum(count + 1) - 1] if n else 0
    return pool[_spans(places, sizes)], bounds
