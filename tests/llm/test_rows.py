"""Operators that work row by row, against plain searches and the tokenizer itself."""

from __future__ import annotations

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import _text, _tokens, packing, pii, secrets, token_files
from tests.llm.common import clashing, corpus, frame, sha, words


def emails(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789 .-+@ab(B)%:/é", max_size=80))
def test_pii_equals_plain_search(text):
    assert [x for x in pii.find(text, pii._automaton()) if x[0] in pii.BASE_KINDS] == emails(text)


def test_pii_added_kinds():
    found = pii.find("see https://me:pw@host.de and IBAN DE89 3704 0044 0532 0130 00. http://a.b/c", pii._automaton())
    assert [k for k, _, _ in found if k in pii.ADDED_KINDS] == ["login", "account"]


def test_pii_accounts_and_logins_of_any_length():
    automaton = pii._automaton()
    added = lambda text: [(k, text[a:b]) for k, a, b in pii.find(text, automaton) if k in pii.ADDED_KINDS]
    number = "DE89 3704 0044 0532 0130 00"
    for between in (" ", ", ", "\n", " AND "):
        assert added("IBAN: " + between.join([number] * 9)) == [("account", number)] * 9
    for cue in ("Iban", "ACCOUNT", "Konto", "KONTONUMMER", "compte", "Cuenta"):
        assert added(f"{cue} {number}.") == [("account", number)]
    assert added("account " + "x" * 60 + f" {number}") == [("account", number)]
    assert added("account " + "x" * 90 + f" {number}") == [] and added(f"IBAN {number[:-1]}1") == []
    for user, password, host in (("u" * 3000, "p", "h.de"), ("u", "p" * 3000, "h.de"), ("u", "p", "h" * 3000)):
        url = f"https://{user}:{password}@{host}"
        assert added(f"see {url} there") == [("login", url)]


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6 + "@", "a://" * 250_000, "1." * 500_000, "a@" * 500_000, "+1" * 500_000, "1 " * 500_000, "iban" * 250_000])
def test_pii_of_very_long_runs(text):
    """Texts of a million characters take a second or so; plain searches of some of these would take hours."""
    began = time.process_time()
    found = pii.find(text, pii._automaton())
    assert time.process_time() - began < 10
    assert found == ([("ip", i, i + 7) for i in range(0, 10**6 - 7, 8)] if text.startswith("1.") else [])


def test_pii_rows(spark):
    text = "mail a.b@c.de, 4111 1111 1111 1111 or +49 (30) 123-4567 at 10.0.0.1 and 300.1.1.1"
    rows = [(1, text, None, None, 0), (2, None, None, None, 0), (1, text, None, None, 0)]
    out = pii.pii(frame(spark, rows)).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out] == [(1, 1, 1, 1), (1, 1, 1, 1), (0, 0, 0, 0)]
    assert out[2].base_sha256 == sha("") and out[2].spans == ""
    assert pii.pii(frame(spark, [])).count() == 0
    assert pii.pii(clashing(spark)).count() == len(corpus())


def plain_secrets(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


SECRETS = ["token=abcdefgh secret: token: abcdefg", "API_KEY : 'x' apikey=\"ABC_def.123\"", f"AKIA{'A1' * 10} AKIAX", "0123456789abcdef01234567 " + "a" * 23, None, "", "PassWord = longenough1, Secret=short"]


def test_secrets_equal_plain_search(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(SECRETS + SECRETS[:3])]
    out = {r.doc_id: r for r in secrets.secrets(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        expected = plain_secrets(text or "")
        assert out[i].base_sha256 == sha(",".join(x[2] for x in expected))
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(x[1] == k for x in expected) for k in range(3))


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = [(i, t, None, None, 0) for i, t in enumerate(["token=abcdefgh", "token=abcdefgh", "nothing"])]
    secrets.secrets(frame(spark, rows), ledger)
    known = spark.read.schema(secrets.LEDGER_SCHEMA).parquet(ledger)
    assert known.count() == 2  # two blobs under three paths
    assert secrets.scan_new(secrets.versions(frame(spark, rows)), known).count() == 0
    changed = secrets.RULES | {"hex": (2, secrets.RULES["hex"][1])}
    again = secrets.scan_new(secrets.versions(frame(spark, rows)), known, changed).collect()
    assert {tuple(r.rules) for r in again} == {("hex@2",)}
    more = [*rows, (9, "secret=newvalue1", None, None, 0)]
    out = {r.doc_id: r.n_assign for r in secrets.secrets(frame(spark, more), ledger).collect()}
    assert out == {0: 1, 1: 1, 2: 0, 9: 1}
    assert secrets.secrets(frame(spark, [])).count() == 0
    assert secrets.secrets(clashing(spark)).count() == len(corpus())


ODD = [None, "", "don't it's <|endoftext|>foo İ x\x1cy , — a—b 12 3a (abc), It's", "á é é", "x y z", "''s 're", "日本 語。", "ﬁ ﬁ Ⅻ", "a" * 3000]


def test_ids_are_the_tokenizer_s(spark):
    path = _tokens.default_path()
    tokenizer, _ = _tokens._tokenizer(path)
    rng = random.Random(1)
    mixed = ["".join(rng.choice("abcDEÉß,.!'- \n\t12«é") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts = ODD + [r[1] for r in corpus()] + mixed
    ids, bounds = _tokens.encode(pa.array(texts), path, 7)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 7]


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert _tokens._by_word(_tokens.default_path()) and not _tokens._by_word(path)
    texts = ["a b  c", None, "", " one two\n\nthree"]
    ids, bounds = _tokens.encode(pa.array(texts), path, 7)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 7]


def test_token_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "tokens")
    tokenizer, _ = _tokens._tokenizer(_tokens.default_path())
    rows = corpus()
    for encoding in ("dictionary", "delta"):
        token_files.write_tokens(clashing(spark), f"{path}-{encoding}", encoding=encoding, row_group_mb=1, page_rows=20)
        got = {r.doc_id: (r.start, r.n_tokens, list(r.ids)) for r in token_files.read_tokens(spark, f"{path}-{encoding}").collect()}
        start = 0
        for i, text, *_ in sorted(rows):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            assert got[i] == (start, len(ids), ids)
            start += len(ids)
    crc = {r.doc_id: r.ids_crc32 for r in token_files.with_checksums(token_files.read_tokens(spark, f"{path}-delta")).collect()}
    assert all(crc[i] == zlib.crc32(np.array(got[i][2], "<u4").tobytes()) for i in got)
    part = token_files.read_tokens(spark, f"{path}-dictionary", "doc_id = 3")
    assert [r.doc_id for r in part.collect()] == [3]
    assert "ids" not in token_files.read_metadata(spark, f"{path}-dictionary").columns
    token_files.write_tokens(frame(spark, []), f"{path}-none")
    assert token_files.read_tokens(spark, f"{path}-none").count() == 0


def test_token_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_tokens(frame(spark), str(tmp_path / "t"), partitions=1)
    file = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    column = [pq.ParquetFile(file).metadata.row_group(0).column(i) for i in range(5)]
    ids = next(c for c in column if c.path_in_schema.startswith("ids"))
    assert any("DICT" in e for e in ids.encodings) and ids.has_offset_index and ids.has_column_index


def test_pieces_and_sequences(spark):
    tokenizer, _ = _tokens._tokenizer(_tokens.default_path())
    packed = packing.pack(packing.cut(clashing(spark), capacity=512), capacity=512)
    out = packed.toPandas()
    for i, text, *_ in corpus():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = out[out.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(-(-len(ids) // 512)))
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and list(r.ids) == part
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in token_files.with_checksums(packed).collect()}
    assert crc == {(r.doc_id, r.piece): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out.itertuples()}
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for k, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(whole[k].ids) == [x for ids in own.ids for x in ids] and whole[k].n_tokens == own.length.sum()
        assert [(d.doc_id, d.piece, d.offset) for d in whole[k].documents] == list(zip(own.doc_id, own.piece, own.offset, strict=True))
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 512
    assert out.sequence_id.nunique() <= out.length.sum() / 512 * 1.1 + 1
    assert packing.pack(packing.cut(frame(spark, []))).count() == 0
    twice = frame(spark, [(1, "a b", None, None, 0), (1, "a b", None, None, 0), (None, None, None, None, 0)])
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in packing.pack(packing.cut(twice)).collect()) == [(0, 0, 1), (1, 0, 3), (1, 0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 20))
def test_best_fit_bins(lengths, open_bins):
    place, offset = packing.best_fit(lengths, 64, open_bins)
    used: dict[int, int] = {}
    for n, k, at in zip(lengths, place, offset, strict=True):
        assert at == used.get(k, 0)
        used[k] = at + n
    assert all(v <= 64 for v in used.values())


def test_best_fit_takes_the_fullest():
    assert packing.best_fit([40, 50, 14, 24], 64, 9)[0] == [0, 1, 1, 0]
    assert packing.best_fit([40, 50, 14], 64, 1)[0][:2] == [0, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\n,", max_size=30), max_size=6))
def test_word_hashes(texts):
    data, offsets = _text.column_bytes(pa.array(texts, pa.string()))
    starts, ends, first = _text.words(data, offsets)
    hashed = _text.hashes(data, starts, ends)
    found = [hashed[first[i] : first[i + 1]].tolist() for i in range(len(texts))]
    assert found == [[_text.word_hash(w) for w in words(t)] for t in texts]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 511, 513, 2000])
def test_long_words_hash_alike(n):
    for shift in (0, 3):
        data = np.frombuffer(b"#" * shift + b"x" * n + b"#", dtype=np.uint8)
        assert int(_text.hashes(data, np.array([shift]), np.array([shift + n]))[0]) == _text.word_hash("x" * n)
