"""Personal data in whole texts by anchor expansion.

An Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits, URL schemes, account cues) in one pass. From
each, the stretch of characters that its kind can hold is expanded to both sides; a deterministic parser runs only
within it and validates what it finds. No match of a kind can leave such a stretch or lie in none, so the result is that
of a search through the whole text. Each parser reads a stretch once, so the time grows with the text's length, whatever
it holds.

Base kinds are email, ip, card and phone; the method adds ``login`` (user and password in a URL) and ``account``
(IBAN with valid check digits).
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import _text

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("login", "account")

#: What follows the at-sign; the local part is what an address can hold to the left of it.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Whole digit runs only, and no way back into one: a search that starts within a run fails where this one has failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@[^\s/@]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: Words, in any case and within longer words, that say that an account number follows; it starts at most ACCOUNT_REACH
#: characters after one of them, or after another valid number.
ACCOUNT_CUES, ACCOUNT_REACH = ("iban", "account", "konto", "compte", "cuenta"), 80
#: Characters that _IBAN takes at most.
_IBAN_SPAN = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER_RUN = frozenset("0123456789 .-")
_NUMBER_RIGHT = re.compile(r"[0-9 .-]*")


def luhn(digits: str) -> bool:
    """Whether the Luhn checksum of the digits holds."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an IBAN hold."""
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _accounts(text: str, at: int) -> Iterator[tuple[int, int]]:
    """Spans of the account numbers from ``at`` on, each within reach of ``at`` or of the one before.

    Of the ends that a run of groups offers (before anything but a letter or digit) the last one with valid check digits counts, so the
    next number or a word in capitals does no harm.
    """
    reach = at + ACCOUNT_REACH
    while m := _IBAN.search(text, at, min(len(text), reach + _IBAN_SPAN)):
        start, end = m.span()
        if start >= reach:
            return
        while end - start >= 15 and not ((end == len(text) or not (text[end].isascii() and text[end].isalnum())) and text[end - 1] != " " and iban(text[start:end])):
            end -= 1
        if end - start >= 15:
            yield start, end
            at, reach = end, end + ACCOUNT_REACH
        else:
            at = start + 1


def _left(text: str, at: int, run: frozenset, least: int) -> int:
    while at > least and text[at - 1] in run:
        at -= 1
    return at


def find(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by kind as listed, then start; code points, end exclusive."""
    email, ip, card, phone, login, account = [], [], [], [], [], []
    email_to = number_to = login_to = account_to = 0
    for at, what in automaton.iter(text):
        if what == "digit":
            if at < number_to:
                continue
            # A stretch of digits, dots, blanks and hyphens; no address, card or digit group reaches beyond it.
            start, number_to = _left(text, at, _NUMBER_RUN, number_to), _NUMBER_RIGHT.match(text, at).end()
            if number_to - at < 6:
                continue
            for m in _IP.finditer(text, start, number_to):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    ip.append(("ip", m.start(), m.end()))
            if number_to - at < 16:
                continue
            for m in _CARD.finditer(text, start, number_to):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    card.append(("card", m.start(), m.end()))
        elif what == "@":
            # Neither scan passes another at-sign, so all of them together read the text about twice.
            start, m = _left(text, at, _LOCAL, email_to), _DOMAIN.match(text, at + 1)
            if m and start < at:
                email_to = m.end()
                email.append(("email", start, email_to))
        elif what == "+":
            m = _PHONE.match(text, at)
            if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                phone.append(("phone", m.start(), m.end()))
        elif what == "scheme":
            start = at - 2
            while start > login_to and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            while start < at - 2 and not text[start].isalpha():
                start += 1
            # The parser stops at a blank by itself, so nothing is cut however long a part is.
            m = _LOGIN.match(text, start) if start < at - 2 else None
            if m:
                login.append(("login", m.start(), m.end()))
                login_to = m.end()
        else:  # an account cue: the number follows within a few words
            for start, account_to in _accounts(text, max(at + 1, account_to)):
                account.append(("account", start, account_to))
    return [*email, *ip, *card, *phone, *login, *account]


def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for d in "0123456789":
        automaton.add_word(d, "digit")
    automaton.add_word("@", "@")
    automaton.add_word("+", "+")
    automaton.add_word("://", "scheme")
    for cue in ACCOUNT_CUES:
        for letters in itertools.product(*zip(cue, cue.upper(), strict=True)):
            automaton.add_word("".join(letters), "cue")
    automaton.make_automaton()
    return automaton


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every whole text: counts of each base kind, base_sha256 and spans.

    One row for each row of ``docs``, repeated ids included; null text is the empty text. Other columns are not read.
    Account numbers, which are not a base kind, count where they start at most ACCOUNT_REACH (80) characters behind a cue
    or behind another one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for part in _text.slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                found = find(text, automaton) if text else []
                base = [x for x in found if x[0] in BASE_KINDS]
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                rows.append((*(sum(x[0] == k for x in base) for k in BASE_KINDS), hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in found)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    rows = _text.bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
