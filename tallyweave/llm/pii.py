"""Identifiers behind disguises, with offsets into the source.

Three transducers rewrite a text, each noting for every output character the source characters it stands for:

1. homoglyphs and full-width forms become ASCII, invisible characters vanish;
2. ``(at)``, ``[dot]``, ``name at host dot org`` and their like become ``@`` and ``.``;
3. runs of spelled digits ("five five five, zero one") become digits.

Detectors then run on the rewritten text and their spans are mapped back: ``start`` and ``end`` are character offsets
such that text[start:end] is ``surface``, which stands for ``value``. Cards must pass the Luhn check, IBANs mod 97,
addresses and numbers their ranges. A local part may have any length. Texts are scanned whole, in time in proportion to
their length whatever they hold (runs of blanks, brackets, addresses or of the word "dot" too).

Defined results: null ids and texts and empty texts give no rows; overlapping finds give way to the first kind in
the order of KINDS, and of one kind to the one that starts first (a tie goes to the shorter); repeated rows of an id
give their finds once; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm.common import id_text, table
from tallyweave.llm.textgrams import slices

KINDS = ("email", "secret", "iban", "card", "ssn", "ip", "phone")

_LOOKALIKE = dict(zip("АВЕКМНОРСТУХІЈЅаеорсухіјѕԁһԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοορνι", "ABEKMHOPCTYXIJSaeopcyxijsdhqwgABEZHIKMNOPTYXooppvi"))
_LOOKALIKE |= {"ν": "v", "ι": "i", "ο": "o", "ρ": "p", "а": "a"}
_LOOKALIKE |= {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@", " ": " ", " ": " ", " ": " "}
for _c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474), *range(0x00B2, 0x00B4), *range(0x2070, 0x208A), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970)]:
    _n = unicodedata.normalize("NFKC", chr(_c))
    if (_d := unicodedata.digit(chr(_c), None)) is not None:
        _n = str(_d)
    if len(_n) == 1 and _n.isascii():
        _LOOKALIKE[chr(_c)] = _n
del _c, _n, _d
_INVISIBLE = "­​‌‍⁠﻿᠎"
_GLYPHS = frozenset(_LOOKALIKE) | frozenset(_INVISIBLE)

_BRACKETED = re.compile(r"[\[({<]\s*+(at|@|dot|\.|punkt|point|arroba|punto)\s*+[\])}>]", re.I)
_PIECE = re.compile(r"@|[^\s@]+")
_LOCAL_PART, _LOCAL_PARTS = re.compile(r"[\w+-]+"), re.compile(r"[\w.+-]+")
_HOST_PART, _HOST_PARTS = re.compile(r"[\w-]+"), re.compile(r"[\w-]+(?:\.[\w-]+)*")
_SPACED_AT = re.compile(r"(?<=[\w.+-])(?: @ ?|@ )(?=[\w-]+(?:\.[\w-]+)+)")

_DIGITS = dict(zero="0", oh="0", one="1", two="2", three="3", four="4", five="5", six="6", seven="7", eight="8", nine="9")
_SPELLED_WORD = "(?:" + "|".join(_DIGITS) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:{_SPELLED_WORD}|\d+)(?:[\s,.-]{{1,3}}(?:{_SPELLED_WORD}|\d+)){{2,}}(?!\w)", re.I)
_TOKEN = re.compile(rf"{_SPELLED_WORD}|\d+", re.I)

_ANY_DIGIT, _OPEN_AT = re.compile(r"\d"), re.compile(r"[\[({<]\s*+(?:at|arroba|@)\s*+[\])}>]")
_SECRET_WORDS = ("token", "secret", "passw", "key")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key)\b\s*+[=:]\s*+[\"']?([A-Za-z0-9_\-+/]{12,})", re.I)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_RUN = re.compile(r"(?<![\w.+-])\d{13,19}(?![\w-])")
_GROUPED = re.compile(r"(?<![\w-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")
_SSN = re.compile(r"(?<![\w-])(\d{3})([ -])(\d{2})\2(\d{4})(?![\w-])")
_IP = re.compile(r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-]|\.\d)")
_PHONE = re.compile(r"(?<![\w.+-])(?:(?:\+\d{1,3}[ .-]?|1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?![\w-])")
_BARE = re.compile(r"(?<![\w.+-])\+?\d{7,12}(?![\w-])")


class Rewritten:
    """A text with, for each of its characters, the source range it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lo: np.ndarray | None = None
        self.hi: np.ndarray | None = None
        self.spelled: np.ndarray | None = None

    def edit(self, edits: list[tuple[int, int, str]], spelled: bool = False) -> None:
        """Replace the ranges, which are in order and apart."""
        if not edits:
            return
        if self.lo is None:
            self.lo = np.arange(len(self.text))
            self.hi = self.lo + 1
            self.spelled = np.zeros(len(self.text), dtype=bool)
        parts, los, his, marks, at = [], [], [], [], 0
        for a, b, new in edits:
            parts += (self.text[at:a], new)
            k = len(new)
            los += (self.lo[at:a], np.full(k, self.lo[a]))
            his += (self.hi[at:a], np.full(k, self.hi[b - 1]))
            marks += (self.spelled[at:a], np.full(k, spelled))
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.lo, self.hi = np.concatenate([*los, self.lo[at:]]), np.concatenate([*his, self.hi[at:]])
        self.spelled = np.concatenate([*marks, self.spelled[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.lo is None else (int(self.lo[a]), int(self.hi[b - 1]))

    def was_spelled(self, a: int, b: int) -> bool:
        return self.spelled is not None and bool(self.spelled[a:b].any())


_SEPARATORS = str.maketrans(",.-", "   ")


def _worthwhile(low: str, words: set[str]) -> bool:
    """False only where no detector or transducer could find anything. ``words`` are those of ``low``."""
    if "@" in low or _ANY_DIGIT.search(low) or not _DIGITS.keys().isdisjoint(words) or _OPEN_AT.search(low):
        return True
    return "dot" in words and "at" in words or any(map(low.__contains__, _SECRET_WORDS)) and _SECRET.search(low) is not None


def _undone_brackets(text: str) -> list[tuple[int, int, str]]:
    """``(at)`` and ``[dot]`` between letters or digits, with the blanks around them, to ``@`` and ``.``."""
    edits, done = [], 0
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        if a > done and b < len(text) and text[a - 1].isalnum() and text[b].isalnum():
            edits.append((a, b, "@" if m[1].lower() in ("at", "@", "arroba") else "."))
        done = b
    return edits


def _undone_words(text: str) -> list[tuple[int, int, str]]:
    """``name dot name at host dot org`` and ``name @ host dot org`` to an address.

    From each ``at`` or ``@`` the pieces are followed outwards, to the next one at most, so each is met twice at most.
    """
    pieces = [m.span() for m in _PIECE.finditer(text)]
    said = [text[a:b].lower() if b - a <= 3 else "" for a, b in pieces]
    n = len(pieces)
    parted = [k == 0 or pieces[k - 1][1] < pieces[k][0] for k in range(n)] + [True]  # a blank before the piece

    def dotted(k: int) -> bool:
        """Whether piece k is a ``dot`` between two pieces that a walk may take."""
        return 0 < k < n - 1 and said[k] == "dot" and parted[k] and parted[k + 1] and said[k - 1] not in ("at", "@") and said[k + 1] not in ("at", "@")

    def ends_a_name(k: int) -> bool:
        lo, at = pieces[k]
        end = at
        while at > lo and (text[at - 1].isalnum() or text[at - 1] in "_+-"):
            at -= 1
        return at < end and not (at > lo and text[at - 1] == ".")

    edits: list[tuple[int, int, str]] = []
    free = 0  # the first piece that no address has taken
    for k in range(1, n - 1):
        if k - 1 < free or not (said[k] == "@" or said[k] == "at" and parted[k] and parted[k + 1]):
            continue
        last = text[pieces[k - 1][1] - 1]
        if not (last.isalnum() or last in "_.+-") or not _HOST_PARTS.fullmatch(text, *pieces[k + 1]):
            continue
        right, j = [], k + 1
        while dotted(j + 1) and _HOST_PART.match(text, *pieces[j + 2]):
            right.append((pieces[j][1], pieces[j + 2][0], "."))
            j += 2
            if not _HOST_PART.fullmatch(text, *pieces[j]):
                break
        if not right:
            continue
        left, i = [], k - 1
        while i - 2 >= free and dotted(i - 1) and (_LOCAL_PARTS if i == k - 1 else _LOCAL_PART).fullmatch(text, *pieces[i]) and ends_a_name(i - 2):
            left.append((pieces[i - 2][1], pieces[i][0], "."))
            i -= 2
        edits += [*reversed(left), (pieces[k - 1][1], pieces[k + 1][0], "@"), *right]
        free = j + 1
    return edits


def rewrite(text: str) -> Rewritten:
    r = Rewritten(text)
    if not text.isascii() and (there := _GLYPHS.intersection(text)):
        r.edit([(m.start(), m.end(), _LOOKALIKE.get(m[0], "")) for m in re.finditer("[" + re.escape("".join(sorted(there))) + "]", text)])
    low = r.text.lower()
    words = set(low.translate(_SEPARATORS).split())
    if not _worthwhile(low, words):
        r.text = ""
        return r
    if any(c in r.text for c in "[({<"):
        r.edit(_undone_brackets(r.text))
    if "dot" in words:
        r.edit(_undone_words(r.text))
    if "@ " in r.text:
        r.edit([(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(r.text)])
    if not _DIGITS.keys().isdisjoint(words):
        edits = []
        for m in _SPELLED.finditer(r.text):
            tokens = _TOKEN.findall(m[0])
            if sum(not t.isdigit() for t in tokens) >= 2:
                edits.append((m.start(), m.end(), "".join(_DIGITS.get(t.lower(), t) for t in tokens)))
        r.edit(edits, spelled=True)
    return r


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _finds(r: Rewritten) -> Iterator[tuple[str, int, int]]:
    t = r.text
    at = t.find("@")
    while at >= 0:
        lo = at
        while lo and t[lo - 1] in _LOCAL:
            lo -= 1
        while lo < at and t[lo] in ".%+-":
            lo += 1
        if lo < at and (b := _HOST.match(t, at + 1)):
            yield "email", lo, b.end()
        at = t.find("@", at + 1)
    for m in _SECRET.finditer(t) if any(map(t.lower().__contains__, _SECRET_WORDS)) else ():
        yield "secret", *m.span(1)
    if not _ANY_DIGIT.search(t):
        return
    for m in _IBAN.finditer(t):
        v = m[0].replace(" ", "")
        if 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1:
            yield "iban", *m.span()
    for pattern in (_RUN, _GROUPED):
        for m in pattern.finditer(t):
            v = re.sub(r"\D", "", m[0])
            if v[0] != "0" and luhn(v):
                yield "card", *m.span()
    for m in _SSN.finditer(t):
        if m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000":
            yield "ssn", *m.span()
    for m in _IP.finditer(t):
        yield "ip", *m.span()
    for m in _PHONE.finditer(t):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", *m.span()
    if r.spelled is not None:
        for m in _BARE.finditer(t):  # plain digits are any number; spelled ones are a disguise
            if r.was_spelled(*m.span()):
                v = m[0].lstrip("+")
                yield ("ssn" if len(v) == 9 else "phone"), *m.span()


def identifiers(text: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, surface, value) of the identifiers in ``text``, by position."""
    r = rewrite(text)
    if not r.text:
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in _finds(r):
        found.setdefault(kind, []).append((a, b))
    out = []
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for kind in KINDS:
        starts, mine, last = [a for a, _ in taken], [], 0
        for a, b in sorted(found.get(kind, ())):
            k = bisect_right(starts, a)
            if a < last or k and taken[k - 1][1] > a or k < len(taken) and starts[k] < b:
                continue
            last = b
            mine.append((a, b))
            lo, hi = r.source(a, b)
            out.append((kind, lo, hi, text[lo:hi], r.text[a:b]))
        taken = sorted(taken + mine)
    return sorted(out, key=lambda f: (f[1], f[2]))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("value", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in identifiers(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, surface, value): one pass, and a shuffle of the few finds to drop repeated rows."""
    found = id_text(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, kind string, start long, end long, surface string, value string")
    return found.distinct()


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
