import random
import re
import time

import pytest

from tallyweave.llm import pii
from tests.llm.helpers import awkward, docs, prose

WORDS = "zero one two three four five six seven eight nine".split()


def found(text):
    return [(f[0], f[4]) for f in pii.identifiers(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail joe.b+x@mail.example.com.", ("email", "joe.b+x@mail.example.com")),
        ("mail joe (at) example [dot] com now", ("email", "joe@example.com")),
        ("jane dot doe at mail dot example dot org bye", ("email", "jane.doe@mail.example.org")),
        ("ｊоe@ехample.com", ("email", "joe@example.com")),
        ("j​oe @ example.com", ("email", "joe@example.com")),
        ("joe@example dot com", ("email", "joe@example.com")),
        ("john\tat\texample\tdot\tcom", ("email", "john@example.com")),
        ("john at\r\nexample dot com", ("email", "john@example.com")),
        ("john\u00a0at example\u00a0dot com", ("email", "john@example.com")),
        ("(x dot john.k AT host.example DOT org)", ("email", "x.john.k@host.example.org")),
        ("a" * 70 + "@example.com", ("email", "a" * 70 + "@example.com")),
        ("five five five\nzero one two three four five six", ("phone", "5550123456")),
        ("call five five five, zero one two three four five six ok", ("phone", "5550123456")),
        ("ring +1 (017) 555-7713 now", ("phone", "+1 (017) 555-7713")),
        ("at 144.137.247.239 we", ("ip", "144.137.247.239")),
        ("card 4111-1111-1111-1111.", ("card", "4111-1111-1111-1111")),
        ("card ４１１１１１１１１１１１１１１１", ("card", "4111111111111111")),
        ("ssn 123-45-6789", ("ssn", "123-45-6789")),
        ("iban GB82 WEST 1234 5698 7654 32", ("iban", "GB82 WEST 1234 5698 7654 32")),
        ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")),
    ],
)
def test_finds(text, want):
    assert found(text) == [want]


@pytest.mark.parametrize("text", ["", "the man at the door", "one two", "9807915762804491", "256.1.1.1", "version 1.2.3", "000-12-3456", "GB83 WEST 1234 5698 7654 32", "meet at noon dot", "12345", "a@b", "it cost one hundred"])
def test_leaves_alone(text):
    assert found(text) == []


def test_offsets_come_back_to_the_source():
    """Disguised identifiers in noise: the surface is the disguise, wherever it is."""
    r = random.Random(3)
    for k in range(200):
        local, host = f"u{r.randrange(10**6)}", f"h{r.randrange(10**4)}.example.org"
        digits = "".join(r.choice("23456789") for _ in range(10))
        at, dot = r.choice([("@", "."), (" (at) ", " [dot] "), (" at ", " dot "), ("[AT]", "{dot}")])
        plain = f"{local}@{host}"
        mail = plain.replace("@", at).replace(".", dot)
        phone = " ".join(WORDS[int(d)] for d in digits)
        glyphs = mail.replace("e", "е") if k % 2 else mail
        before, middle = f"ñ {prose(k, 5)} é, ", f" und {prose(k + 1, 4)}: "
        text = before + glyphs + middle + phone + " ende"
        got = {f[0]: f for f in pii.identifiers(text)}
        assert got["email"][4] == plain and got["email"][1:4] == (len(before), len(before) + len(glyphs), glyphs)
        start = len(before) + len(glyphs) + len(middle)
        assert got["phone"][4] == digits and got["phone"][1:4] == (start, start + len(phone), phone)


_PIECES = ["at", "dot", "@", "(at)", "[dot]", "example.com", "joe", "x", ".", "a.b", "token =", "abcdefabcdef"]


def _noise(r, n=9, more=()):
    """Pieces of disguises with all sorts of blanks between them."""
    return "".join(r.choice([*_PIECES, *more]) + r.choice([" ", " ", " ", "\t", "\r\n", "\n", "\u00a0", "  ", ", "]) for _ in range(n))


def test_gate_hides_nothing(monkeypatch):
    """What the quick gate lets pass by has nothing for the detectors."""
    r = random.Random(8)
    for _ in range(3000):
        text = _noise(r, 9, ("five", "six", "one", "555-0123"))
        got = pii.identifiers(text)
        with monkeypatch.context() as m:
            m.setattr(pii, "_worthwhile", lambda low, words: True)
            assert pii.identifiers(text) == got
        for _, a, b, surface, _ in got:
            assert text[a:b] == surface


_PLAIN_AT_DOT = re.compile(r"(?<![\w.+-])((?:(?!at\b)[\w+-]+\s+dot\s+(?!at\s))*[\w.+-]+)(\s+at\s+|\s*@\s*)((?!at\s)[\w-]+(?:\.[\w-]+)*)((?:\s+dot\s+(?!at(?![^\s@]))[\w-]+)+)(?![\w-])", re.I)
_DOT = re.compile(r"\s+dot\s+", re.I)


def _plain(text):
    """The same finds the slow way: one pattern for addresses in words, no gate, every find against every other."""
    source = list(range(len(text) + 1))

    def replaced(t, where, edits):
        for a, b, new in reversed(edits):
            t, where = t[:a] + new + t[b:], where[: a + len(new)] + where[b:]
        return t, where

    text_, where = text.replace("\u00a0", " "), source
    for m in reversed([*re.finditer(r"\s*[\[({<]\s*(at|@|dot)\s*[\])}>]\s*", text_, re.I)]):
        if m.start() and m.end() < len(text_) and text_[m.start() - 1].isalnum() and text_[m.end()].isalnum():
            text_, where = replaced(text_, where, [(m.start(), m.end(), "." if m[1].lower() == "dot" else "@")])
    edits = []
    for m in _PLAIN_AT_DOT.finditer(text_):
        edits += [(d.start(), d.end(), ".") for g in (1, 4) for d in _DOT.finditer(text_, *m.span(g))] + [(*m.span(2), "@")]
    text_, where = replaced(text_, where, sorted(edits))
    text_, where = replaced(text_, where, [(m.start(), m.end(), "@") for m in re.finditer(r"(?<=[\w.+-])(?: @ ?|@ )(?=[\w-]+(?:\.[\w-]+)+)", text_)])
    return {text_[m.start() : m.end()].lstrip(".%+-") for m in re.finditer(r"[A-Za-z0-9._%+-]*[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", text_)}


def test_addresses_like_the_plain_way():
    r = random.Random(5)
    seen = 0
    for _ in range(6000):
        text = _noise(r, 8)
        got = {v for k, v in found(text) if k == "email"}
        assert got == _plain(text), repr(text)
        seen += len(got)
    assert seen > 100


@pytest.mark.parametrize("text", [" " * 1_000_000, "( " + " " * 1_000_000, "(at" * 300_000, "[ " * 400_000, "dot " * 250_000, "a dot " * 150_000 + "at x", "joe@example.com " * 60_000, "a" * 1_000_000 + "@x", "one " * 250_000, "token " + " " * 1_000_000])
def test_time_in_proportion(text):
    began = time.perf_counter()
    pii.identifiers(text)
    assert time.perf_counter() - began < 10


def test_query_like_each_text_alone(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted({(r["doc_id"], *f) for r in rows for f in pii.identifiers(r["text"])})
    assert sorted(tuple(r) for r in pii.op2_pii_spans(spark, "/root/testdata/sf0.001").collect()) == want and want


def test_table(spark):
    long = "w " * 40_000 + "joe@example.com"
    d = docs(spark, [(1, long), (2, None), (None, "joe@example.com"), (3, ""), (4, "a@example.com b@example.com"), (4, "a@example.com b@example.com")])
    got = sorted((r["doc_id"], r["start"], r["value"]) for r in pii.spans(d).collect())
    assert got == [(1, 80_000, "joe@example.com"), (4, 0, "a@example.com"), (4, 14, "b@example.com")]
    assert pii.spans(awkward(spark)).count() == 0 and pii.spans(docs(spark, [])).count() == 0


def test_plain_emails_like_a_simple_pattern(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    simple = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    for r in texts:
        assert [v for k, v in found(r["text"]) if k == "email"] == simple.findall(r["text"])
