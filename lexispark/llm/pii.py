"""Personal data, also where it is disguised, by offset-preserving normalisation.

Plain detectors find email addresses, IP addresses, card numbers and phone numbers in the text as it is. Then
a chain of transducers rewrites the text, each carrying the span of source
characters that what it emits stands for: look-alike letters and digits of other scripts, zero-width characters, spelled
digits ("four two"), and "at" and "dot" in words or brackets, also mixed with "@" and ".". A plain "at" before
a plain domain is read as "@" only after a name with a dot, digit or underscore, as "look at x.org" is no
address. The detectors run again on the rewritten text, and what they find is mapped back to source spans.
Spans that lie within a plain span are dropped; plain spans stay.

A tape keeps sorted arrays of its edits, and only the ends of what is found are mapped back, by binary search, so memory is in
proportion to the edits. Detectors and transducers take time in proportion to the text: each run of digits, digit words or white space
is looked at a few times at most, and addresses are grown from their "@".

Defined cases: a null text counts as empty and has no spans (and stays null when redacted); an empty table
gives no rows; texts of any length are searched whole; of spans that begin at one place the longest is replaced;
repeated rows are treated alike, and null ids stay; extra columns are ignored by the digest and kept otherwise.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Digit words.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινρ", "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXaoivp", strict=True))
#: Words that stand for "@" and "." when in brackets.
AT_WORDS, DOT_WORDS = ("at", "arroba", "@"), ("dot", "punkt", "point", "punto", ".")
#: Digit words, runs of digits and "plus" in a row from which they are read as digits, if one of them is a word.
LEAST_SPELLED = 7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_QUAD = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ODD = re.compile("[Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९​-‍⁠﻿！-～①-⒛⁰-₉²³¹\U0001d400-\U0001d7ff]")
_BRACKETED = re.compile(r"[\[({<]\s*+(" + "|".join(map(re.escape, AT_WORDS + DOT_WORDS)) + r")\s*+[\])}>]", re.I)
_WORDED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)(?:@|( ++at ++))[A-Za-z0-9-]++((?:(?:\.| ++dot ++)[A-Za-z0-9-]++)++)", re.I)
_AT = re.compile(r" at ++[a-z0-9-]++(?:\.[a-z0-9-]| ++dot )")
_DOT = re.compile(r" ++dot ++", re.I)
_NAMED = re.compile(r"[A-Za-z0-9][._0-9]")
_NUMBER = "|".join(sorted(DIGITS, key=len, reverse=True))
_ITEM = rf"(?:{_NUMBER}|[0-9]++|plus|\+)"
# Runs of items; a start within a run of digits only where a letter forbids its first digit. Nothing is looked at again.
_RUN = re.compile(rf"(?<![A-Za-z])(?:(?![0-9])|(?<![0-9])|(?<=[A-Za-z][0-9])){_ITEM}(?:[\s,.-]{{1,3}}+{_ITEM})++", re.I)
_SPELLED_WORD = re.compile(rf"{_NUMBER}|plus", re.I)
_SPELLED_PART = re.compile(rf"({_NUMBER}|plus|[0-9]+|\+)([\s,.-]*)", re.I)


@dataclass(frozen=True)
class Span:
    """Code points from start to end (exclusive)."""

    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Plain spans by kind, then start."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(Span("email", start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, start if start < at else floor)
        at = text.find("@", max(at + 1, floor))
    quads = [m for m in _QUAD.finditer(text) if m[1]] if "." in text else []
    out += [Span("ip", m.start(), m.end()) for m in quads if all(_small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(Span("card", m.start(), m.end()))
    if "+" in text:
        out += [Span("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


@dataclass
class Tape:
    """A text and where it differs from the source: places in the text and in the source by sorted arrays of edits.

    text[new_start[n]:new_end[n]], a character or nothing, stands for source[old_start[n]:old_end[n]]; between edits the two are
    equal, so a tape holds a few numbers for each edit and none for other characters.
    """

    text: str
    new_start: np.ndarray
    new_end: np.ndarray
    old_start: np.ndarray
    old_end: np.ndarray

    @staticmethod
    def of(text: str) -> Tape:
        none = np.zeros(0, np.int64)
        return Tape(text, none, none, none, none)

    def sources(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source spans that characters first to last (inclusive) stand for; a character of an edit stands for all that it replaces."""
        out = []
        for at, end in ((first, False), (last, True)):
            n = np.searchsorted(self.new_start, at, side="right") - 1
            m = np.maximum(n, 0)
            if not len(self.new_start):
                out.append(at + end)
                continue
            within = (n >= 0) & (at < self.new_end[m])
            # After an edit places are shifted by as much as its ends are apart.
            plain = at + np.where(n >= 0, self.old_end[m] - self.new_end[m], 0) + end
            out.append(np.where(within, self.old_end[m] if end else self.old_start[m], plain))
        return out[0], out[1]

    def untouched(self, places: list[int]) -> bool:
        """Whether each of these characters stands for one of the source."""
        start, end = self.sources(np.array(places, np.int64), np.array(places, np.int64))
        return bool((end - start == 1).all())

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Puts new strings in place of spans of the text; each new character stands for the whole span."""
        if not edits:
            return self
        parts, at = [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            at = b
        start, end = (np.array([e[i] for e in edits], np.int64) for i in (0, 1))
        size = np.array([len(e[2]) for e in edits], np.int64)
        shift = np.cumsum(size - (end - start))
        old_start, old_end = self.sources(start, end - 1)
        # Earlier edits that no later one covers stay, at their new places.
        n = np.searchsorted(start, self.new_start, side="right") - 1
        m = np.maximum(n, 0)
        stay = (n < 0) | (self.new_start >= end[m])
        moved = np.where(n >= 0, shift[m], 0)[stay]
        new_end = end + shift
        # One row for each character that is put in, so that a later edit covers a row or does not; one for an edit that leaves nothing.
        each = np.maximum(size, 1)
        put = np.repeat(new_end - size, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        rows = np.concatenate([np.stack([put, put + np.repeat(size > 0, each), np.repeat(old_start, each), np.repeat(old_end, each)]), np.stack([self.new_start[stay] + moved, self.new_end[stay] + moved, self.old_start[stay], self.old_end[stay]])], axis=1)
        # Of edits that left nothing, several may lie at one place: by the source.
        rows = rows[:, np.lexsort((rows[2], rows[0]))]
        return Tape("".join([*parts, self.text[at:]]), *rows)


def plain_letter(c: str) -> str:
    """A look-alike as the ASCII character that it looks like; empty for zero-width characters."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


def look_alikes(t: Tape) -> Tape:
    return t.rewrite([(m.start(), m.end(), n) for m in _ODD.finditer(t.text) if (n := plain_letter(m[0])) != m[0]])


def spelled_runs(text: str) -> Iterator[list[re.Match]]:
    """The items of each run that is read as digits: its last one is a digit that no letter follows."""
    for m in _RUN.finditer(text):
        items = list(_SPELLED_PART.finditer(text, *m.span()))
        while items and (items[-1][1].lower() in ("+", "plus") or text[items[-1].end(1) : items[-1].end(1) + 1].isalpha() and text[items[-1].end(1)].isascii()):
            items.pop()
        if len(items) >= LEAST_SPELLED and any(_SPELLED_WORD.match(p[1]) for p in items):
            yield items


def spelled_digits(t: Tape) -> Tape:
    edits = []
    for items in spelled_runs(t.text):
        for p in items:
            w = p[1].lower()
            edits.append((p.start(), p.end() if p is not items[-1] else p.end(1), DIGITS.get(w, "+" if w == "plus" else w)))
    return t.rewrite(edits)


def bracketed(t: Tape) -> Tape:
    edits, floor = [], 0
    for m in _BRACKETED.finditer(t.text):
        start, end = m.span()
        while start > floor and t.text[start - 1].isspace():
            start -= 1
        while end < len(t.text) and t.text[end].isspace():
            end += 1
        edits.append((start, end, "@" if m[1].lower() in AT_WORDS else "."))
        floor = end
    return t.rewrite(edits)


def worded(t: Tape) -> Tape:
    edits = []
    for m in _WORDED.finditer(t.text):
        dots = [(d.start(), d.end(), ".") for d in _DOT.finditer(t.text, *m.span(3))]
        plain = not dots and t.untouched([i for i in range(*m.span(3)) if t.text[i] == "."])
        if m[2] and (not plain or _NAMED.search(m[1])):
            edits.append((*m.span(2), "@"))
        if dots:
            edits += dots
    return t.rewrite(edits)


def at_and_dot(t: Tape) -> Tape:
    return worded(bracketed(t))


def disguised(text: str) -> bool:
    """Whether some transducer may have anything to rewrite."""
    if not text.isascii() and _ODD.search(text) or _BRACKETED.search(text):
        return True
    low = text.lower()
    return " dot " in low and ("@" in low or " at " in low) or bool(_AT.search(low)) or any(spelled_runs(text))


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans by kind, then start."""
    text = text or ""
    base = detect(text)
    if not disguised(text):
        return base, base
    tape = at_and_dot(spelled_digits(look_alikes(Tape.of(text))))
    if tape.text == text:
        return base, base
    rewritten = detect(tape.text)
    start, end = tape.sources(np.array([s.start for s in rewritten], np.int64), np.array([s.end - 1 for s in rewritten], np.int64))
    found = {Span(s.kind, a, b) for s, a, b in zip(rewritten, start.tolist(), end.tolist(), strict=True)}
    by = {k: ([s.start for s in base if s.kind == k], [s.end for s in base if s.kind == k]) for k in KINDS}
    more = []
    for s in found:
        starts, ends = by[s.kind]
        n = int(np.searchsorted(starts, s.start, side="right")) - 1
        if not (n >= 0 and ends[n] >= s.end):
            more.append(s)
    return base, sorted({*base, *more}, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def redact(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans(text)[1], key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [spans(x.as_py()) for x in b.column(1)]
        counts = [pa.array([sum(s.kind == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
        base = [hashlib.sha256(",".join(map(str, base)).encode()).hexdigest() for base, _ in got]
        return pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base, pa.string()), pa.array([",".join(map(str, s)) for _, s in got], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in text and, where there is such a column, n_chars set anew."""
    names = docs.columns
    plain = [f"_{i}" for i in range(len(names))]
    own = docs.toDF(*plain)
    at = names.index("text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(b.columns)
        cols[at] = pa.array([redact(x.as_py()) for x in b.column(at)], pa.string())
        return pa.RecordBatch.from_arrays(cols, names=plain)

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, own.schema, strict=True))
    out = common.map_batches(own, fn, schema).toDF(*names)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
