"""Texts of TEI documents: a scanner of markup with a stack of open elements.

The text of a document is that of its bodies. Names count without their namespace prefix; headers, notes of the file and what else lies
outside of a body is left out, and so are comments, declarations and processing instructions. CDATA sections are text as they stand;
the five named references and numeric ones are resolved. A word that is parted by a hyphen at a line's end is joined again. Broken
markup (an end without its start, an element that isn't closed, an unknown reference, a tag or section that
doesn't end) gives what was read so far and says what is wrong and where.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexispark.session import ship_texts

#: The references that XML knows.
NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
BODY, HEADER = "body", "teiHeader"
_NAME = r"[^\s/><='\"!?&]+"
_TAG = re.compile(rf"<(/?)({_NAME})((?:\s+{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(/?)>")
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#x([0-9a-fA-F]+)|([A-Za-z][\w.-]*));")
_HYPHEN = re.compile(r"-\n[ \t]*")
#: Sections by their beginnings, with their ends.
SECTIONS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))


class Broken(ValueError):
    """What is wrong with the markup."""


@dataclass
class Scanner:
    """One pass over a document."""

    source: str
    open: list[str] = field(default_factory=list)
    out: list[str] = field(default_factory=list)

    def inside(self) -> bool:
        return BODY in self.open and HEADER not in self.open

    def add(self, text: str) -> None:
        if self.inside():
            self.out.append(text)

    def scan(self) -> None:
        at, s = 0, self.source
        while at < len(s):
            mark = s.find("<", at)
            mark = len(s) if mark < 0 else mark
            if mark > at:
                self.add(self.resolved(s[at:mark], at))
            if mark == len(s):
                break
            at = self.markup(mark)
        if self.open:
            raise Broken(f"<{self.open[-1]}> is not closed")

    def resolved(self, text: str, at: int) -> str:
        if "]]>" in text:
            raise Broken(f"]]> in the text after character {at}")
        if "&" not in text:
            return text

        def one(m: re.Match) -> str:
            if m[3]:
                if m[3] not in NAMED:
                    raise Broken(f"unknown reference &{m[3]}; after character {at}")
                return NAMED[m[3]]
            code = int(m[1]) if m[1] else int(m[2], 16)
            if not (code in (9, 10, 13) or 0x20 <= code <= 0xD7FF or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF):
                raise Broken(f"a reference to no character after character {at}")
            return chr(code)

        rest = _REFERENCE.sub("", text)
        if "&" in rest:
            raise Broken(f"a bare & after character {at}")
        return _REFERENCE.sub(one, text)

    def markup(self, at: int) -> int:
        """Takes the tag or section at a place and returns where it ends."""
        s = self.source
        for begin, end in SECTIONS:
            if s.startswith(begin, at):
                to = s.find(end, at + len(begin))
                if to < 0:
                    raise Broken(f"{begin} at character {at} does not end")
                if begin == "<![CDATA[":
                    self.add(s[at + len(begin) : to])
                return to + len(end)
        if s.startswith("<!", at):
            return self.declaration(at)
        m = _TAG.match(s, at)
        if not m or m[1] and (m[3] or m[4]):
            raise Broken(f"no tag at character {at}")
        name = m[2].rpartition(":")[2]
        if m[1]:
            if not self.open or self.open[-1] != name:
                raise Broken(f"</{m[2]}> at character {at} closes nothing")
            self.open.pop()
        elif not m[4]:
            self.open.append(name)
        return m.end()

    def declaration(self, at: int) -> int:
        """A declaration ends with the first > outside of quotes and brackets."""
        depth, quote = 0, ""
        for i in range(at + 2, len(self.source)):
            c = self.source[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "[]":
                depth += 1 if c == "[" else -1
            elif c == ">" and not depth:
                return i + 1
        raise Broken(f"the declaration at character {at} does not end")


def body(document: str | None) -> tuple[str | None, str | None]:
    """The text of the bodies, and what is wrong with the markup, if anything; null for null."""
    if document is None:
        return None, None
    scanner, error = Scanner(document.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")), None
    try:
        scanner.scan()
    except Broken as e:
        error = str(e)
    return _HYPHEN.sub("", "".join(scanner.out)), error


def tei_text(spark: SparkSession, document: Column) -> Column:
    """A struct (body, error) of a column of TEI documents."""
    ship_texts(spark)

    @F.pandas_udf("body string, error string")
    def scanned(documents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([body(d) for d in documents], columns=["body", "error"])

    return scanned(document)
