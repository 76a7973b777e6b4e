"""Word pieces: texts to subwords by longest match, and back.

A text is cleaned, lower-cased, freed of accents and parted into words and single punctuation marks; each word is then cut into the
longest pieces of the vocabulary from the left, those after the first marked by MARK. A word of over LONGEST characters, or one
that can't be cut, is UNKNOWN. The encoder is an Arrow function of a text column, so it fits wherever windows take a tokenizer;
a task cuts each different word once, and remembers REMEMBERED of them.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexispark.session import ship_texts

MARK, UNKNOWN, LONGEST, REMEMBERED = "##", "[UNK]", 100, 50_000
#: What is dropped, and what stands as a word of its own.
DROPPED = regex.compile(r"[\x00�]|(?![\t\n\r])[\p{Cc}\p{Cf}\p{Cs}\p{Co}]")
ALONE = r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e\p{P}]|[一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f]"
WORD = regex.compile(rf"{ALONE}|(?:(?!{ALONE})\S)+")


def words(text: str) -> list[str]:
    """Lower-case words without accents, and punctuation marks."""
    text = DROPPED.sub("", text)
    if not text.isascii():
        text = regex.sub(r"\p{Mn}", "", unicodedata.normalize("NFD", text))
    return WORD.findall(text.lower())


def read_vocabulary(path: str) -> list[str]:
    """The pieces of a public tokenizer's JSON file whose words end in </w>: each may begin a word and go on in one."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["vocab"]
    bases = dict.fromkeys(p.removesuffix("</w>") for p, _ in sorted(found.items(), key=lambda x: x[1]))
    return [UNKNOWN, *(b for b in bases if b), *(MARK + b for b in bases if b)]


@dataclass
class WordPiece:
    """A vocabulary (pieces in the order of their ids) as two maps: of first pieces and of those that go on."""

    vocabulary: list[str]
    _maps: tuple[dict, dict, int] | None = field(default=None, repr=False)
    _known: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "_maps": None, "_known": {}}

    def maps(self) -> tuple[dict, dict, int]:
        """Pieces by their text, and the length of the longest one; flat maps, as a trie's nodes take many times the memory."""
        if self._maps is None:
            first: dict = {}
            later: dict = {}
            for piece in self.vocabulary:
                own, text = (later, piece[len(MARK) :]) if piece.startswith(MARK) and len(piece) > len(MARK) else (first, piece)
                own[text] = piece
            self._maps = first, later, max(map(len, [*first, *later]), default=0)
        return self._maps

    def pieces(self, word: str) -> list[str]:
        """The word's pieces by longest match."""
        if len(word) > LONGEST:
            return [UNKNOWN]
        out, at = [], 0
        first, later, longest = self.maps()
        while at < len(word):
            own = later if at else first
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in own), at)
            if end == at:
                return [UNKNOWN]
            out.append(own[word[at:end]])
            at = end
        return out

    def encode(self, text: str | None) -> list[str]:
        out: list[str] = []
        for w in words(text or ""):
            found = self._known.get(w)
            if found is None:
                found = self.pieces(w)
                if len(self._known) < REMEMBERED:
                    self._known[w] = found
            out += found
        return out

    def ids(self) -> Column:
        """A map from pieces to ids, as a literal; it is as large as the vocabulary."""
        return F.map_from_arrays(F.array(*map(F.lit, self.vocabulary)), F.sequence(F.lit(0), F.lit(len(self.vocabulary) - 1)))

    def tokenizer(self, spark: SparkSession):
        """A function of a text column to an array of pieces; an array without any for a null text."""
        ship_texts(spark)
        model = self

        @F.pandas_udf("array<string>")
        def pieces(texts: pd.Series) -> pd.Series:
            return texts.map(model.encode)

        return pieces


def decode(pieces: Column) -> Column:
    """The text of an array of pieces: joined by spaces but where a piece goes on; a first one that goes on loses its mark."""
    return F.regexp_replace(F.array_join(pieces, " "), rf"(?:^| ){MARK}(?=\S)", "")
