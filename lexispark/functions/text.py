"""Column functions on text: cleaning, tokens, counts. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and as a boilerplate marker.
# The class of Unicode's white space is much faster than a list of its characters.
SPACE = r"\s\x1c-\x1f"
START_PATTERNS = (
    r"\*\*\* START OF THE PROJECT GUTENBERG EBOOK .+? \*\*\*",
    r"\*\*\*START OF THE PROJECT GUTENBERG EBOOK .+?\*\*\*",
    r"START OF THIS PROJECT GUTENBERG EBOOK",
)
END_PATTERNS = (
    r"\*\*\* END OF THE PROJECT GUTENBERG EBOOK .+? \*\*\*",
    r"\*\*\*END OF THE PROJECT GUTENBERG EBOOK .+?\*\*\*",
    r"END OF THIS PROJECT GUTENBERG EBOOK",
)
START_MARKERS = ("*** START OF", "START OF THE PROJECT GUTENBERG", "*** START OF THE PROJECT")
END_MARKERS = ("*** END OF", "END OF THE PROJECT GUTENBERG", "*** END OF THE PROJECT")
NONSPACE = rf"(?U)[^{SPACE}]+"
#: A word of ASCII letters that no other letter, digit or underscore touches.
LETTERS = r"(?<![\p{L}\p{N}_])[a-z]+(?![\p{L}\p{N}_])"


def trim_unicode(t: Column) -> Column:
    """Without white space at either end. A run is looked at from its first character only, so time is in proportion to the text."""
    return F.regexp_replace(F.regexp_replace(t, rf"(?U)\A[{SPACE}]++", ""), rf"(?U)(?<![{SPACE}])[{SPACE}]++\z", "")


def strip_bom(t: Column) -> Column:
    return F.regexp_replace(t, "\\A\ufeff", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_boilerplate(t: Column) -> Column:
    """The text between the markers. Patterns are tried in their order; both ends are looked for in the whole text.

    Each marker holds a word that has one spelling in lower case, so texts without it are only trimmed. A text and its
    markers are each found once.
    """

    def between(t: Column) -> Column:
        start = F.coalesce(*(F.regexp_substr(t, F.lit("(?iud)" + p)) for p in START_PATTERNS))
        stop = F.coalesce(*(F.regexp_substr(t, F.lit("(?iud)" + p)) for p in END_PATTERNS))

        def cut(m: Column) -> Column:
            # Nothing equal to the leftmost match stands before it.
            begin = F.coalesce(F.instr(t, m["start"]) - 1 + F.length(m["start"]), F.lit(0))
            end = F.coalesce(F.instr(t, m["stop"]) - 1, F.length(t))
            return F.substring(t, begin + 1, F.greatest(end - begin, F.lit(0)))

        return F.when(has_marker(t), let(F.struct(start.alias("start"), stop.alias("stop")), cut)).otherwise(t)

    return trim_unicode(let(t, between))


def strip_literal_markers(t: Column) -> Column:
    """The text after the line of the first start marker and before the end marker.

    Markers are tried in their order, case counts. A start marker without a line break after it leaves nothing.
    """
    tail = F.lit(None).cast("string")
    for m in reversed(START_MARKERS):
        rest = F.substring(t, F.instr(t, m), F.length(t))
        cut = F.when(F.instr(rest, "\n") > 0, F.substring(rest, F.instr(rest, "\n") + 1, F.length(rest))).otherwise(F.lit(""))
        tail = F.when(F.instr(t, m) > 0, cut).otherwise(tail)
    body = F.coalesce(tail, t)
    out = body
    for m in reversed(END_MARKERS):
        out = F.when(F.instr(body, m) > 0, F.substring_index(body, m, 1)).otherwise(out)
    return out


def normalize_quotes(t: Column, curly: bool = False) -> Column:
    """Backtick and acute accent to an apostrophe; with curly also curly quotes to straight ones."""
    return F.translate(t, "`´‘’“”", "''''\"\"") if curly else F.translate(t, "`´", "''")


def line_feeds(t: Column) -> Column:
    return F.regexp_replace(t, r"\r\n?", "\n")


def collapse_blanks(t: Column) -> Column:
    return F.regexp_replace(t, r"[ \t]+", " ")


def strip_line_ends(t: Column) -> Column:
    return F.regexp_replace(t, r"(?<! ) ++\n", "\n")


def collapse_line_feeds(t: Column) -> Column:
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def drop_digit_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"\n\p{Nd}+\n", "\n")


def drop_roman_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"\n[IVXLCDM]+\n", "\n")


def drop_underscores(t: Column) -> Column:
    return F.replace(t, F.lit("_"), F.lit(""))


def clean(t: Column, from_file: bool = False) -> Column:
    """The whole chain in its order. Texts read from files get their line ends normalised first, as reading in text mode does."""
    t = strip_bom(line_feeds(t)) if from_file else t
    t = normalize_quotes(strip_boilerplate(t))
    t = drop_underscores(drop_roman_lines(drop_digit_lines(t)))
    return trim_unicode(collapse_line_feeds(strip_line_ends(collapse_blanks(line_feeds(t)))))


def collapse_space(t: Column) -> Column:
    """All white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(t, rf"(?U)[{SPACE}]+", " "))


def letter_tokens(t: Column) -> Column:
    """Lower-case words of ASCII letters."""
    return F.regexp_extract_all(F.lower(t), F.lit(LETTERS), F.lit(0))


def space_tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(NONSPACE), F.lit(0))


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(NONSPACE)).cast("long")


def sample(t: Column, n: int = 200) -> Column:
    """The first n words, space-joined."""
    return F.array_join(F.slice(space_tokens(t), 1, n), " ")


def special_ratio(t: Column) -> Column:
    """Share of characters beyond letters, digits, white space and plain punctuation; null for an empty text."""
    return F.try_divide(F.regexp_count(t, F.lit(rf"(?U)[^a-zA-Z0-9{SPACE}.,;:!?'\"\-]")), F.length(t))


def has_marker(t: Column) -> Column:
    return F.contains(F.lower(t), F.lit("gutenberg"))


def thousands(x: Column) -> Column:
    """Truncated, with separators."""
    return F.format_number(x.cast("bigint"), 0)


def percent(x: Column) -> Column:
    """A share as per cent with two places, rounded as C's printf does: by the number's exact binary value, an exact half to the even digit."""

    def rounded(y: Column) -> Column:
        # y in two parts of at most 26 bits, so that a hundred times either is exact; the second only tips the scale.
        high = y * 134217729.0 - (y * 134217729.0 - y)
        a, b = high * 100, (y - high) * 100
        whole = F.floor(a)
        half = a - whole - 0.5
        n = whole + F.when((half > -b) | ((half == -b) & (whole % 2 == 1)), 1).otherwise(0)
        return F.format_string("%d.%02d%%", F.floor(n / 100), n % 100)

    y = x * 100
    # Beyond, parts and digits no longer fit; such shares don't occur.
    text = F.when(F.abs(y) < 1e9, F.concat(F.when(y < 0, "-").otherwise(""), let(F.abs(y), rounded))).otherwise(F.format_string("%.2f%%", y))
    return F.when(y.isNotNull(), text)


def title(t: Column) -> Column:
    """Each run of letters with its first letter in upper case and the others in lower case."""
    words = F.regexp_extract_all(t, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, F.length(w))))), "")


def issues(marked: Column, share: Column, count: Column, ratio: float = 0.01, words: int = 20000) -> Column:
    """Array of what speaks against a text, from has_marker, special_ratio and word_count: marker, special characters, too few words."""
    short = F.concat(F.lit("Short text: "), thousands(count), F.lit(" words"))
    odd = F.concat(F.lit("High special char ratio: "), percent(share))
    return F.array_compact(F.array(F.when(marked, F.lit("Contains Gutenberg text")), F.when(share > ratio, odd), F.when(count < words, short)))
