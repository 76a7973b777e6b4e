"""Edge texts with values typed by hand."""

import time

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as tx

EDGE = "Café naïve it's don_t abc1 end x y \u001c z ſtart ÉÀ"


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).first()[0]


@pytest.mark.parametrize(
    ("f", "text", "out"),
    [
        (tx.strip_boilerplate, "*** START OF THE PROJECT GUTENBERG EBOOK A B ***\nb", "b"),
        (tx.strip_boilerplate, "*** START OF THE PROJECT GUTENBERG EBOOK A B ***\nb", "b"),
        (tx.strip_boilerplate, "*** ſtart of the project gutenberg ebook A ***\nb", "b"),
        (tx.strip_boilerplate, "*** END OF THE PROJECT GUTENBERG EBOOK A ***\nx\n*** START OF THE PROJECT GUTENBERG EBOOK A ***", ""),
        (tx.strip_boilerplate, "  plain \n", "plain"),
        (tx.strip_boilerplate, "a START OF THIS PROJECT GUTENBERG EBOOK T ***\nb", "T ***\nb"),
        (tx.strip_literal_markers, "h\n*** START OF X\nbody *** END OF Y", "body "),
        (tx.strip_literal_markers, "*** START OF X", ""),
        (tx.strip_literal_markers, "none", "none"),
        (tx.normalize_quotes, "“a” ‘b’ `c´", "“a” ‘b’ 'c'"),
        (lambda t: tx.normalize_quotes(t, curly=True), "“a” ‘b’ `c´", "\"a\" 'b' 'c'"),
        (tx.drop_digit_lines, "a\n1\n2\n3\nb", "a\n2\nb"),
        (tx.drop_digit_lines, "1\na\n٣\nb", "1\na\nb"),
        (tx.drop_roman_lines, "a\nXIV\nb\nxiv\nc", "a\nb\nxiv\nc"),
        (tx.line_feeds, "a\r\nb\rc", "a\nb\nc"),
        (tx.collapse_line_feeds, "a\n\n\n\nb", "a\n\nb"),
        (tx.trim_unicode, " \x1c a b ", "a b"),
        (tx.collapse_space, " a \n b ", "a b"),
        (tx.letter_tokens, EDGE, ["it", "s", "end", "x", "y", "z"]),
        (tx.word_count, EDGE, 11),
        (tx.word_count, "", 0),
        (tx.special_ratio, "", None),
        (tx.special_ratio, "ab#é", 0.5),
        (lambda t: tx.thousands(F.lit(1234.9)), "", "1,234"),
        (tx.title, "o'brien MARY-ann 2nd élan", "O'Brien Mary-Ann 2Nd Élan"),
        (lambda t: tx.percent(F.lit(0.12345)), "", "12.35%"),
        (lambda t: tx.sample(t, 2), " a  b c", "a b"),
        (lambda t: tx.clean(t, from_file=True), "﻿x\r\n12\r\ny_z  `q \r\n\r\n\r\n\r\nend ", "x\nyz 'q\n\nend"),
    ],
)
def test_edges(spark, f, text, out):
    assert one(spark, f, text) == out


def test_null_stays_null(spark):
    for f in (tx.clean, tx.letter_tokens, tx.word_count, tx.strip_literal_markers, tx.special_ratio):
        assert one(spark, f, None) is None


def test_clean_twice_changes_nothing_more_at_the_ends(spark):
    t = " a \n\n\n b\t\tc "
    once = one(spark, tx.collapse_space, t)
    assert one(spark, tx.collapse_space, once) == once


def test_issues(spark):
    got = one(spark, lambda t: tx.issues(tx.has_marker(t), tx.special_ratio(t), tx.word_count(t)), "Project Gutenberg ####")
    assert got == ["Contains Gutenberg text", "High special char ratio: 18.18%", "Short text: 3 words"]


def test_long_runs_take_time_in_proportion(spark):
    n = 1_000_000
    began = time.time()
    for run in (" " * n, "\t" * n, "\n" * n, " \t" * (n // 2), "a" + " " * n + "b" + " " * n + "\n", "*** START OF THE PROJECT GUTENBERG EBOOK " + " " * n):
        for f in (tx.trim_unicode, tx.strip_line_ends, tx.clean, tx.collapse_space, tx.strip_boilerplate):
            one(spark, lambda t, f=f: F.length(f(t)), run)
    assert one(spark, tx.strip_line_ends, "a" + " " * n + "\nb ") == "a\nb "
    assert time.time() - began < 60


def test_white_space_is_that_of_all_code_points(spark):
    text = "".join("a" + chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and c)
    assert one(spark, tx.word_count, text) == len(text.split())
    assert one(spark, tx.trim_unicode, " \x1c a 　\x85") == "a"
