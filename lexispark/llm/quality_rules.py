"""Quality rules and a hashed n-gram log-likelihood ratio.

Rules count words, symbols, repeated lines and repeated three-word windows of whole texts. The verdict adds a
ratio: words and pairs of words are hashed to BUCKETS; one multinomial is counted over all trusted documents
(labelled quality 1), one over all documents, both smoothed. A document's score is the mean over its n-grams
of log(trusted / raw), so it doesn't depend on length. A document is kept if it passes the rules and its score
is at least the threshold: the mean of the trusted documents that pass them, less DEVIATIONS of their standard
deviations (LEAST_MARGIN at least), where each is scored without its own counts among the trusted ones. Every document is decided by the same comparison, without sampling.

Counts are exact over all rows: each task sums one vector of BUCKETS numbers for each multinomial, and Spark
adds up the tasks' vectors by bucket, so only 2 x BUCKETS numbers reach the driver.

Defined cases: a null text has no words and fails the rules; without trusted documents all ratios and the threshold
are zero, so the rules decide; a score that equals the threshold is kept; texts of any length are read whole; repeated
rows count as often as they occur; null labels and ids are not trusted; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

#: Hash buckets and smoothing count per bucket; how far below the trusted mean documents are kept.
BUCKETS, SMOOTHING, DEVIATIONS, LEAST_MARGIN = 1 << 14, 1.0, 4.0, 0.05
#: Rules: fewest words, most words in repeated windows in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
WHITE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
_IDS: dict[bytes, int] = {}


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A 32-bit hash of each word."""
    out = list(map(_IDS.get, words))
    if None in out:
        if len(_IDS) > 100_000:
            _IDS.clear()
        for i, x in enumerate(out):
            if x is None:
                out[i] = _IDS[words[i]] = zlib.crc32(words[i])
    return np.array(out, np.int64)


def grams(h: np.ndarray) -> np.ndarray:
    """Buckets of a text's words and pairs of words."""
    pairs = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA6B + 1) & 0xFFFFFFFF
    return np.concatenate([(h * 0x9E3779B1 & 0xFFFFFFFF) >> 18, pairs >> 18])


def repeated_words(words: list[bytes], h: np.ndarray) -> int:
    """Words that stand in a three-word window which occurs twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    # Numbers of this text's own words, so that equal windows are equal and others aren't.
    seen: dict[bytes, int] = {}
    own = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    k = len(seen)
    two = np.unique(own[:-1] * k + own[1:], return_inverse=True)[1]
    three = two[:-1] * np.int64(k) + own[2:]
    _, back, count = np.unique(three, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the trusted documents.

    Before the join by id, a bit filter lets few others through, so that texts which aren't trusted are hardly
    shuffled.
    """
    trusted = trusted_ids(labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    likely = common.filtered(rows, trusted, ["doc_id"], "_likely").where("_likely")
    return likely.join(trusted.hint("merge"), "doc_id").select("text")


def _counted(texts: DataFrame) -> np.ndarray:
    """Counts of n-grams by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for b in common.text_batches(batches):
            for text in b.column(0):
                sums += np.bincount(grams(word_numbers((text.as_py() or "").encode("utf-8", "replace").split())), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums)], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gram_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all trusted documents and over all documents."""
    common.ship(docs.sparkSession)
    return _counted(trusted_texts(docs, labels)), _counted(docs.select(F.col("text").cast("string")))


def ratios(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(trusted / raw) by bucket. The trusted counts are smoothed towards the raw shares, so that rare buckets tend to zero."""
    if not trusted.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    p = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    weight = SMOOTHING * BUCKETS
    return np.log((trusted + weight * p) / (trusted.sum() + weight)) - np.log(p)


def without(g: np.ndarray, trusted: np.ndarray, raw: np.ndarray) -> float:
    """The score of a trusted text with these n-grams, its own counts taken off the trusted ones."""
    if not len(g) or not raw.sum():
        return 0.0
    own, n = np.unique(g, return_counts=True)
    weight = SMOOTHING * BUCKETS
    p = (raw[own] + SMOOTHING) / (raw.sum() + weight)
    rest = np.log((np.maximum(trusted[own] - n, 0) + weight * p) / (max(trusted.sum() - len(g), 0) + weight)) - np.log(p)
    return float(np.round((rest * n).sum() / len(g), 9))


def measure(text: str | None, table: np.ndarray, trusted: np.ndarray, raw: np.ndarray) -> tuple:
    """All counts, base_failed and score of a whole text, and its score if it is one of the trusted ones."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    h = word_numbers(words)
    n, again = len(words), repeated_words(words, h)
    failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
    score = float(np.round(table[grams(h)].mean(), 9)) if n else 0.0
    chars = len(text) - sum(map(text.count, WHITE))
    return n, chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), again, failed, score, without(grams(h), trusted, raw) if n else 0.0


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, score, kept."""
    trusted, raw = gram_counts(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((ratios(trusted, raw), trusted, raw))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "without"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [measure(x.as_py(), *held.value) for x in b.column(1)]
        cols = [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, without double"
    scored = common.cut(common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, schema))
    limit = threshold(scored.where("not base_failed").join(trusted_ids(labels), "doc_id", "left_semi"))
    return scored.drop("without").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= limit))


def threshold(trusted: DataFrame) -> float:
    """The score from which documents are kept, from the scores of trusted ones without their own counts."""
    mean, deviation = trusted.agg(F.avg("without"), F.stddev_pop("without")).first()
    return 0.0 if mean is None else round(mean - max(DEVIATIONS * deviation, LEAST_MARGIN), 6)
