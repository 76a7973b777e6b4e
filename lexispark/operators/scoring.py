"""Scoring chunks: a multinomial model over words as the default, any other through mapInPandas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import features
from lexispark.session import cut, ship, ship_texts

#: Most authors that a model may have.
MOST_LABELS = 10_000
#: Numbers of an array of counts by window and word, or of sums by window and author.
CELLS = 2_000_000


def multinomial(train: DataFrame, n: int = 200) -> DataFrame:
    """(author, word, logp): log-probabilities of the n most frequent words, with one added to each count."""
    counts = features.word_counts(train, "author")
    # At most n words for each author.
    words = sorted(r["word"] for r in features.vocabulary(counts, n).collect())
    by = counts.where(F.col("word").isin(words)).groupBy("author", "word").agg(F.sum("cnt").alias("cnt"))
    every = F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")
    grid = train.select("author").distinct().select("author", F.explode(every).alias("word"))
    full = grid.join(by, ["author", "word"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)) + 1)
    total = F.sum("cnt").over(Window.partitionBy("author"))
    return full.select("author", "word", F.ln(F.col("cnt") / total).alias("logp"))


def authors_of(model: DataFrame) -> list[str]:
    """The model's authors in order; label sets are small, and one of over MOST_LABELS is refused."""
    out = [r["author"] for r in model.select("author").distinct().orderBy("author").limit(MOST_LABELS + 1).collect()]
    if len(out) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} authors")
    return out


def logits(docs: DataFrame, model: DataFrame, size: int, stride: int, least: int, first: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_ord, kept columns, chunk_ix, scores): for each window of the documents, an array of (author_pred, logit) in the order of the authors.

    A logit is the mean log-probability per known word; zero without one. Each token is matched once, however many
    windows hold it; windows of a text are counted where its row is, not cut out, and nothing is shuffled. With first, only so many windows of each document.
    """
    ship_texts(docs.sparkSession)
    ranked = authors_of(model)
    # As many rows as the vocabulary, each with a number for each author: both are bounded.
    rows = model.select("author", "word", "logp").toArrow()
    words = pa.array(sorted(set(rows["word"].to_pylist())), pa.string())
    table = np.zeros((len(words), len(ranked)))
    if len(words):
        table[pc.index_in(rows["word"].combine_chunks(), value_set=words).to_numpy(), pc.index_in(rows["author"].combine_chunks(), value_set=pa.array(ranked, pa.string())).to_numpy()] = rows["logp"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)
    names = ["doc_ord", *keep]
    tokens = F.transform(tx.space_tokens(F.col("text")), tx.letter_tokens)
    own = docs.select(*names, tokens.alias("_tokens"))
    most = max(1, CELLS // max(1, *table.shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = held.value
        for b in batches:
            outer = b.column(len(names))
            n = pc.fill_null(pc.list_value_length(outer), 0).to_numpy().astype(np.int64)
            inner = outer.flatten()
            per = pc.fill_null(pc.list_value_length(inner), 0).to_numpy()
            known = pc.fill_null(pc.index_in(inner.flatten(), value_set=words), -1).to_numpy()
            token = np.repeat(np.arange(len(per)), per)[known >= 0]
            known = known[known >= 0]
            doc = np.repeat(np.arange(len(n)), n)[token]
            at = token - (np.cumsum(n) - n)[doc]
            # Windows are numbered by their starts; those with too few tokens are the last ones.
            windows = np.maximum(0, -(-(n - size) // stride)) + 1
            windows = np.minimum(windows, np.maximum(0, (n - max(least, 1)) // stride + 1)) if size >= least else windows * 0
            windows = np.minimum(windows, first) if first else windows
            begin = np.cumsum(windows) - windows
            low = np.maximum(0, (at - size) // stride + 1)
            high = np.minimum(at // stride, windows[doc] - 1)
            times = np.maximum(0, high - low + 1)  # strides over the size leave gaps
            place = np.repeat(begin[doc] + low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            word = np.repeat(known, times)
            order = np.argsort(place, kind="stable")
            place, word = place[order], word[order]
            owner = np.repeat(np.arange(len(n)), windows)
            for lo in range(0, len(owner), most):
                rows = min(most, len(owner) - lo)
                s, e = np.searchsorted(place, (lo, lo + rows))
                cnt = np.bincount((place[s:e] - lo) * len(words) + word[s:e], minlength=rows * len(words)).reshape(rows, len(words))
                sums = cnt @ logp / np.maximum(1, cnt.sum(axis=1))[:, None]
                row = owner[lo : lo + rows]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * logp.shape[1]), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(len(names))), pa.array((np.arange(lo, lo + rows) - begin[row]).astype(np.int32)), lists], names=[*names, "chunk_ix", "m"])

    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in names)
    order = F.array(*(F.lit(a) for a in ranked)) if ranked else F.array().cast("array<string>")
    full = F.zip_with(order, "m", lambda a, x: F.struct(a.alias("author_pred"), x.alias("logit")))
    return own.mapInArrow(run, f"{schema}, chunk_ix int, m array<double>").select(*names, "chunk_ix", full.alias("scores"))


def leave_one_work_out(docs: DataFrame, n: int = 200) -> DataFrame:
    """(author, title, pred): each work scored by the model of all other works; the vocabulary is that of all.

    A work's words meet the table of log-counts by author, which has a row for each word of the vocabulary, and are added
    up as arrays; only its own author's score is then corrected for the work's own counts. There is one pass over the
    texts and no row for each work and author.
    """
    counts = cut(features.word_counts(docs))
    words = [r["word"] for r in features.vocabulary(counts, n).orderBy("word").collect()]
    works = docs.select("author", "title").distinct()
    ranked = authors_of(works)
    order = F.array(*(F.lit(a) for a in ranked)) if ranked else F.array().cast("array<string>")
    own = cut(counts.where(F.col("word").isin(words)).join(docs.select("doc_ord", "author", "title"), "doc_ord").groupBy("author", "title", "word").agg(F.sum("cnt").alias("cnt")))
    by = own.groupBy("author", "word").agg(F.sum("cnt").alias("all"))
    # Both tables are bounded: a row for each word with a number for each author, and one row of totals.
    table = by.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("author", "all"))).alias("m"))
    table = table.select("word", F.transform(order, lambda a: F.coalesce(F.try_element_at("m", a), F.lit(0))).alias("all"))
    held = {r["author"]: r["n"] for r in by.groupBy("author").agg(F.sum("all").alias("n")).collect()}
    totals = F.array(*(F.lit(held.get(a, 0) + len(words)) for a in ranked)) if ranked else F.array().cast("array<bigint>")
    place = F.array_position(order, F.col("author")).cast("int")
    met = own.join(F.broadcast(table), "word").groupBy("author", "title").agg(F.collect_list(F.struct("cnt", "all")).alias("w"), F.sum("cnt").alias("own"))
    met = works.join(met, ["author", "title"], "left").withColumn("i", place).withColumn("own", F.coalesce("own", F.lit(0)))
    # Without the work, its author's counts are less by the work's own.
    log = lambda x, i, a: F.ln(a - F.when(F.col("i") == i + 1, x["cnt"]).otherwise(0) + 1)
    none = F.transform(order, lambda a: F.lit(0.0))
    sums = F.aggregate(F.coalesce("w", F.array()), none, lambda total, x: F.zip_with(total, F.transform(x["all"], lambda a, i: x["cnt"] * log(x, i, a)), lambda t, p: t + p))
    scores = F.zip_with(sums, F.transform(totals, lambda t, i: F.col("own") * F.ln(t - F.when(F.col("i") == i + 1, F.col("own")).otherwise(0))), lambda s, t: s - t)
    ranks = F.zip_with(scores, order, lambda s, a: F.struct((-F.round(s, 6)).alias("k"), a.alias("pred")))
    return met.select("author", "title", F.array_min(ranks)["pred"].alias("pred"))


def softmax(array: Column) -> Column:
    """Shares of exp(x - max) in an array of logits."""
    e = F.transform(array, lambda x: F.exp(x - F.array_max(array)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def probabilities(scored: DataFrame) -> DataFrame:
    """The windows' columns with probs in place of scores: an array of (author_pred, prob), the softmax over the authors of a window."""
    own = [c for c in scored.columns if c != "scores"]
    probs = scored.select(*own, "scores", softmax(F.col("scores.logit")).alias("p"))
    return probs.select(*own, F.zip_with("scores", "p", lambda s, p: F.struct(s["author_pred"].alias("author_pred"), p.alias("prob"))).alias("probs"))


def probability_rows(probs: DataFrame) -> DataFrame:
    """(doc_ord, chunk_ix, author_pred, prob)."""
    return probs.select("doc_ord", "chunk_ix", F.inline("probs"))


def probability_maps(probs: DataFrame) -> DataFrame:
    """(doc_ord, chunk_ix, probs): a map from author to probability."""
    return probs.select("doc_ord", "chunk_ix", F.map_from_entries("probs").alias("probs"))


def predictions(probs: DataFrame) -> DataFrame:
    """The windows' columns with pred and confidence in place of probs: the likeliest author (of equals, to nine places, the first) and its probability."""
    own = [c for c in probs.columns if c != "probs"]
    ranks = F.transform("probs", lambda p: F.struct((-F.round(p["prob"], 9)).alias("k"), p["author_pred"].alias("pred"), p["prob"].alias("confidence")))
    return probs.select(*own, F.array_min(ranks).alias("_")).select(*own, "_.pred", "_.confidence")


def score_with(windows: DataFrame, score: Callable[[list[str]], tuple[list[str], list[float]]]) -> DataFrame:
    """(doc_ord, chunk_ix, pred, confidence) by any function from chunk texts to labels and confidences, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pred, sure = score([" ".join(t) for t in pdf["tokens"]])
            yield pd.DataFrame({"doc_ord": pdf["doc_ord"], "chunk_ix": pdf["chunk_ix"], "pred": pred, "confidence": sure})

    ship(windows.sparkSession)
    return windows.select("doc_ord", "chunk_ix", "tokens").mapInPandas(run, "doc_ord long, chunk_ix int, pred string, confidence double")
