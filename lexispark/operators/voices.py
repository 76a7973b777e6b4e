"""Changes of authorship within a text: the likeliest sequence of authors of its windows, with a cost for each change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.session import ship


def best_path(scores: np.ndarray, cost: float) -> np.ndarray:
    """The author of each window (rows of scores, a column for each author) that has the largest sum of scores less cost for each change.

    Viterbi's recursion; of equals the path that does not change, then the first author.
    """
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    total, back = scores[0].copy(), np.zeros(scores.shape, np.int64)
    own = np.arange(scores.shape[1])
    for i in range(1, n):
        top = int(total.argmax())
        change = total[top] - cost > total
        back[i] = np.where(change, top, own)
        total = np.where(change, total[top] - cost, total) + scores[i]
    path = np.zeros(n, np.int64)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def passages(scored: DataFrame, labels: list[str], cost: float, window: int) -> DataFrame:
    """(doc_ord, passage, author, first_chunk, last_chunk, first_token): stretches of one author in each document.

    scored: (doc_ord, chunk_ix, logps), with an array of log-probabilities of a window's words in the order of the labels; windows
    do not overlap and hold so many tokens. The windows of a document are gathered in its row, a few numbers for each;
    a document without windows has no rows.
    """
    ship(scored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flat = rows.values
                chunk = flat.field(0).to_numpy(zero_copy_only=False)
                path = best_path(flat.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1), cost)
                starts = np.flatnonzero(np.diff(path, prepend=-1))
                for p, (s, e) in enumerate(zip(starts, np.append(starts[1:], len(path)), strict=True)):
                    out.append((doc, p, labels[path[s]], int(chunk[s]), int(chunk[e - 1]), int(chunk[s]) * window))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_ord", "passage", "author", "first_chunk", "last_chunk", "first_token"])

    whole = scored.groupBy("doc_ord").agg(F.sort_array(F.collect_list(F.struct("chunk_ix", "logps"))).alias("w"))
    return whole.mapInArrow(run, "doc_ord long, passage int, author string, first_chunk int, last_chunk int, first_token long")


def spliced(docs: DataFrame, rank: str) -> DataFrame:
    """(doc_ord, first_author, second_author, boundary, text): documents of even ranks, each followed by the one of the next rank.

    docs: (doc_ord, author, text, and the rank, from 0 without gaps); the boundary is the number of tokens before the second part.
    """
    pair = (F.col(rank) / 2).cast("long").alias("pair")
    a = docs.where(F.col(rank) % 2 == 0).select(pair, "doc_ord", F.col("author").alias("first_author"), F.col("text").alias("_a"))
    b = docs.where(F.col(rank) % 2 == 1).select(pair, F.col("author").alias("second_author"), F.col("text").alias("_b"))
    return a.join(b, "pair").select("doc_ord", "first_author", "second_author", tx.word_count(F.col("_a")).alias("boundary"), F.concat("_a", F.lit("\n"), "_b").alias("text"))
