"""Periodic runs of words: maximal repetitions, found by Main and Lorentz's divide and conquer behind a mask of repeated k-grams.

A run is a stretch of at least LEAST words, and of at least two periods, that no neighbouring word extends with the same
smallest period. In a run of length n and period q the words from the first to the (n-q)th are found again q words
later, so it overlaps itself in n - q >= max(LEAST - q, q) >= LEAST / 2 words. With k = LEAST / 2 each word of a run hence lies
in a k-gram that the document holds twice. All other words are masked; what is left are segments, and a run lies in one
of them whole.

The segments of a slice of documents are put into one array, with a code of its own between each two. For each
half width h = 1, 2, 4, ... the places c = h, 3h, 5h, ... are centres; each run has one centre that divides it for which
its period is at most h. For each centre and period the common extensions to both sides give the
stretch around it: they are first bounded below by equal three-grams at once for all centres and periods, and those that may be long enough
are measured with ranks of stretches of 1, 8, 64, ... words. The work is n log n for n words of segments, and memory is in proportion to the words
of one slice; a text of any length is one document. Each document is worked on by itself, so no rows are shuffled.

Defined cases: a null text, an empty one and one without words have no runs and an empty collapsed text; a null id is never made
periodic by digest(); repeated rows give a row each; an empty table gives none; other columns are ignored by digest(), whatever
their names; runs of equal greatest length go by start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

#: Fewest words of a run; words of the k-grams of the mask.
LEAST = 12
K = LEAST // 2
#: Queries that are measured at once; words that are joined at once.
QUERIES, JOINED = 1 << 20, 100_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """The words of some texts: where they lie in the bytes, a code for each different one, and the texts' bounds."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    bounds: np.ndarray


def words(texts: pa.Array) -> Words:
    """Words of UTF-8 texts, found by their bytes, as all white space is ASCII; a null text has none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    letter = ~SPACE[data]
    if texts.null_count:
        for i in np.flatnonzero(texts.is_null().to_numpy(zero_copy_only=False)):
            letter[offsets[i] : offsets[i + 1]] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) if len(letter) else letter
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.concatenate([letter[1:], [False]]) if len(letter) else letter
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    if len(start):
        packed, ends = data[letter].tobytes(), np.concatenate([[0], np.cumsum(end - start)])
        each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed)])
        code = each.dictionary_encode().indices.to_numpy().astype(np.int64)
    else:
        code = np.zeros(0, np.int64)
    return Words(data, start, end, code, np.searchsorted(start, offsets))


def segments(code: np.ndarray, doc: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that lie in k-grams which their document holds twice.

    k-grams are compared by a 64-bit hash: equal hashes of different ones only leave more words unmasked.
    """
    n = len(code) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none
    own = doc[: n] == doc[k - 1 :]
    at = np.flatnonzero(own)
    h = doc[at].astype(np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + code[at + j].astype(np.uint64)
    h ^= h >> np.uint64(32)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # Words covered by a repeated k-gram; k-grams don't reach into other documents.
    steps = np.zeros(len(code) + 1, np.int32)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + k, -1)
    covered = np.cumsum(steps[:-1]) > 0
    begins = covered & np.concatenate([[True], ~covered[:-1] | (doc[1:] != doc[:-1])])
    ends = covered & np.concatenate([~covered[1:] | (doc[1:] != doc[:-1]), [True]])
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def ranks(code: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """For steps of 1, 8, 64, ... words: numbers that are equal where the stretches of so many words are; the longest first.

    A stretch that goes over the end of the array has a number of its own.
    """
    ids, step, out = np.unique(code, return_inverse=True)[1].astype(np.int64), 1, []
    while True:
        out.append((step, ids.astype(np.int32)))
        if step * 8 > longest:
            return out[::-1]
        for _ in range(3):
            pair = ids[: len(ids) - step] * len(code) + ids[step:]
            ids = np.concatenate([np.unique(pair, return_inverse=True)[1], len(code) - step + np.arange(step)])
            step *= 2


def extended(tables: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words from places a and b on (or before them) are equal; a separator ends each segment."""
    far = np.zeros(len(a), np.int64)
    for step, ids in tables:
        live = np.arange(len(a))
        while len(live):
            x, y = (a[live] - far[live] - step, b[live] - far[live] - step) if back else (a[live] + far[live], b[live] + far[live])
            inside = (x >= 0) & (y >= 0) if back else (x + step <= len(ids)) & (y + step <= len(ids))
            live, x, y = live[inside], x[inside], y[inside]
            live = live[ids[x] == ids[y]]
            far[live] += step
    return far


def repetitions(flat: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of an array whose segments end with codes of their own; longest: the longest segment."""
    n, found = len(flat), []
    tables = None
    over = np.full(n, -1, np.int32)  # of each place a run that covers it
    known = np.zeros((1, 3), np.int64)
    three = np.full(n + 1, -1, np.int64)
    if n >= 3:
        two = np.unique(flat[:-1] * (n + 1) + np.unique(flat, return_inverse=True)[1][1:], return_inverse=True)[1]
        three[: n - 2] = np.unique(two[:-1] * (n + 1) + two[1:], return_inverse=True)[1]
    h = 1
    while h < n:
        centres, most = np.arange(h, n, 2 * h), min(h, longest // 2)
        per = max(1, QUERIES // len(centres)) if len(centres) < QUERIES else 1
        for lo in range(1, most + 1, per):
            periods = np.arange(lo, min(lo + per, most + 1))
            for part in range(0, len(centres), QUERIES):
                c, p = (x.ravel() for x in np.meshgrid(centres[part : part + QUERIES], periods, indexing="ij"))
                for left in (True, False):
                    a = c - p if left else c
                    b = a + p
                    ok = (a >= 0) & (b < n)
                    x, y, q = a[ok], b[ok], p[ok]
                    # One of the two extensions has three words at least, as both have least / 2 together.
                    ahead = (three[x] >= 0) & (three[y] >= 0) & (three[x] == three[y])
                    u = np.maximum(x - 3, 0)
                    behind = (x >= 3) & (three[u] == three[y - 3])
                    some = ahead | behind
                    # Two places of a known run, a multiple of its period apart, give that run again.
                    r = over[x]
                    some &= (r < 0) | (known[r, 1] <= y) | (q % np.maximum(known[r, 2], 1) != 0)
                    if not some.any():
                        continue
                    x, y, q = x[some], y[some], q[some]
                    tables = tables or ranks(flat, longest)
                    on, back = extended(tables, x, y, False), extended(tables, x, y, True)
                    long = (on + back >= q) & (on + back + q >= least)
                    new = smallest(np.stack([(x - back)[long], (y + on)[long], q[long]], axis=1))
                    if len(new):
                        found.append(new)
                        new = new[np.argsort(new[:, 1] - new[:, 0], kind="stable")]
                        for i, (s, e, _) in enumerate(new.tolist(), len(known)):
                            over[s:e] = i
                        known = np.concatenate([known, new])
        h *= 2
    return smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def smallest(rows: np.ndarray) -> np.ndarray:
    """The rows with the smallest period of each stretch: what is maximal for a multiple of that is maximal for it too."""
    rows = np.unique(rows, axis=0)
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def runs_of(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs of documents whose words lie one after another."""
    start, end = segments(code, doc)
    long = end - start >= LEAST
    start, end = start[long], end[long]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)]) + 1  # the array begins with a separator
    flat = np.empty(at[-1], np.int64)
    place = np.arange(at[-1] - 1) - np.repeat(at[:-1] - 1, size) + np.repeat(start, size)
    flat[1:] = code[np.minimum(place, len(code) - 1)]
    flat[np.append(0, at[1:] - 1)] = code.max() + 1 + np.arange(len(size) + 1)
    rows = repetitions(np.unique(flat, return_inverse=True)[1].astype(np.int64), int(size.max()))
    shift = start[np.searchsorted(at, rows[:, 0], side="right") - 1] - at[np.searchsorted(at, rows[:, 0], side="right") - 1]
    rows[:, :2] += shift[:, None]
    return rows


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def pieces(w: Words, order: np.ndarray) -> Iterator[bytes]:
    """The words of such numbers joined by spaces, in pieces; neighbours in the text are taken from it together."""
    if not len(order):
        return
    cuts = np.flatnonzero(np.diff(order) != 1) + 1
    for i, (a, b) in enumerate(zip(np.append(0, cuts), np.append(cuts, len(order)), strict=True)):
        for lo in range(a, b, JOINED):
            first, last = order[lo], order[min(lo + JOINED, b) - 1]
            yield (b" " if i or lo else b"") + b" ".join(w.data[w.start[first] : w.end[last]].tobytes().split())


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """First word and period from which on the digest's contract makes a document periodic."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _found(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """For each row its number, the words, the numbers of its words and its runs."""
    w = words(batch.column(batch.schema.get_field_index("text")))
    ids = batch.column(0).to_pylist() if plant else []
    order = np.arange(len(w.code))
    for i, doc_id in enumerate(ids):
        lo, hi = w.bounds[i], w.bounds[i + 1]
        if at := planted(doc_id, int(hi - lo)):
            a, p = at
            order[lo + a : hi] = lo + a + np.arange(hi - lo - a) % p
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    rows = runs_of(w.code[order], doc) if len(order) else np.zeros((0, 3), np.int64)
    cut = np.searchsorted(rows[:, 0], w.bounds)
    for i in range(batch.num_rows):
        own = rows[cut[i] : cut[i + 1]].copy()
        own[:, :2] -= w.bounds[i]
        yield i, w, order[w.bounds[i] : w.bounds[i + 1]], own


def digest(docs: DataFrame) -> DataFrame:
    """The runs of each document after the contract's planting: number, longest one, digests of all and of the collapsed text."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for _, w, order, own in _found(batch, True):
            own = own[np.lexsort((own[:, 2], own[:, 0]))]
            listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in own.tolist())
            sha = hashlib.sha256()
            for piece in pieces(w, order[kept(len(order), own)] if len(own) else order):
                sha.update(piece)
            best: tuple = (None,) * 4
            if len(own):
                length = own[:, 1] - own[:, 0]
                s, e, q = own[np.lexsort((own[:, 2], own[:, 0], -length))[0]].tolist()
                best = (s, e - s, q, 1000 * (e - s) // q)
            out.append((len(own), *best, hashlib.sha256(listed.encode()).hexdigest(), sha.hexdigest()))
        rest = [pa.array(x, pa.string() if n.endswith("256") else pa.int64()) for n, x in zip(names[1:], zip(*out, strict=True) if out else [[]] * 7, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *rest], names=names)

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of each run of the documents as they are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = batch.column(0).to_pylist(), []
        for i, _, _, own in _found(batch, False):
            out += [(ids[i], s, e - s, q) for s, e, q in own.tolist()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "length", "period"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each run is reduced to its first period, and words are joined by one space; null stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, w, order, own in _found(batch, False):
            out.append(b"".join(pieces(w, order[kept(len(order), own)])).decode() if batch.column(1)[i].is_valid else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text string")
