"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embeddings; a word's vector is the sum of the vectors of the word and of its first four
characters, so that unseen forms of a known stem are near it. Filters of several widths slide over the words,
each filter is pooled to its TOP largest values in the document (max pooling in TOP ranks, as words of a stem may stand once in clean
texts and often in toxic ones), and a linear layer gives the logit. Whole texts
are scored, in pieces that overlap by the widest filter, so memory doesn't grow with a text.

Learnt from all labelled documents, one row for each id, whatever their number and length. They are dealt by the hash of the id to
shards of some SHARD_ROWS rows or SHARD_WORDS words, each the work of one task. One shard is learnt from in one go. Where there are several, all
begin with the same weights, each task learns from a part of its shard, and the weights are averaged over the shards, ROUNDS times in
all passes; a word's vector is averaged over the shards that met the word. FOLDS other models, trained beside it in tasks of their own,
each without a part of every shard, give logits of that part, and these calibrate: first the score (a logistic fit,
corrected for labels without documents), then a threshold for each language, the lowest one at which the
precision among the labelled documents of that language is at least PRECISION, from FLOOR to CEILING. Logits are rounded to
PLACES places and counted for that, so that the driver gets a row for each value, not for each document. A language with p positive
documents takes p / (p + SHRINK) of its own threshold and the rest of that over all languages. Scores are then moved so that
the threshold over all languages is CUT, as few labels give scores that are too low for a fixed cut. Language, source,
id and labels are no inputs of a score.

Defined cases: a null text counts as empty; a text without words gets the score of the linear layer's bias;
a null toxic label or id and an id with both labels aren't used; of an id that occurs in several rows one is learnt
from (by the hash of its values); without both labels all scores are the share of label 1 (0 with no labels);
a null language takes the threshold of all languages; repeated rows and ties are scored alike; an empty table gives
no rows; texts of any length are scored whole; extra columns are ignored by the digest and kept by reject().
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import common

#: Labelled rows and words of a shard, on average; how often weights are averaged, where there are several shards.
SHARD_ROWS, SHARD_WORDS, ROUNDS = 16_384, 6_000_000, 8
#: Most words that filters slide over at once; longer texts go in pieces.
MAX_WORDS = 1 << 16
#: Hash buckets, embedding size, filter widths, filters of each width, passes over the labelled rows; few rows get passes up to LEAST_STEPS batches; ranks of pooling, deviation of first embeddings.
BUCKETS, DIM, WIDTHS, FILTERS, EPOCHS = 1 << 15, 12, (1, 2, 3), 16, 2
LEAST_STEPS, REACH, TOP, SPREAD = 520, max(WIDTHS) - 1, 3, 0.02
#: Rows of the table of embeddings that are averaged together, places of a logit for calibration.
BLOCK, PLACES = 1024, 3
#: Parts for calibration; precision that a threshold keeps, positive documents that weigh as much as all languages, range of thresholds.
FOLDS, PRECISION, SHRINK, FLOOR, CEILING = 3, 0.97, 20, 0.3, 0.9
#: The score from which a document is predicted toxic.
CUT = 0.7
_PAD = BUCKETS * 2
_WORD = re.compile(r"\w+")
_CACHE: dict[str, int] = {}


def word_ids(text: str | None) -> np.ndarray:
    """A number for each word: its bucket and the bucket of its first four characters."""
    words = _WORD.findall((text or "").lower())
    out = list(map(_CACHE.get, words))
    if None in out:
        if len(_CACHE) > 100_000:
            _CACHE.clear()
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                whole = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
                stem = zlib.crc32(b"^" + w[:4].encode("utf-8", "replace")) % BUCKETS
                out[i] = _CACHE[w] = whole << 16 | stem
    return np.array(out, np.int64)


@dataclass
class Model:
    """Weights, calibration and thresholds."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    overall: float = CUT
    moved: float = 0.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        whole, stem = np.where(ids < 0, _PAD, ids >> 16), np.where(ids < 0, _PAD, (ids & 0xFFFF) + BUCKETS)
        return self.table[whole] + self.table[stem]

    def pooled(self, docs: list[np.ndarray], piece: int = MAX_WORDS) -> np.ndarray:
        """The largest values of all filters in each document: TOP of the first filter, of the second, ..."""
        out = np.zeros((len(docs), len(WIDTHS) * FILTERS, TOP), np.float32)
        batch, owner, count, held = [], [], [], 0
        for d, ids in enumerate(docs):
            for at in range(0, max(1, len(ids)), piece):
                batch.append(ids[at : at + piece + REACH])
                owner.append(d)
                count.append(min(piece, len(ids) - at))
                held += len(batch[-1])
                if held >= piece:
                    self._pool(batch, owner, count, out)
                    batch, owner, count, held = [], [], [], 0
        if batch:
            self._pool(batch, owner, count, out)
        return out.reshape(len(docs), len(WIDTHS) * FILTERS * TOP)  # no -1: there may be no documents

    def _pool(self, batch: list[np.ndarray], owner: list[int], count: list[int], out: np.ndarray) -> None:
        flat, bounds = joined(batch, count)
        acts = self.activations(flat, bounds)[0]
        for i, d in enumerate(owner):
            if i and owner[i - 1] == d or out[d].any():  # the largest of what other pieces of the text gave
                both = np.concatenate([out[d], acts[i]], axis=1)
                out[d] = -np.sort(-both, axis=1)[:, :TOP]
            else:
                out[d] = acts[i]

    def activations(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Pooled values (documents x filters x TOP), the words' vectors, and for each width where the values are (TOP x documents x filters).

        Only windows that begin within the bounds count; of equal values the first; where there are fewer windows the rest are zero."""
        x = self.embed(flat)
        cols, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            y = x @ f[0]
            for k in range(1, w):
                y[: len(x) - k] += x[k:] @ f[k]
            y += b
            ranks, at = np.empty((TOP, len(bounds) // 2, FILTERS), np.float32), np.empty((TOP, len(bounds) // 2, FILTERS), np.int64)
            every = np.arange(FILTERS)
            for d, (s, e) in enumerate(bounds.reshape(-1, 2).tolist()):
                own = y[s:e]
                for r in range(TOP):
                    i = own.argmax(axis=0)
                    ranks[r, d], at[r, d] = own[i, every], i + s
                    own[i, every] = -np.inf
            cols.append(np.moveaxis(ranks, 0, 2))
            places.append(at)
        return np.maximum(np.concatenate(cols, axis=1), 0), x, places

    def tops(self, flat: np.ndarray, bounds: np.ndarray, piece: int = MAX_WORDS) -> tuple[np.ndarray, list[np.ndarray]]:
        """Values and places of activations(), with the filters applied to so many words at once."""
        if len(flat) <= piece:
            values, _, places = self.activations(flat, bounds)
            return values, places
        ends = bounds.reshape(-1, 2).tolist()
        values = np.zeros((len(ends), len(WIDTHS) * FILTERS, TOP), np.float32)
        places = [np.zeros((TOP, len(ends), FILTERS), np.int64) for _ in WIDTHS]
        spans = [(d, s, min(s + piece, e)) for d, (low, e) in enumerate(ends) for s in range(low, e, piece)]
        while spans:
            begin, n = spans[0][1], 1
            while n < len(spans) and spans[n][2] - begin <= piece:
                n += 1
            now, spans = spans[:n], spans[n:]
            found, _, at = self.activations(flat[begin : now[-1][2] + REACH], np.array([(s - begin, e - begin) for _, s, e in now]).ravel())
            for i, (d, s, _) in enumerate(now):
                new = np.concatenate([p[:, i] for p in at], axis=1).T + begin
                if s > ends[d][0]:  # the largest of what the pieces of a text gave, of equal values the first
                    both = np.concatenate([values[d], found[i]], axis=1)
                    new = np.concatenate([np.concatenate([p[:, d] for p in places], axis=1).T, new], axis=1)
                    best = np.argsort(-both, axis=1, kind="stable")[:, :TOP]
                    values[d], new = np.take_along_axis(both, best, axis=1), np.take_along_axis(new, best, axis=1)
                else:
                    values[d] = found[i]
                for k, p in enumerate(places):
                    p[:, d] = new[k * FILTERS : (k + 1) * FILTERS].T
        return values, places

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pooled(docs).astype(np.float64) @ self.out + self.bias

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        return sigmoid(self.slope * self.logits(docs) + self.shift)

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.overall)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def joined(docs: list[np.ndarray], count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The documents in one flat array, each followed by padding as wide as a filter's reach, so that no window reaches
    into the next one; where each begins and ends in turn. With count only the first so many words begin a window."""
    pad = np.full(REACH, -1, np.int64)
    parts = [x for d in docs for x in (d if len(d) else pad[:1], pad)]
    size = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate([[0], np.cumsum(size + REACH)[:-1]])
    ends = starts + (size if count is None else np.maximum(1, np.minimum(size, count)))
    return np.concatenate(parts), np.column_stack([starts, ends]).ravel()


class Learner:
    """A model in training. Minimises the logistic loss: Adam for the filters and the linear layer, Adagrad for touched embeddings."""

    def __init__(self, seed: int = 0):
        self.rng = rng = np.random.default_rng(seed)
        # Vectors begin small, so that words which were never learnt hardly reach the largest values of a text.
        table = rng.normal(0, SPREAD, (_PAD + 1, DIM)).astype(np.float32)
        table[_PAD] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.model = m = Model(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS * TOP), 0.0)
        self.first, self.second, self.step, self.seen = [np.zeros_like(p) for p in self._dense()], [np.zeros_like(p) for p in self._dense()], 0, np.full(len(m.table), 1e-3, np.float32)

    def _dense(self) -> list[np.ndarray]:
        return [*self.model.filters, *self.model.biases, self.model.out]

    def numbers(self) -> np.ndarray:
        """All but the embeddings, in one array."""
        return np.concatenate([*(np.ravel(x).astype(np.float64) for x in (*self._dense(), *self.first, *self.second)), [self.model.bias, self.step]])

    def take(self, numbers: np.ndarray) -> None:
        """Sets what numbers() gives."""
        at = 0
        for x in (*self._dense(), *self.first, *self.second):
            x[...] = numbers[at : at + x.size].reshape(x.shape)
            at += x.size
        self.model.bias, self.step = float(numbers[at]), float(numbers[at + 1])

    def learn(self, docs: list[np.ndarray], labels: np.ndarray, order: np.ndarray) -> None:
        """One pass over the documents of the order, by batches."""
        size = np.array([len(d) for d in docs])
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            pick = pick[np.argsort(size[pick])]
            self._batch([docs[i] for i in pick], labels[pick])

    def _batch(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        m, rng = self.model, self.rng
        flat, bounds = joined(docs)
        h, places = m.tops(flat, bounds)
        h = h.reshape(len(docs), -1)
        keep = (rng.random(h.shape) < 0.8) / 0.8
        p = sigmoid((h * keep) @ m.out + m.bias)
        g = (p - labels) / len(docs)
        gh = (g[:, None] * m.out * keep * (h > 0)).reshape(len(docs), -1, TOP).astype(np.float32)
        grads: list[np.ndarray] = []
        where, what = [], []
        for n, (w, at_top) in enumerate(zip(WIDTHS, places, strict=True)):
            gf = np.zeros_like(m.filters[n])
            for r, pos in enumerate(at_top):
                gy = gh[:, n * FILTERS : (n + 1) * FILTERS, r]
                for k in range(w):
                    there = np.minimum(pos + k, len(flat) - 1)
                    gf[k] += np.einsum("dfe,df->ef", m.embed(flat[there]), gy)
                    where.append(there.ravel())
                    what.append((gy[:, :, None] * m.filters[n][k].T[None]).reshape(-1, DIM))
            grads.append(gf)
        grads += [gh[:, n * FILTERS : (n + 1) * FILTERS].sum(axis=(0, 2)) for n in range(len(WIDTHS))]
        grads.append((h * keep).T @ g + 1e-3 * m.out)
        self.step += 1
        for par, gr, a, b in zip(self._dense(), grads, self.first, self.second, strict=True):
            a += 0.1 * (gr - a)
            b += 0.01 * (gr * gr - b)
            par -= 0.01 * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.99**self.step)) + 1e-8)
        m.bias -= 0.05 * g.sum()
        # Gradients of the words that reached a rank, added up by word.
        places, values = np.concatenate(where), np.concatenate(what)
        order = np.argsort(places, kind="stable")
        hit, first = np.unique(places[order], return_index=True)
        gx = np.add.reduceat(values[order], first, axis=0)
        real = (flat[hit] >= 0) & (gx != 0).any(axis=1)
        hit, gx = flat[hit[real]], gx[real]
        for rows in (hit >> 16, (hit & 0xFFFF) + BUCKETS):
            np.add.at(self.seen, rows, (gx**2).mean(axis=1))
            np.add.at(m.table, rows, -0.1 * gx / np.sqrt(self.seen[rows])[:, None])


def passes(rows: int) -> int:
    return max(EPOCHS, min(60, LEAST_STEPS * 32 // max(1, rows)))


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """A model of documents that are held in one place."""
    own = Learner(seed)
    for _ in range(passes(len(docs))):
        own.learn(docs, labels, own.rng.permutation(len(docs)))
    return own.model


def calibrate(m: Model, z: np.ndarray, labels: np.ndarray, langs: list[str | None], odds: float, n: np.ndarray | None = None) -> None:
    """Fits slope and shift to logits of rows not learnt from by Newton steps with smoothed targets, moves by the odds, then sets thresholds; n: how many rows each stands for."""
    n = np.ones(len(z)) if n is None else n
    pos, neg = (n * labels).sum(), (n * (1 - labels)).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = n * (p * (1 - p) + 1e-9)
        g = np.array([(n * (p - target) * z).sum() + 1e-3 * (a - 1), (n * (p - target)).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    m.slope, m.shift = max(float(a), 0.05), float(b) + odds
    score = sigmoid(m.slope * z + m.shift)
    m.overall = lowest(score, labels, n)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if positive := (n * labels)[own].sum():
            share = positive / (positive + SHRINK)
            m.thresholds[lang] = float(share * lowest(score[own], labels[own], n[own]) + (1 - share) * m.overall)
    # The threshold over all languages is where CUT is: scores and thresholds move by one distance.
    m.moved = logit(CUT) - logit(m.overall)
    m.shift += m.moved
    m.thresholds = {k: float(sigmoid(np.float64(logit(t) + m.moved))) for k, t in m.thresholds.items()}
    m.overall = CUT


def lowest(score: np.ndarray, labels: np.ndarray, n: np.ndarray | None = None) -> float:
    """The lowest score at which those at or above it are right in PRECISION of cases, from FLOOR to CEILING; CUT if there is none."""
    order = np.argsort(-score, kind="stable")
    n = np.ones(len(score)) if n is None else n
    right = np.cumsum((n * labels)[order]) / np.cumsum(n[order])
    good = np.flatnonzero(right >= PRECISION)
    return float(np.clip(score[order[good[-1]]], FLOOR, CEILING) if len(good) else CUT)


@dataclass
class Coded:
    """Labelled documents as word ids: doc_id, lang, toxic, ids, shard; a partition holds whole shards, each sorted by the hash of the id."""

    rows: DataFrame
    size: int
    shards: int

    def __len__(self) -> int:
        return self.size


_STATE = "model int, block int, shard int, places binary, numbers binary"
_STATE_ARROW = pa.schema([("model", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("places", pa.binary()), ("numbers", pa.binary())])


def _changed(model: int, shard: int, old: Learner, new: Learner) -> list[tuple]:
    """What a task has learnt: all numbers as block -1, and the vectors that changed with their Adagrad sums by blocks of the table."""
    out = [(model, -1, shard, b"", new.numbers().tobytes())]
    rows = np.flatnonzero((new.seen != old.seen) | (new.model.table != old.model.table).any(axis=1)).astype(np.int32)
    both = np.column_stack([new.model.table[rows], new.seen[rows]])
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows // BLOCK)) + 1):
        if len(part):
            out.append((model, int(rows[part[0]]) // BLOCK, shard, rows[part].tobytes(), both[part].tobytes()))
    return out


def _mean(key: tuple, rows: pa.Table) -> pa.Table:
    """The mean over the shards: of all numbers, or of each vector over those shards that changed it."""
    model, block = (x.as_py() for x in key)
    own = rows.select(["shard", "places", "numbers"]).sort_by("shard").to_pylist()
    if block < 0:
        places, numbers = b"", np.mean([np.frombuffer(r["numbers"]) for r in own], axis=0)
    else:
        at = np.concatenate([np.frombuffer(r["places"], np.int32) for r in own])
        found, to = np.unique(at, return_inverse=True)
        sums = np.zeros((len(found), DIM + 1))
        np.add.at(sums, to, np.concatenate([np.frombuffer(r["numbers"], np.float32).reshape(-1, DIM + 1) for r in own]))
        places, numbers = found.tobytes(), (sums / np.bincount(to)[:, None]).astype(np.float32)
    return pa.Table.from_pylist([{"model": model, "block": block, "shard": 0, "places": places, "numbers": numbers.tobytes()}], schema=_STATE_ARROW)


def _shards(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[list[np.ndarray], np.ndarray]]:
    """Word ids and labels of each shard."""
    out: dict[int, tuple[list, list]] = {}
    for b in batches:
        for shard, toxic, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "toxic", "ids")), strict=True):
            docs, y = out.setdefault(shard, ([], []))
            docs.append(np.frombuffer(ids, np.int32))
            y.append(toxic)
    return {k: (docs, np.array(y, float)) for k, (docs, y) in out.items()}


def advance(coded: Coded, learners: list[Learner], part: int) -> None:
    """Lets each model learn from one of ROUNDS parts of what all passes over every shard are (from all of it, if there is one shard), and averages."""
    held, many, turns, rounds = coded.rows.sparkSession.sparkContext.broadcast(learners), coded.shards > 1, passes(coded.size), ROUNDS

    def run(batches: Iterator[pa.RecordBatch], model: int) -> Iterator[pa.RecordBatch]:
        for shard, (docs, y) in _shards(batches).items():
            seen = np.array([i for i in range(len(docs)) if model == FOLDS or i % FOLDS != model], int)
            docs, y, own = [docs[i] for i in seen], y[seen], copy.deepcopy(held.value[model])
            if many:
                own.rng = np.random.default_rng((part, shard))
                order = np.concatenate([np.random.default_rng((turn, shard)).permutation(len(docs)) for turn in range(turns)])
                own.learn(docs, y, order[part * len(order) // rounds : (part + 1) * len(order) // rounds])
            else:
                for _ in range(passes(len(docs))):
                    own.learn(docs, y, own.rng.permutation(len(docs)))
            rows = _changed(model, shard, held.value[model], own) if len(docs) else []
            for r in rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_STATE_ARROW.names, r, strict=True))], schema=_STATE_ARROW)

    own = coded.rows.select("shard", "toxic", "ids")
    found = reduce(DataFrame.union, (own.mapInArrow(lambda b, model=model: run(b, model), _STATE) for model in range(FOLDS + 1)))
    found = found.groupBy("model", "block").applyInArrow(_mean, _STATE) if many else found
    # One row for each model and block, whatever the number of shards.
    for r in found.collect():
        to = learners[r["model"]]
        if r["block"] < 0:
            to.take(np.frombuffer(r["numbers"]))
        else:
            places, numbers = np.frombuffer(r["places"], np.int32), np.frombuffer(r["numbers"], np.float32).reshape(-1, DIM + 1)
            to.model.table[places], to.seen[places] = numbers[:, :DIM], numbers[:, DIM]
    held.destroy()


def fitted(spark: SparkSession, coded: Coded, _counts: dict[int, int]) -> tuple[Model, list[tuple]]:
    """The model of all labelled rows, and (lang, toxic, logit, rows) by models that haven't seen the rows."""
    learners = [Learner() for _ in range(FOLDS + 1)]
    for part in range(ROUNDS if coded.shards > 1 else 1):
        advance(coded, learners, part)
    held = spark.sparkContext.broadcast([x.model for x in learners[:FOLDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for b in batches:
            fold = np.zeros(b.num_rows, int)
            for i, shard in enumerate(b.column("shard").to_pylist()):
                met[shard] = met.get(shard, -1) + 1
                fold[i] = met[shard] % FOLDS
            docs, z = [np.frombuffer(x, np.int32) for x in b.column("ids").to_pylist()], np.zeros(b.num_rows)
            for f, m in enumerate(held.value):
                own = np.flatnonzero(fold == f)
                z[own] = m.logits([docs[i] for i in own])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(np.round(np.clip(z, -40, 40), PLACES) + 0.0)], names=["lang", "toxic", "z"])

    rows = coded.rows.select("lang", "toxic", "ids", "shard").mapInArrow(run, "lang string, toxic int, z double")
    found = rows.groupBy("lang", "toxic", "z").agg(F.count(F.lit(1)).alias("n")).collect()
    held.destroy()
    # Of equal logits label 0 first, so that a threshold's precision is that of all rows at it.
    return learners[FOLDS].model, sorted(map(tuple, found), key=lambda r: (r[2], r[1], r[0] is None, r[0] or ""))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents (label column toxic)."""
    common.ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1) and doc_id is not null")
    known = common.cut(known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic"))
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    own = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    # Texts without a label stay where they are; of the others one row for each id.
    met = common.filtered(own, known, ["doc_id"], "_met", sum(total.values())).where("_met")
    one = F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text", F.col("lang").isNull()))
    texts = met.groupBy("doc_id").agg(one.alias("r")).join(known, "doc_id").select("doc_id", "toxic", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches):
            ids = [word_ids(x.as_py()).astype(np.int32) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "toxic")), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "lang", "toxic", "ids"])

    coded = common.cut(texts.select("doc_id", "lang", "toxic", "text").mapInArrow(run, "doc_id long, lang string, toxic int, ids binary"))
    sizes = {r[0]: (r[1], r[2]) for r in coded.groupBy("toxic").agg(F.count(F.lit(1)), F.sum(F.length("ids")) / 4).collect()}
    if len(sizes) < 2:
        n = sum(total.values())
        return Model(np.zeros((_PAD + 1, DIM), np.float32), [], [], np.zeros(0), 0.0, constant=total.get(1, 0) / n if n else 0.0)
    rows, words = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    shards, key = int(max(1, -(-rows // SHARD_ROWS), -(-words // SHARD_WORDS))), F.xxhash64("doc_id")
    dealt = coded.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("shard", key, "doc_id")
    m, found = fitted(docs.sparkSession, Coded(common.cut(dealt), rows, shards), {k: v[0] for k, v in sizes.items()})
    odds = np.log(total[1] / total[0]) - np.log(sizes[1][0] / sizes[0][0])
    z, y, n = (np.array([r[i] for r in found], float) for i in (2, 1, 3))
    calibrate(m, z, y, [r[0] for r in found], float(odds), n)
    return m


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns as _0, _1, ... with _score and _threshold (of the document's language)."""
    common.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in common.text_batches(batches):
            s = m.scores([word_ids(x.as_py()) for x in b.column("_text")])
            limit = [m.threshold(x.as_py()) for x in b.column("_lang")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s), pa.array(limit, pa.float64())], names=[*names, "_score", "_threshold"])

    kinds = own.schema
    schema = ", ".join(f"{n} {kinds[n].dataType.simpleString()}" for n in names)
    return own.mapInArrow(run, schema + ", _score double, _threshold double")


def held_out() -> F.Column:
    """Rows that no label is learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the language's threshold with its verdict."""
    model = fit(docs, labels.where(~held_out()))
    out = score(docs, model, ["doc_id"]).toDF("doc_id", "score", "threshold")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


@common.any_names
def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that stay below the threshold of their language."""
    model = fit(docs, labels.where(~held_out()))
    kept = score(docs, model, docs.columns).where("_score < _threshold").drop("_score", "_threshold")
    return kept.toDF(*docs.columns)
