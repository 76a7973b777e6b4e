"""Quality classifier by co-training of two views.

The text view describes a whole text by the square roots of its byte shares and by shares of words, lines and
repeats; the metadata view knows its language, its source and its length class only. A logistic model of each
view is fitted on labelled documents. In each round either view scores all documents beyond that sample and
labels those that it is surest of (calibrated probability at or beyond SURE, PER_ROUND for each label), and the
other view is fitted anew with them. Last, either view is calibrated on labelled documents set aside, and the two
are combined as independent given the label: the sum of their log-odds less the log-odds of the label's share.
All documents are scored.

Labels are learnt from a bounded sample: MAX_ROWS documents of each label at most, those with the smallest hashes
of their ids, one row for each id. The rounds look at all rows; each task returns its surest ones, so that at most
4 x PER_ROUND of them reach the driver in a round.

Defined cases: a null text counts as empty, a text of any length is read whole; null language, source and length
are classes of their own; null labels and ids, and ids with both labels, aren't learnt from; of an id that occurs
in several rows one is learnt from (by the hash of its values), and ties of sureness go by a hash of the id;
without both labels each score is the share of label 1 (1 with no labels, so nothing is rejected); repeated rows
are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm import common

MAX_ROWS, ROUNDS, PER_ROUND, SURE = 3000, 3, 200, 0.97
#: Score from which a document is kept.
CUT = 0.5
LANGS, SOURCES, LENGTHS = 16, 128, 24
_WHITE = b" \t\n\v\f\r"


def text_view(text: str | None) -> np.ndarray:
    """Features of the content."""
    raw = (text or "").encode("utf-8", "replace")
    share = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw)))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip(_WHITE)]
    n, k = max(1, len(words)), max(1, len(lines))
    own = [np.log1p(len(words)) / 8, len(raw) / n / 20, len(set(words)) / n, len(set(lines)) / k, np.log1p(n / k) / 5, sum(map(len, lines)) / max(1, len(raw))]
    return np.concatenate([share, np.minimum(own, 4)]).astype(np.float32)


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Indicators of language, source and length class."""
    out = np.zeros(LANGS + SOURCES + LENGTHS, np.float32)
    out[zlib.crc32(f"lang {lang}".encode("utf-8", "replace")) % LANGS] = 1
    out[LANGS + zlib.crc32(f"source {source}".encode("utf-8", "replace")) % SOURCES] = 1
    out[LANGS + SOURCES + (0 if n_chars is None else min(LENGTHS - 1, 1 + max(0, int(n_chars)).bit_length()))] = 1
    return out


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a ridge; calibrated by slope and shift."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 3.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]).astype(np.float64)
        self.w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        keep[-1] = 1e-3
        for _ in range(12):
            p = sigmoid(z @ self.w)
            s = p * (1 - p) + 1e-6
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * self.w)
            self.w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        self.slope, self.shift = 1.0, 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]
        return self.slope * z + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = 1.0, 0.0
        z = self.logit(x)
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(40):
            p = sigmoid(a * z + b)
            s = p * (1 - p) + 1e-9
            g = np.array([((p - t) * z).sum() + 0.1 * (a - 1), (p - t).sum()])
            h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
            d = np.linalg.solve(h, g)
            a, b = a - np.clip(d[0], -0.5, 0.5), b - np.clip(d[1], -1, 1)
        if a <= 0:  # the view says nothing about these documents: their share for all
            a, b = 0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        self.slope, self.shift = float(a), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: What a view learns from beyond the sample: label and features of both views by id.
Extra = dict[int, tuple[int, np.ndarray, np.ndarray]]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, surest: Callable[[list[Logistic], list[Extra]], list[Extra]]) -> tuple[Logistic, Logistic, float]:
    """The two calibrated models and the log-odds of label 1.

    surest takes the models of a round and what either view has learnt from so far; it returns what each view gets
    from the other one.
    """
    aside = np.arange(len(y)) % 4 == 3
    if len(y) < 40 or y[aside].min() == y[aside].max() or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    check = aside if aside.any() else np.ones(len(y), bool)
    extra: list[Extra] = [{}, {}]
    for n in range(ROUNDS + 1):
        models = []
        for v in (0, 1):
            more = [extra[v][i] for i in sorted(extra[v])]
            m = Logistic(np.array([*views[v][~aside], *(r[1 + v] for r in more)]), np.array([*y[~aside], *(r[0] for r in more)], float))
            m.calibrate(views[v][check], y[check])
            models.append(m)
        if n < ROUNDS:
            extra = [old | new for old, new in zip(extra, surest(models, extra), strict=True)]
    return models[0], models[1], float(np.log(y.mean() / (1 - y.mean())))


def both_views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t = np.array([text_view(x.as_py()) for x in b.column("text")], np.float32).reshape(b.num_rows, 256 + 6)
    m = [meta_view(*(x.as_py() for x in r)) for r in zip(b.column("lang"), b.column("source"), b.column("n_chars"), strict=True)]
    return t, np.array(m, np.float32).reshape(b.num_rows, LANGS + SOURCES + LENGTHS)


#: A candidate: which view labels what (view * 2 + label), its sureness below zero, hash and number of its id, features.
_SURE = "which int, less double, key long, doc_id long, t binary, m binary"


def _first(rows: list[tuple], n: int) -> list[tuple]:
    """The n first rows of distinct ids."""
    out, seen = [], set()
    for r in sorted(rows):
        if r[3] not in seen:
            seen.add(r[3])
            out.append(r)
    return out[:n]


def surest_rows(docs: DataFrame, models: list[Logistic], passed: tuple[set[int], set[int]]) -> list[tuple]:
    """Of all rows, for each view and label the PER_ROUND surest ones whose ids the other view isn't to pass over."""
    held = docs.sparkSession.sparkContext.broadcast((models, passed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (models, passed), best = held.value, [[] for _ in range(4)]
        for b in common.text_batches(batches):
            ids, views = b.column("doc_id").to_pylist(), both_views(b)
            for v in (0, 1):
                p = np.round(sigmoid(models[v].logit(views[v])), 9)
                for label, sure in ((0, 1 - p), (1, p)):
                    own = best[v * 2 + label]
                    for i in np.flatnonzero(sure >= SURE):
                        if ids[i] is not None and ids[i] not in passed[1 - v]:
                            own.append((v * 2 + label, -float(sure[i]), zlib.crc32(str(ids[i]).encode()), ids[i], views[0][i].tobytes(), views[1][i].tobytes()))
                    if len(own) > 4 * PER_ROUND:
                        best[v * 2 + label] = _first(own, PER_ROUND)
        rows = [r for own in best for r in _first(own, PER_ROUND)]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("which", "less", "key", "doc_id", "t", "m"), r, strict=True)) for r in rows], schema=_sure_schema())

    common.ship(docs.sparkSession)
    found = docs.mapInArrow(run, _SURE)
    one = found.groupBy("which", "doc_id").agg(F.min(F.struct("less", "key", "t", "m")).alias("r"))
    rank = Window.partitionBy("which", "lane").orderBy("r.less", "r.key", "doc_id")
    # First in lanes, so that no task ranks what all tasks have found.
    lanes = one.withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rk", F.row_number().over(rank)).where(F.col("rk") <= PER_ROUND)
    last = Window.partitionBy("which").orderBy("r.less", "r.key", "doc_id")
    top = lanes.withColumn("rk", F.row_number().over(last)).where(F.col("rk") <= PER_ROUND)
    return sorted((r["which"], r["r"]["less"], r["r"]["key"], r["doc_id"], bytes(r["r"]["t"]), bytes(r["r"]["m"])) for r in top.collect())


def _sure_schema() -> pa.Schema:
    return pa.schema([("which", pa.int32()), ("less", pa.float64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("t", pa.binary()), ("m", pa.binary())])


def gains(rows: list[tuple]) -> list[Extra]:
    """What each view gets: rows that the other one is sure of."""
    out: list[Extra] = [{}, {}]
    for which, _, _, ident, t, m in rows:
        out[1 - which // 2][ident] = (which % 2, np.frombuffer(t, np.float32), np.frombuffer(m, np.float32))
    return out


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, y and both views, as bytes."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        t, m = (pa.array([r.tobytes() for r in x], pa.binary()) for x in both_views(b))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), t, m], names=["doc_id", "y", "t", "m"])

    return common.map_batches(docs.select("doc_id", "y", "text", "lang", "source", "n_chars"), fn, "doc_id long, y int, t binary, m binary")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Logistic, Logistic, float, float] | float:
    """Models, prior of the sample and its shift to all labelled documents; or the share of label 1 where there is one label only."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    total = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(total) < 2:
        return 0.0 if 0 in total else 1.0
    own = _plain(docs)
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS) for y in (0, 1)]
    # At most 2 x MAX_ROWS rows of two integers, so they may be broadcast; then one row for each id.
    met = own.join(F.broadcast(some[0].union(some[1])), "doc_id")
    met = met.groupBy("doc_id", "y").agg(F.min_by(F.struct("text", "lang", "source", "n_chars"), F.xxhash64("text", "lang", "source", "n_chars", F.col("text").isNull(), F.col("lang").isNull())).alias("r"))
    rows = _features(met.select("doc_id", "y", "r.*")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return total[1] / (total[0] + total[1])
    t, m = (np.array([np.frombuffer(r[c], np.float32) for r in rows]) for c in ("t", "m"))
    y = np.array([r["y"] for r in rows], float)
    if y.min() == y.max():
        return total[1] / (total[0] + total[1])
    sample = {r["doc_id"] for r in rows}

    def surest(models: list[Logistic], extra: list[Extra]) -> list[Extra]:
        return gains(surest_rows(own, models, tuple(sample | set(e) for e in extra)))

    a, b, prior = co_train((t, m), y, surest)
    return a, b, prior, float(np.log(total[1] / total[0])) - prior


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score (chance of quality 1), kept."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        model = held.value
        if isinstance(model, float):
            out = [np.full(b.num_rows, model)] * 3
        else:
            text, meta, prior, shift = model
            t, m = both_views(b)
            zt, zm = text.logit(t), meta.logit(m)
            out = [sigmoid(zt + shift), sigmoid(zm + shift), sigmoid(zt + zm - prior + shift)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.round(x, 9)) for x in out), pa.array(out[2] >= CUT)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return common.map_batches(_plain(docs), fn, "doc_id long, text_score double, meta_score double, score double, kept boolean")
