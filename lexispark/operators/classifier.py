"""A trained sequence classifier: softmax regression over hashed words and word pairs of windows, fitted by mini-batches.

Rows are hashed to arrays of feature numbers by column functions and written once, by split and mini-batch. A step reads one
mini-batch: each task adds up the gradient of its rows, Spark adds up the tasks' sums by feature, and the driver, which
holds the weights (WEIGHTS numbers at most), takes an AdamW step: warm-up and linear decay of the rate, decoupled weight decay. After
each epoch the validation rows are scored; the weights of the epoch with the best weighted F1 are kept, and training ends
after `patience` epochs without a better one.

Counters of each epoch (rows and features that the tasks have worked on, seconds) come from DataFrame.observe.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexispark.session import remove, scratch, ship

#: Most weights of a model, as the driver and each task hold them.
WEIGHTS = 1 << 24
HISTORY = "epoch int, steps int, loss double, val_loss double, accuracy double, f1_macro double, f1_weighted double, best boolean, samples long, features long, seconds double"


@dataclass
class Config:
    """Parameters of a training run."""

    epochs: int = 3
    batches: int = 8
    rate: float = 0.3
    decay: float = 0.01
    warmup: int = 2
    patience: int = 3
    bits: int = 14
    seed: int = 42


def hashed(tokens: Column, bits: int) -> tuple[Column, Column]:
    """Words in lower case (to be named _words), and feature numbers of these and of each two neighbours; repeats stay."""
    words = F.transform(tokens, lambda w: F.lower(w))
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << bits)).cast("int")
    both = F.transform(F.sequence(F.lit(1), F.size("_words") - 1), lambda i: place(F.get("_words", i - 1), F.get("_words", i)))
    return words, F.concat(F.transform("_words", lambda w: place(w)), F.when(F.size("_words") > 1, both).otherwise(F.array().cast("array<int>")))


def featured(rows: DataFrame, bits: int) -> DataFrame:
    """rows with an array column tokens get an array x of feature numbers in its place."""
    words, x = hashed(F.col("tokens"), bits)
    return rows.withColumn("_words", words).withColumn("x", x).drop("_words", "tokens")


def sparse(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of lists of feature numbers: square roots of counts, each row of length 1."""
    n = len(x)
    lengths = np.diff(x.offsets.to_numpy())
    row, flat = np.repeat(np.arange(n), lengths), x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pair, count = np.unique(row * (1 << 32) + flat, return_counts=True)
    row, flat, value = pair >> 32, pair & 0xFFFFFFFF, np.sqrt(count)
    norm = np.sqrt(np.bincount(row, value * value, n))
    return row, flat, value / norm[row]


def logits(weights: np.ndarray, row: np.ndarray, flat: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Weights has a row for each feature and a last one, the bias."""
    out = np.stack([np.bincount(row, weights[flat, c] * value, n) for c in range(weights.shape[1])], axis=1)
    return out + weights[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(weights: np.ndarray, label: np.ndarray, x: pa.Array) -> tuple[float, np.ndarray]:
    """Sum of the rows' cross entropy and its gradient."""
    n = len(label)
    row, flat, value = sparse(x)
    p = softmax(logits(weights, row, flat, value, n))
    loss = -float(np.log(np.maximum(p[np.arange(n), label], 1e-300)).sum())
    p[np.arange(n), label] -= 1
    out = np.zeros_like(weights)
    for c in range(weights.shape[1]):
        out[:-1, c] = np.bincount(flat, value * p[row, c], len(weights) - 1)
    out[-1] = p.sum(axis=0)
    return loss, out


def step_sums(rows: DataFrame, weights: np.ndarray) -> tuple[int, float, np.ndarray, int]:
    """(rows, loss, gradient, features) summed over the rows (label, x); the gradient of each task is reduced by feature."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(weights)
    classes = weights.shape[1]
    names = [f"g{c}" for c in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros_like(held.value), 0.0, 0
        for b in batches:
            one, g = gradient(held.value, b.column(0).to_numpy(zero_copy_only=False), b.column(1))
            total, loss, n = total + g, loss + one, n + b.num_rows
        if n:
            at = np.flatnonzero(total.any(axis=1))
            # Two more rows carry the loss and the number of rows.
            table = np.concatenate([total[at], np.full((1, classes), loss), np.full((1, classes), float(n))])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]).astype(np.int32)), *(pa.array(table[:, c]) for c in range(classes))], names=["i", *names])

    seen = Observation()
    counted = rows.select("label", "x").observe(seen, F.count(F.lit(1)).alias("samples"), F.sum(F.size("x")).alias("features"))
    found = counted.mapInArrow(run, ", ".join(["i int", *(f"{g} double" for g in names)])).groupBy("i").agg(*(F.sum(g).alias(g) for g in names)).toArrow()
    held.destroy()
    at = found.column("i").to_numpy()
    table = np.stack([found.column(g).to_numpy() for g in names], axis=1) if len(at) else np.zeros((0, classes))
    out = np.zeros_like(weights)
    out[at[at >= 0]] = table[at >= 0]
    pick = lambda k: float(table[at == k][0, 0]) if (at == k).any() else 0.0
    return int(pick(-2)), pick(-1), out, int(seen.get["features"] or 0)


@dataclass
class AdamW:
    """The optimiser's state on the driver."""

    config: Config
    steps: int
    at: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None

    def rate(self) -> float:
        """Linear warm-up, then linear decay to zero at the last step."""
        c = self.config
        if self.at < c.warmup:
            return c.rate * (self.at + 1) / c.warmup
        return c.rate * max(0.0, (self.steps - self.at) / max(1, self.steps - c.warmup))

    def step(self, weights: np.ndarray, g: np.ndarray) -> np.ndarray:
        rate = self.rate()
        self.m = 0.1 * g if self.m is None else 0.9 * self.m + 0.1 * g
        self.v = 0.001 * g * g if self.v is None else 0.999 * self.v + 0.001 * g * g
        self.at += 1
        mean, square = self.m / (1 - 0.9**self.at), self.v / (1 - 0.999**self.at)
        kept = weights * (1 - rate * self.config.decay)
        kept[-1] = weights[-1]  # the bias does not decay
        return kept - rate * mean / (np.sqrt(square) + 1e-8)


@dataclass
class Classifier:
    """Labels in order, weights, and what happened in each epoch (rows as HISTORY names them)."""

    labels: list[str]
    bits: int
    weights: np.ndarray
    history: list[tuple] = field(default_factory=list)

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (with tokens or x) get pred, confidence and probs, an array in the order of the labels."""
        rows = featured(rows, self.bits) if "tokens" in rows.columns else rows
        keep = [f for f in rows.schema if f.name != "x"]
        ship(rows.sparkSession)
        held, labels = rows.sparkSession.sparkContext.broadcast(self.weights), self.labels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = softmax(logits(held.value, *sparse(b.column(b.num_columns - 1)), b.num_rows))
                best = p.argmax(axis=1)
                probs = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([labels[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]), probs], names=[*b.schema.names[:-1], "pred", "confidence", "probs"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "pred string", "confidence double", "probs array<double>"])
        return rows.select(*(f.name for f in keep), "x").mapInArrow(run, schema)

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY)


def batch_order(epoch: int, config: Config) -> list[int]:
    """The order of the mini-batches in an epoch."""
    return np.random.default_rng([config.seed, epoch]).permutation(config.batches).tolist()


def train(rows: DataFrame, key: list[str], config: Config | None = None) -> Classifier:
    """Fits on rows (author, split, tokens, and the key's columns) with split train; validation rows choose the epoch.

    A row's mini-batch is the hash of its key, so it does not depend on partitions. Labels are the train rows' authors.
    """
    config = config or Config()
    spark = rows.sparkSession
    names = [r[0] for r in rows.where("split = 'train'").select("author").where("author is not null").distinct().orderBy("author").limit(WEIGHTS >> config.bits).collect()]
    if not names or len(names) * (1 << config.bits) >= WEIGHTS:
        raise ValueError("no labels, or more than the model may have")
    label = F.array_position(F.array(*(F.lit(a) for a in names)), F.col("author")).cast("int") - 1
    folder = scratch(spark, "training")
    try:
        table = featured(rows, config.bits).withColumn("label", label).where("label >= 0")
        table = table.withColumn("batch", F.pmod(F.xxhash64(F.lit(config.seed), *key), F.lit(config.batches)).cast("int"))
        table.select("split", "batch", "author", "label", "x").write.partitionBy("split", "batch").parquet(folder)
        data = spark.read.parquet(folder)
        model = Classifier(names, config.bits, np.zeros(((1 << config.bits) + 1, len(names))))
        optimiser, best, score, idle = AdamW(config, config.epochs * config.batches), model.weights, -1.0, 0
        for epoch in range(config.epochs):
            began, n, loss, features = time.time(), 0, 0.0, 0
            for b in batch_order(epoch, config):
                m, lost, g, seen = step_sums(data.where((F.col("split") == "train") & (F.col("batch") == b)), model.weights)
                n, loss, features = n + m, loss + lost, features + seen
                if m:
                    model.weights = optimiser.step(model.weights, g / m)
            held_out = model.scored(data.where("split = 'validation'").select("author", "label", "x"))
            truth = F.element_at("probs", F.col("label") + 1)
            both = held_out.groupBy(F.col("author").alias("truth"), "pred").agg(F.count(F.lit(1)).alias("cnt"), F.sum(-F.log(F.greatest(truth, F.lit(1e-300)))).alias("lost")).collect()
            accuracy, macro, weighted = f1_scores([(r["truth"], r["pred"], r["cnt"]) for r in both])
            total = sum(r["cnt"] for r in both)
            better = weighted > score
            model.history.append((epoch + 1, optimiser.at, loss / max(n, 1), sum(r["lost"] for r in both) / max(total, 1), accuracy, macro, weighted, better, n, features, time.time() - began))
            best, score, idle = (model.weights, weighted, 0) if better else (best, score, idle + 1)
            if idle >= config.patience:
                break
        model.weights = best
        return model
    finally:
        remove(spark, folder)


def f1_scores(counts: list[tuple[str, str, int]]) -> tuple[float, float, float]:
    """Accuracy, macro and weighted F1 from (truth, pred, count); all zero without rows."""
    total = sum(n for *_, n in counts)
    if not total:
        return 0.0, 0.0, 0.0
    labels = {x for t, p, _ in counts for x in (t, p)}
    f1, support = {}, {}
    for a in labels:
        tp = sum(n for t, p, n in counts if t == p == a)
        support[a], guessed = sum(n for t, _, n in counts if t == a), sum(n for _, p, n in counts if p == a)
        f1[a] = 2 * tp / (support[a] + guessed)
    return sum(n for t, p, n in counts if t == p) / total, sum(f1.values()) / len(labels), sum(f1[a] * support[a] for a in labels) / total
