"""Explanations of a classifier's predictions: Shapley values of the words of a window, from seeded permutations.

The game's players are the different words of a window; a set of players stands for the window's features that need no other word: its words, and
its pairs of neighbours of which both are in the set. Its worth is the logit of the predicted label less the mean of the
others'. A permutation adds words one by one, and what each adds is taken from running sums, so a permutation costs
as much as the window has features. Permutations come in pairs, one the other's reverse. In each the gains add
up to the worth of the whole window less that of none, and so do their means, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.classifier import Classifier, featured
from lexispark.session import ship


def margin(weights: np.ndarray, label: int) -> np.ndarray:
    """For each feature (the bias last) its weight for the label, less the mean of those for the others."""
    others = np.delete(weights, label, axis=1)
    return weights[:, label] - (others.mean(axis=1) if others.shape[1] else 0.0)


def gains(words: list[int], features: list[int], order: list[int], weight: np.ndarray) -> np.ndarray:
    """What each player adds in an order. words: the player of each token; features: those of the tokens, then those of neighbours."""
    n = len(words)
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    there, count = [False] * n, {}
    total, size, worth = 0.0, 0, 0.0
    out = np.zeros(len(places))
    for player in order:
        for i in places[player]:
            there[i] = True
            new = [i]
            if i and there[i - 1]:
                new.append(n + i - 1)
            if i + 1 < n and there[i + 1]:
                new.append(n + i)
            for at in new:
                f = features[at]
                c = count.get(f, 0)
                count[f] = c + 1
                total += ((c + 1) ** 0.5 - c**0.5) * weight[f]
                size += 1
        # Values are square roots of counts, brought to length 1.
        now = total / size**0.5
        out[player] = now - worth
        worth = now
    return out


def gains_of(words: list[int], features: list[int], orders: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """gains() for many orders at once: a row for each.

    A feature comes in with the last player that it needs. The same features in the order of these times have the same counts before
    them in all orders, so what each adds is known; sums by time and their running sums are the worths.
    """
    own, x = np.array(words), np.array(features)
    players, every = orders.shape[1], np.arange(len(orders))[:, None]
    time = np.empty_like(orders)
    time[every, orders] = np.arange(players)
    tokens = time[:, own]
    when = np.concatenate([tokens, np.maximum(tokens[:, :-1], tokens[:, 1:])], axis=1)
    names, kind, times = np.unique(x, return_inverse=True, return_counts=True)
    when = np.sort(kind * players + when, axis=1) - np.sort(kind) * players
    before = np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
    adds = (np.sqrt(before + 1) - np.sqrt(before)) * np.repeat(weight[names], times)
    at = (every * players + when).ravel()
    total = np.bincount(at, np.tile(adds, len(orders)), orders.size).reshape(orders.shape).cumsum(axis=1)
    size = np.bincount(at, minlength=orders.size).reshape(orders.shape).cumsum(axis=1)
    out = np.empty(orders.shape)
    out[every, orders] = np.diff(total / np.sqrt(size), axis=1, prepend=0.0)
    return out


def shapley(words: list[int], features: list[int], weight: np.ndarray, pairs: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the players, and the standard error of each over the pairs of permutations."""
    players, rng = max(words) + 1, np.random.default_rng(seed)
    orders = np.array([rng.permutation(players) for _ in range(pairs)])
    each = (gains_of(words, features, orders, weight) + gains_of(words, features, orders[:, ::-1], weight)) / 2
    return each.mean(axis=0), each.std(axis=0, ddof=1) / pairs**0.5 if pairs > 1 else np.zeros(players)


def explained(model: Classifier, rows: DataFrame, key: list[str], pairs: int = 8, top: int = 5, seed: int = 42) -> DataFrame:
    """(key, pred, word, value, spread, worth): the words of each window that count most for its prediction, and the worth of the whole window.

    rows have the key's columns (whole numbers) and tokens. top limits the report alone, 0 for all words. A window without words has no rows.
    """
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(model.weights)
    labels = model.labels
    words = F.transform("tokens", lambda w: F.lower(w)).alias("words")
    own = featured(rows.select(*(F.col(c).cast("long") for c in key), words, "tokens"), model.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        margins = [margin(weights, c) for c in range(len(labels))]
        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(len(key))), strict=True))
            out: list[tuple] = []
            for k, tokens, x in zip(ids, b.column(len(key)).to_pylist(), b.column(len(key) + 1).to_pylist(), strict=True):
                if not tokens:
                    continue
                names = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
                feature, count = np.unique(x, return_counts=True)
                logit = weights[feature].T @ (np.sqrt(count) / len(x) ** 0.5) + weights[-1]
                pred = int(logit.argmax())
                value, spread = shapley([names[w] for w in tokens], x, margins[pred], pairs, [seed, *(abs(i or 0) for i in k)])
                worth = float(logit[pred] - (np.delete(logit, pred).mean() if len(logit) > 1 else 0.0) - margins[pred][-1])
                order = np.argsort(-np.abs(np.round(value, 9)), kind="stable")[: top or None]
                listed = list(names)
                out += [(*k, labels[pred], listed[i], float(value[i]), float(spread[i]), worth) for i in order.tolist()]
            kinds = [*[pa.int64()] * len(key), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[*key, "pred", "word", "value", "spread", "worth"])

    return own.mapInArrow(run, ", ".join([*(f"{c} long" for c in key), "pred string, word string, value double, spread double, worth double"]))
