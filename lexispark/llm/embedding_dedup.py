"""Near-duplicate embeddings by a pivot-permutation index.

Each vector is described by its NEAREST reference points (pivots) in order of cosine. The inverted lists are kept
per group of SHARED pivots of a description, within a label: two vectors meet in a list exactly if they share SHARED
of their NEAREST pivots, that is, lists are read with a shared-pivot count of at least SHARED. Candidates are
verified by cosine in double precision. Every vector is indexed.

There are more pivots for more vectors (see pivot_count), so that lists of vectors which are alike by chance stay
short. They are taken from a bounded sample, the SAMPLE vectors with the smallest hashes, so that no two are near
(APART): several in one dense group would describe its members at random. Where the sample has too few of a length,
directions drawn from a generator that is seeded with the length fill up.

Equal vectors of a label are one class, compared once, and known by a 64-bit hash of their values (a second hash
is held against it). Lists, ids and counts are shuffled as numbers; a vector goes to those lists only that hold
another one, once for each two blocks. A pair that meets in several lists counts in the list of its smallest
shared pivots only, so link counts need no pair table. Lists of any length are compared in blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a
null label, link with nothing and are components of their own; vectors of different lengths never link;
repeated ids link as rows of their own; a null vec_id is never a component_id; of ties the smaller pivot is the
nearer one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexispark.llm import common

#: Cosine at which vectors link.
COSINE = 0.98
#: Pivots in a description, and how many must be shared.
NEAREST, SHARED = 5, 3
#: Fewest pivots and most that BITS can number (for tables of a trillion vectors); vectors they are chosen from, at least and for each pivot; the cosine beyond which two are too near.
BITS = 16
PIVOTS, SAMPLE, EACH, APART = (64, 1 << BITS), 8192, 4, 0.8


def pivot_count(n: int) -> int:
    """How many pivots n vectors get: by the cube root, as lists are for groups of three."""
    return int(np.clip(round(6 * n ** (1 / 3)), *PIVOTS))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, e, rid, other): rid and other are hashes of label and vector, null for rows that link with nothing."""
    kind = vectors.schema["embedding"].dataType
    exact = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    e = F.col("embedding").cast(f"array<{exact}>")
    wide = e.cast("array<double>")
    sound = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(wide, lambda x: x != 0)
    # Zero has one sign.
    own = vectors.select(F.col("vec_id").cast("long"), "label", F.transform(e, lambda x: x + F.lit(0.0).cast(exact)).alias("e"), (sound & F.col("label").isNotNull()).alias("sound"))
    one = lambda *c: F.when(F.col("sound"), F.xxhash64(*c))
    return told_apart(own.select("vec_id", "label", "e", one("label", "e").alias("rid"), one(F.lit("other"), "label", "e").alias("other")))


def told_apart(own: DataFrame) -> DataFrame:
    """Rows of which some share rid and not other: these get an rid of both. They are few, by chance one pair in billions of vectors."""
    mixed = own.where("rid is not null").groupBy("rid").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
    found = common.cut(mixed.select(F.col("rid").alias("_rid")))
    if found.isEmpty():
        return own
    met = own.join(found, F.col("rid") == F.col("_rid"), "left")
    return met.withColumn("rid", F.when(F.col("_rid").isNotNull(), F.xxhash64("rid", "other", F.lit("apart"))).otherwise(F.col("rid"))).drop("_rid")


def classes(own: DataFrame) -> DataFrame:
    """(rid, label, e, copies): distinct vectors that can link."""
    g = own.where("rid is not null").groupBy("rid").agg(F.first(F.struct("label", "e")).alias("v"), F.count(F.lit(1)).alias("copies"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("copies")).otherwise(F.raise_error(F.lit("two vectors have one hash")).cast("long"))
    return g.select("rid", "v.label", "v.e", same.alias("copies"))


def choose_pivots(own: DataFrame) -> dict[int, np.ndarray]:
    """Reference points by vector length, and their number under the length 0."""
    some = own.where("rid is not null")
    n = pivot_count(some.count())
    by: dict[int, list] = {}
    for r in some.select("rid", "e").orderBy("rid").limit(max(SAMPLE, EACH * n)).collect():
        by.setdefault(len(r["e"]), []).append(r["e"])
    out = {0: np.array([n])}
    for k, rows in by.items():
        kept = np.zeros((0, k))
        for x in unit(np.array(rows)):
            if len(kept) < n and (kept @ x < APART).all():
                kept = np.vstack([kept, x])
        out[k] = np.vstack([kept, drawn(k, n - len(kept))])
    return out


def drawn(k: int, n: int) -> np.ndarray:
    """n directions of length k, the same in each call."""
    return unit(np.random.default_rng(k).normal(size=(n, k)) + 1e-9)


def pivots_of(pivots: dict[int, np.ndarray], k: int) -> np.ndarray:
    if k not in pivots:
        pivots[k] = drawn(k, int(pivots[0][0]))
    return pivots[k]


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Ordered nearest pivots of unit vectors; ties go to the lower pivot."""
    return np.argsort(-np.round(x @ pivots.T, 12), axis=1, kind="stable")[:, :nearest]


def _units(column: pa.Array, k: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), k))


def lists(distinct: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(key, shared, rid): a row for each list that a vector is in; key is a hash of label, length and shared pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, column = batch.column("rid").to_numpy(), batch.column("e")
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            for k in np.unique(size):
                rows = np.flatnonzero(size == k)
                order = np.sort(describe(_units(column.take(pa.array(rows)), int(k)), pivots_of(pivots, int(k))), axis=1)
                n = order.shape[1]
                keys = np.stack([packed(order[:, list(c)]) for c in combinations(range(n), min(SHARED, n))], axis=1)
                m = keys.shape[1]
                at = pa.array(np.repeat(rows, m))
                yield pa.RecordBatch.from_arrays([batch.column("label").take(at), pa.array(np.full(len(rows) * m, k, np.int64)), pa.array(keys.ravel()), pa.array(np.repeat(rid[rows], m))], names=["label", "dim", "shared", "rid"])

    # All columns go in, so that the shuffle of the classes is the same one as below.
    kind = distinct.schema["label"].dataType.simpleString()
    found = distinct.select("rid", "label", "e", "copies").mapInArrow(run, f"label {kind}, dim long, shared long, rid long")
    return found.select(F.xxhash64("label", "dim", "shared").alias("key"), "shared", "rid")


def packed(order: np.ndarray) -> np.ndarray:
    """Sorted pivots as one number, BITS for each."""
    out = np.zeros(len(order), np.int64)
    for i in range(order.shape[1]):
        out = out << BITS | order[:, i]
    return out


def _verify(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of each block: a row for each vector with a link, its count of links, and a neighbour in the block's forest."""
    by = ["key", "lo", "hi"]
    for t in common.group_runs(batches, by):
        lo, hi, b, shared, rid, copies = (t.column(c).to_numpy() for c in ("lo", "hi", "b", "shared", "rid", "copies"))
        column, label = t.column("e").combine_chunks(), t.column("label").to_numpy()
        dim = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        bounds = np.append(common.group_starts(t, by), t.num_rows)
        out: list[list[np.ndarray]] = [[], [], []]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            for own in _alike(label[s:e], dim[s:e], shared[s:e]):
                if len(own) < 2:
                    continue
                at, k = own + s, int(dim[s + own[0]])
                x = _units(column.take(pa.array(at)), k)
                left, right = np.flatnonzero(b[at] == lo[s]), np.flatnonzero(b[at] == hi[s])
                order = describe(x, pivots_of(pivots, k))
                last = int(shared[at[0]]) & ((1 << BITS) - 1)
                labels, n = np.arange(len(at)), np.zeros(len(at), np.int64)
                for i in range(0, len(left), 256):
                    rows = left[i : i + 256]
                    close = np.zeros((len(rows), len(at)), bool)
                    if len(right):
                        close[:, right] = x[rows] @ x[right].T >= COSINE
                    close[np.arange(len(rows)), rows] = False
                    common.forest(labels, rows, close)
                    r, c = np.nonzero(close)
                    r = rows[r]
                    # All shared pivots up to the list's last one are the list's.
                    both = (order[r][:, :, None] == order[c][:, None, :]) & (order[r] <= last)[:, :, None]
                    first = both.sum(axis=(1, 2)) == min(SHARED, order.shape[1])
                    r, c = r[first], c[first]
                    np.add.at(n, r, copies[at[c]])
                    if lo[s] != hi[s]:
                        np.add.at(n, c, copies[at[r]])
                some = np.flatnonzero((n > 0) | (labels != np.arange(len(at))))
                out[0].append(rid[at[some]])
                out[1].append(rid[at[labels[some]]])
                out[2].append(n[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names=["a", "b", "links"])


def _alike(label: np.ndarray, dim: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
    """Rows by label, length and shared pivots; nearly always one group, as the key is their hash."""
    if (label == label[0]).all() and (dim == dim[0]).all() and (shared == shared[0]).all():
        return [np.arange(len(label))]
    groups: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(label, dim, shared, strict=True)):
        groups.setdefault(k, []).append(i)
    return [np.array(g) for g in groups.values()]


def found_links(own: DataFrame, pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(a, b, links) for classes by rid: parts of their counts of links, and enough links to connect all."""
    common.ship(own.sparkSession)
    pivots, distinct = choose_pivots(own) if pivots is None else pivots, classes(own)
    met = common.block_pairs(lists(distinct, pivots), "key", "rid").join(distinct, "rid")
    return common.cut(common.dealt(met, "key", "rid").mapInArrow(partial(_verify, pivots=pivots), "a long, b long, links long"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    own = hashed(vectors)
    found = found_links(own)
    counts = found.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    roots = common.connected_components(found.select("a", "b")).withColumnRenamed("node", "rid")
    rows = own.select("vec_id", "rid")
    sizes = rows.where("rid is not null").groupBy("rid").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    each = sizes.join(counts, "rid", "left").join(roots, "rid", "left")
    each = common.cut(each.select("rid", "least", F.coalesce("root", "rid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = each.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = rows.join(each.join(named, "root").select("rid", "n_links", "component_id"), "rid", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
