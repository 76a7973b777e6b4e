"""Shared pieces: checkpoints, bit filters, sorted runs of groups, blocked comparison of groups, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType

from lexispark import session
from lexispark.session import cut, shared_dir

__all__ = ["any_names", "block_pairs", "connected_components", "cut", "dealt", "filtered", "forest", "group_runs", "group_starts", "hashable", "map_batches", "nearest_forest", "shared_dir", "ship", "text_batches", "with_blocks"]

#: Rows of one block when a group of candidates is compared in pieces.
BLOCK_ROWS = 2048
#: Most rows and bytes of an Arrow batch, and of the slices that are worked on at once; texts may be long.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20
#: Bits of a filter: at least, for each value that is held, and at most (4 million rows of two numbers).
FILTER_BITS, FILTER_EACH, FILTER_MOST = 1 << 24, 16, 1 << 28
#: A node with over this share of the ends of all edges is a hub; there are at most twice as many as it goes into 1.
HUB_SHARE = 1 / 512
#: Edges of a partition while components are found.
EDGE_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once for each Spark context, and keeps Arrow batches of whole texts small.

    The limits of batches stay set in the session, as they are read when a job runs; smaller ones are left as they are.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    session.ship(spark)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies fn to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield fn(batch)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of so many rows and, but for a single longer row, bytes of text; so what is derived stays small."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                ends += pa.compute.fill_null(pa.compute.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(ends), 0
        while at < batch.num_rows:
            full = (ends[at - 1] if at else 0) + most
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, full, side="right"))), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


#: Columns of documents, which operators name.
NAMED = ("doc_id", "text", "lang", "source", "n_chars")


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on documents that returns their columns, for tables with further columns of any names: these go by place while it works."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        names = docs.columns
        return operator(docs.toDF(*(c if c in NAMED else f"_more{i}" for i, c in enumerate(names))), *args, **named).toDF(*names)

    return run


def hashable(column: Column, kind: DataType) -> Column:
    """The column, or what stands for it where it holds maps: entries in order, as a map has none."""
    if isinstance(kind, MapType) and "map<" not in kind.keyType.simpleString() + kind.valueType.simpleString():
        return F.array_sort(F.map_entries(column), lambda a, b: F.when(F.to_json(F.struct(a["key"])) < F.to_json(F.struct(b["key"])), -1).otherwise(1))
    return F.to_json(F.struct(column)) if "map<" in kind.simpleString() else column


def filtered(rows: DataFrame, held: DataFrame, names: list[str], column: str, count: int = 0) -> DataFrame:
    """rows with a boolean column: false only where the names' values (not null) aren't among those of held.

    The filter is broadcast: its bits grow with the number of values that held has, if that is given, from FILTER_BITS
    to FILTER_MOST; it has at most a 64th of that many rows of two numbers. Beyond that it lets more through.
    """
    size = min(max(FILTER_BITS, 1 << (count * FILTER_EACH).bit_length()), FILTER_MOST)
    place, bit = F.pmod(F.xxhash64(*names), F.lit(size)), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(names)}), 64L) as int))")
    bits = held.groupBy(F.floor(place / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = rows.join(F.broadcast(bits), F.floor(place / 64) == F.col("_word"), "left")
    return met.withColumn(column, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def group_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the keys; the last group waits for the next batch."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        starts = group_starts(t, keys)
        at = int(starts[-1])
        if at == 0 and rest and same_key(rest[0], t, keys):
            rest.append(t)
            continue
        if rest:
            first = int(starts[1]) if len(starts) > 1 else t.num_rows
            if same_key(rest[0], t, keys):
                yield pa.concat_tables([*rest, t.slice(0, first)])
                if first < at:
                    yield t.slice(first, at - first)
            else:
                yield pa.concat_tables(rest)
                if at:
                    yield t.slice(0, at)
        elif at:
            yield t.slice(0, at)
        rest = [t.slice(at)]
    if rest:
        yield pa.concat_tables(rest)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new group begins."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def same_key(a: pa.Table, b: pa.Table, keys: list[str]) -> bool:
    return all(a.column(k)[0] == b.column(k)[0] for k in keys)


def block_pairs(keyed: DataFrame, key: str, member: str, block: int | None = None, finer: Callable[[DataFrame], DataFrame] | None = None, most: int = 8) -> DataFrame:
    """Rows of groups of two and more, dealt out for blocked comparison.

    A group of n rows gets ceil(n / block) blocks by the hash of the member; each two blocks (lo, hi) meet
    in one place, so that no task needs more than about two blocks of a group. Groups of one row go.
    Groups of over `most` blocks are first split by finer, if given: it returns the rows under finer keys,
    under some of which each pair that matters meets again.
    """
    block = block or BLOCK_ROWS
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if finer:
        counts = cut(counts)
        large = counts.where(F.col("n") > block * most)
        if not large.isEmpty():
            split = finer(keyed.join(large.select(key), key, "left_semi"))
            rest = keyed.join(counts.where(F.col("n") <= block * most), key)
            return _in_blocks(rest, member, block).unionByName(block_pairs(split, key, member, block))
    return _in_blocks(keyed.join(counts, key), member, block)


def _in_blocks(counted: DataFrame, member: str, block: int) -> DataFrame:
    own = counted.withColumn("nb", F.ceil(F.col("n") / F.lit(block)).cast("long")).drop("n")
    own = own.withColumn("b", F.pmod(F.xxhash64(member, F.lit(7)), F.col("nb")))
    one = F.array(F.lit(0).cast("long"))
    met = F.when(F.col("nb") == 1, one).otherwise(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    out = own.withColumn("p", F.explode(met))
    return out.withColumn("lo", F.least("b", "p")).withColumn("hi", F.greatest("b", "p")).drop("p", "nb")


def dealt(pairs: DataFrame, key: str, member: str) -> DataFrame:
    """The rows of block_pairs, each two blocks together and sorted."""
    return pairs.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "b", member)


def forest(labels: np.ndarray, rows: np.ndarray, links: np.ndarray) -> None:
    """Merges the labels of linked members in place: links[i, j] links member rows[i] with member j."""
    for i, row in zip(rows, links, strict=True):
        near = np.flatnonzero(row)
        if not len(near):
            continue
        found = np.unique(np.append(labels[near], labels[i]))
        if len(found) > 1:
            labels[np.isin(labels, found[1:])] = found[0]


def nearest_forest(apart: np.ndarray, first: int, most: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest, the nearest first: apart[i, j] is the distance of member i and member first + j.

    Members of equal labels, if given, are connected already.
    """
    total = first + apart.shape[1]
    labels, out = np.arange(max(total, len(apart))) if labels is None else labels.copy(), []
    for d in range(most + 1):
        rows, cols = np.nonzero(apart == d)
        bounds = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            i, near = int(rows[s]), cols[s:e] + first
            found, at = np.unique(labels[near], return_index=True)
            new = found != labels[i]
            if new.any():
                out += [(i, int(j)) for j in near[at[new]]]
                labels[np.isin(labels, found[new])] = labels[i]
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps over the edge table, each round cut by a checkpoint; no
    links reach the driver but for a count and a digest by which the end is seen. Equal ends, nulls and
    repeated edges do no harm. A hub's edges aren't gathered: its smallest neighbour is broadcast to them.
    Tables of few edges go into few partitions, EDGE_ROWS in each, whatever the number of shuffle partitions.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == before or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before, hub, parts = tuple(state), max(64, int(state[0] * HUB_SHARE)), -(-state[0] // EDGE_ROWS)
        e = e.coalesce(parts)
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.coalesce(parts))
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, down, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(down.select("u", "m")).distinct().coalesce(parts))


def with_blocks(rows: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Rows (g, v) with nb, the number of blocks that the members (g, node; each once) of a group go into."""
    sizes = cut(members.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    hub = max(64, int((sizes.agg(F.sum("n")).first()[0] or 0) * HUB_SHARE))
    sizes = sizes.select(F.col("g").alias("u"), F.ceil(F.col("n") / F.lit(block)).cast("long").alias("m"), "n")
    return _with_least(rows.withColumnRenamed("g", "u"), sizes, hub).withColumnsRenamed({"u": "g", "m": "nb"})


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """(u, v, m): edges (u, v) with m of least (u, m, n); rows of a u with n over hub stay where they are.

    There are few such u: each takes over hub of the rows that least was counted from.
    """
    hubs = least.where(F.col("n") > hub).select("u", "m")
    there = F.broadcast(hubs)
    near = edges.join(there, "u").select("u", "v", "m")
    rest = edges.join(there, "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return near.union(rest.select("u", "v", "m"))
