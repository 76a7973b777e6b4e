"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of a text's word shingles
(XXH64 with seed 42, repeats included, in `fingerprint`). Fingerprints link at MAX_BITS or fewer differing bits.

The fingerprint is a ring of five segments of 13, 13, 13, 13 and 12 bits. If two differ in 3 bits or fewer,
some start of the ring has chains of 1, 2, 3, ... consecutive segments whose cumulative differences stay
within 3/5 of a bit per segment: 0, 1, 1, 2, 3. So the first segment of that chain is equal, and so is the
second or the third. Each start and each of the two gives a key of 25 or 26 equal bits; rows that share a key
are candidates, the longer chains prune them, and the Hamming distance decides. Members of a very large
group meet by pieces of the other bits too, one of which must be equal if few bits differ.

Deduplication links texts by the Jaccard similarity of their sets of five-word shingles, SIMILAR at least.
At that similarity five-word fingerprints differ in ten bits on average, so the candidates come from
fingerprints that differ less: of distinct words and pairs of words, in several tables (TABLES), up to
NEAR_BITS bits; the keys are complete up to 3 bits, and of pairs with 4 to NEAR_BITS those that share a key meet.

Work is done on distinct fingerprints, or nodes (texts with equal sets of shingles), in blocks (see
common.block_pairs), and each block returns links of spanning forests, nearest fingerprints first. Nothing is
capped: each pair of a group is looked at in some block. Where similarity decides, only similar pairs connect.
Blocks return their links if these are few, else a spanning forest; the pairs are verified, for which they are
grouped around common members, so that a set of shingles is sent to a group once, not to each pair. What then is
linked by prints in blocks with more links, but not connected, is gathered in families, again by forests. Within
a family (in blocks too) an inverted index over the rarest shingles of each set, of which similar sets must share
one, finds all similar pairs; those that prints link connect. So no group is written out as pairs.

Defined cases: a null or empty text, or one without words, has fingerprint zero and an empty set of shingles,
and links as any other; repeated rows are one group; a null doc_id is grouped with the rest but is never a
component_id (null if no row of the component has an id); an empty table gives no rows; extra columns are
ignored by the digest and kept by deduplication; a text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

#: Differing bits at which fingerprints link, and up to which documents are candidates in deduplication.
MAX_BITS, NEAR_BITS = 3, 6
#: Bits of the segments of the ring.
SEGMENTS = (13, 13, 13, 13, 12)
#: Keys hold what lies within three segments; above it is the number of the table, start and segments.
KEY_BITS = 40
#: Words in a shingle and mixing of its hashes, for each fingerprint that deduplication takes.
TABLES = ((1, 0), (1, 1), (1, 2), (2, 0))
#: Words in the shingles that similarities are taken of, and the least similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Differing bits in all tables together up to which a candidate pair is verified.
TOTAL_BITS = 34
#: Members up to which groups of a batch are compared together, and sets of shingles in a block of a group or family.
SMALL, SETS = 32, 512
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_PIECE = 1 << 15


def split(text: str | None) -> list[bytes]:
    """A text's words in UTF-8, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text, unsigned: of all shingles, repeats included."""
    words = split(text)
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majorities(np.fromiter(map(_HASH, shingles), np.uint64, max(1, len(words) - shingle + 1))[:, None])[0]


def majorities(h: np.ndarray) -> list[int]:
    """Of each column of hashes, the bits that are set in over half of them."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(h), _PIECE):
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + _PIECE]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64).tolist()


def mixed(h: np.ndarray, m: int = 0) -> np.ndarray:
    """Other hashes of the hashes, for each m its own."""
    h = h + np.uint64((m + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def distinct_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles, from the hashes of the words; of fewer words than k, the whole sequence is one."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n, out = len(words) - k + 1, words[: len(words) - k + 1]
    for i in range(1, k):
        out = mixed(out) + words[i : i + n]
    return np.unique(out)


def word_hashes(text: str | None) -> np.ndarray:
    words = split(text)
    return np.fromiter(map(_HASH, words), np.uint64, len(words))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted; none of a text without words."""
    return distinct_shingles(word_hashes(text), SHINGLE)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingles; 1 of two empty ones."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return 0.0  # below SIMILAR whatever they share
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) else 1.0


def node_of(shingles: np.ndarray) -> int:
    """The node of the texts with this set of shingles, as a signed long."""
    return int(np.uint64(_HASH(shingles.tobytes())).astype(np.int64))


def described(text: str | None, tables: tuple[tuple[int, int], ...] = TABLES) -> list[int]:
    """The node of a text, and its fingerprint in each table, unsigned; the node decides them."""
    words, prints = word_hashes(text), [0] * len(tables)
    for k in {k for k, _ in tables} if len(words) else ():
        h = distinct_shingles(words, k)
        where = [i for i, (own, _) in enumerate(tables) if own == k]
        for i, x in zip(where, majorities(np.stack([mixed(h, tables[i][1]) for i in where], axis=1)), strict=True):
            prints[i] = x
    return [node_of(distinct_shingles(words, SHINGLE)), *prints]


def rows_of(docs: DataFrame) -> DataFrame:
    """(row, h1, h2): each row as a struct, and two hashes by which rows with other values are told apart."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*own).alias("row")
    own = [common.hashable(c, f.dataType) for c, f in zip(own, docs.schema, strict=True)]
    own += [c.isNull() for c in own]
    return docs.select(row, F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *own).alias("h2"))


def all_described(rows: DataFrame, tables: tuple[tuple[int, int], ...]) -> DataFrame:
    """(h1, h2, doc_id, node, fp0, ...): node and fingerprints, as signed longs, of each row of rows_of."""
    names = ["node", *print_names(tables)]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([[x[0] & 0xFFFFFFFFFFFFFFFF, *x[1:]] for x in (described(t.as_py(), tables) for t in b.column(3))], np.uint64)
        found = found.reshape(b.num_rows, len(names)).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(found[:, i]) for i in range(len(names)))], names=["h1", "h2", "doc_id", *names])

    given = rows.select("h1", "h2", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return common.map_batches(given, fn, "h1 long, h2 long, doc_id long, " + ", ".join(f"{n} long" for n in names))


def print_names(tables: tuple[tuple[int, int], ...]) -> list[str]:
    return [f"fp{i}" for i in range(len(tables))]


def chain(start: int) -> np.ndarray:
    """Where each segment ends, counted in bits from the start of the chain."""
    return np.cumsum(SEGMENTS[start:] + SEGMENTS[:start])


def turn(start: int) -> int:
    return sum(SEGMENTS[:start])


def keys(fp: str, table: int = 0) -> F.Column:
    """An array of the keys of a fingerprint: for each start of the ring, its segment with the next one or the one after."""
    out, x = [], F.col(fp)
    for start in range(len(SEGMENTS)):
        t = turn(start)
        ring = F.shiftrightunsigned(x, t).bitwiseOR(F.shiftleft(x, 64 - t)) if t else x
        one, two, three = (1 << int(e) for e in chain(start)[:3])
        for which, mask in enumerate((two - 1, (one - 1) | (three - two))):
            tag = (table * len(SEGMENTS) + start) * 2 + which << KEY_BITS
            out.append(ring.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(tag)))
    return F.array(*out)


_TURNS = np.array([turn(s) for s in range(len(SEGMENTS))], np.uint64)
_CHAINS = np.array([[(1 << int(e)) - 1 for e in chain(s)[:-1]] for s in range(len(SEGMENTS))], np.uint64)


def within(diff: np.ndarray, start: int | np.ndarray, near: int = MAX_BITS) -> np.ndarray:
    """Which differing bits stay within the budgets of all chains from the start."""
    t = _TURNS[start]
    ring = (diff >> t) | (diff << ((np.uint64(64) - t) & np.uint64(63)))
    ok = np.ones(diff.shape, bool)
    for n in range(len(SEGMENTS) - 1):
        ok &= np.bitwise_count(ring & _CHAINS[start, n]) <= (n + 1) * near // len(SEGMENTS)
    return ok


def distances(a: np.ndarray, b: np.ndarray, start: int, near: int = MAX_BITS) -> np.ndarray:
    """d[i, j]: differing bits of a[i] and b[j] if they pass the chains from the start and the full Hamming check, else 255."""
    diff = a[:, None] ^ b[None, :]
    bits = np.bitwise_count(diff)
    return np.where(within(diff, start, near) & (bits <= near), bits, np.uint8(255))


def starts_of(key: np.ndarray) -> np.ndarray:
    """The start of the ring that a key is from."""
    return (key >> KEY_BITS) // 2 % len(SEGMENTS)


def finer_keys(keyed: DataFrame, near: int) -> DataFrame:
    """The rows of large groups under one key for each of near + 1 pieces of the bits that their key doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = b.column("key").to_numpy(), b.column("print").to_numpy().view(np.uint64)
            start, third = starts_of(key), (key >> KEY_BITS) % 2 == 1
            t = _TURNS[start]
            ring = (fp >> t) | (fp << ((np.uint64(64) - t) & np.uint64(63)))
            one, two, three = (_CHAINS[start, n] for n in range(3))
            # The bits that a key holds: the first segment with the second or the third one.
            rest = ~np.where(third, one | (three ^ two), two)
            bit = np.cumsum((rest[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), axis=1) - 1
            piece = bit * (near + 1) // (bit[:, -1:] + 1)
            for i in range(near + 1):
                mask = (((piece == i) & ((rest[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                low = mixed(mixed(key.view(np.uint64), i) + (ring & mask)) >> np.uint64(64 - KEY_BITS)
                yield pa.RecordBatch.from_arrays([pa.array((key >> KEY_BITS << KEY_BITS) | low.view(np.int64)), b.column("print"), b.column("node")], names=["key", "print", "node"])

    return keyed.select("key", "print", "node").mapInArrow(run, "key long, print long, node long")


def chosen(apart: np.ndarray, first: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Links i, j between members of unequal labels, and whether other links are left: all if they are few, else those of a spanning forest, the nearest first."""
    apart = np.where(labels[: len(apart), None] == labels[None, first : first + apart.shape[1]], np.uint8(255), apart)
    if not first:
        apart[np.tril_indices(len(apart))] = 255
    i, j = np.nonzero(apart < 255)
    if len(i) <= 2 * (first + apart.shape[1] - 1):
        return i, j + first, False
    i, j = np.array(common.nearest_forest(apart, first, NEAR_BITS)).T
    return i, j, True


def _small_pairs(group: np.ndarray, small: np.ndarray, size: np.ndarray, fp: np.ndarray, label: np.ndarray, start: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of unequal labels in the small groups of a table, all groups at once."""
    place = np.arange(len(group)) - np.searchsorted(group, np.arange(len(size)))[group]
    after = np.where(small[group], size[group] - place - 1, 0)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(after.max(initial=0)) + 1):
        i = np.flatnonzero(after >= d)
        i = i[label[i] != label[i + d]]
        diff = fp[i] ^ fp[i + d]
        chained = within(diff, start[group[i]], near)
        i = i[chained][np.bitwise_count(diff[chained]) <= near]
        left.append(i)
        right.append(i + d)
    return np.concatenate(left), np.concatenate(right)


def _numbers(names: tuple[str, ...], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), from_pandas=True) for x in columns], names=list(names))


def _links(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) for links of each block (see chosen), (key, lo, hi) for blocks with links left."""
    by = ["key", "lo", "hi"]
    for t in common.group_runs(batches, by):
        key, lo, hi, b, node, label = (t.column(c).to_numpy() for c in (*by, "b", "node", "label"))
        fp = t.column("print").to_numpy().view(np.uint64)
        at = common.group_starts(t, by)
        size = np.diff(np.append(at, t.num_rows))
        group, start = np.repeat(np.arange(len(at)), size), starts_of(key[at])
        small = (size <= SMALL) & (lo[at] == hi[at])
        i, j = _small_pairs(group, small, size, fp, label, start, near)
        many = np.bincount(group[i], minlength=len(at)) > 2 * (size - 1)
        few = ~many[group[i]]
        yield _numbers(("a", "b"), [node[i[few]], node[j[few]]])
        for g in np.flatnonzero(many | ~small):
            own = slice(at[g], at[g] + size[g])
            n, first = int(size[g]), 0
            if lo[at[g]] != hi[at[g]]:
                n = first = int(np.searchsorted(b[own], hi[at[g]]))
            x, y = fp[own][:n], fp[own][first:]
            apart = np.concatenate([distances(x[k : k + 128], y, int(start[g]), near) for k in range(0, n, 128)] or [np.zeros((0, len(y)), np.uint8)])
            i, j, left = chosen(apart, first, label[own])
            yield _numbers(("a", "b"), [node[own][i], node[own][j]])
            if left:
                yield _numbers(("key", "lo", "hi"), [x[at[g] : at[g] + 1] for x in (key, lo, hi)])


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns in each batch."""
    names = ("a", "b", "key", "lo", "hi")
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(c) if c in b.schema.names else pa.nulls(b.num_rows, pa.int64()) for c in names], names=list(names))


def _step(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    return _both(_links(batches, near))


def block_links(given: DataFrame, near: int) -> DataFrame:
    """(a, b, key, lo, hi) from rows of placed with label."""
    return common.dealt(given, "key", "node").mapInArrow(partial(_step, near=near), "a long, b long, key long, lo long, hi long")


def placed(nodes: DataFrame, tables: tuple[tuple[int, int], ...], near: int) -> DataFrame:
    """(key, print, node, b, lo, hi): the nodes' prints of each table dealt to blocks by their keys."""
    common.ship(nodes.sparkSession)
    each = F.explode(F.array(*(F.struct(keys(n, i).alias("keys"), F.col(n).alias("print")) for i, n in enumerate(print_names(tables))))).alias("_")
    keyed = nodes.select("node", each).select("node", "_.print", F.explode("_.keys").alias("key"))
    return common.block_pairs(keyed, "key", "node", finer=partial(finer_keys, near=near), most=near + 1)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): enough links of fingerprints to connect whatever links connect; nodes are (node, fp0)."""
    given = placed(nodes, ((SHINGLE, 0),), MAX_BITS).withColumn("label", F.col("node"))
    return block_links(given, MAX_BITS).where("a is not null").select("a", "b")


def similar_links(nodes: DataFrame, rows: DataFrame, tables: tuple[tuple[int, int], ...]) -> DataFrame:
    """(node, root): components of the nodes that link in any table and have similar sets of shingles; nodes by themselves may lack.

    nodes are (node, least, fp0, ...), least.h1 and least.h2 naming one of rows (see rows_of) with the node's text.
    """
    met = common.cut(placed(nodes, tables, NEAR_BITS))
    found = common.cut(block_links(met.withColumn("label", F.col("node")), NEAR_BITS))
    pairs = found.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = common.cut(in_reach(pairs, nodes, len(tables)))
    held = similar_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows)
    roots = common.connected_components(similar(pairs, held))
    blocks = found.where("key is not null").select("key", "lo", "hi")
    if blocks.isEmpty():
        return roots
    left = met.join(blocks, ["key", "lo", "hi"]).join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    family = common.connected_components(block_links(left, NEAR_BITS).where("a is not null").select("a", "b")).withColumnRenamed("root", "g")
    family = common.cut(family.join(roots, "node", "left").select("node", "g", F.coalesce("root", "node").alias("label")))
    more = similar_sets(family.select("node").join(held, "node", "left_anti"), nodes, rows)
    return common.connected_components(similar_in_families(family, nodes, held.union(more), len(tables)).union(roots.select("node", "root")))


def in_reach(pairs: DataFrame, nodes: DataFrame, tables: int) -> DataFrame:
    """The pairs that differ in TOTAL_BITS at most in all their tables together, or in a share of it for fewer tables."""
    prints = print_names(((0, 0),) * tables)
    one, two = (nodes.select(F.col("node").alias(c), F.array(*prints).alias(f"_{c}")) for c in ("a", "b"))
    bits = sum((F.bit_count(F.col("_a")[i].bitwiseXOR(F.col("_b")[i])) for i in range(1, tables)), F.bit_count(F.col("_a")[0].bitwiseXOR(F.col("_b")[0])))
    return pairs.join(one, "a").join(two, "b").where(bits <= total_bits(tables)).select("a", "b")


def similar_sets(ends: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, set): the sets of shingles of the nodes in ends; a filter in front of the join lets few other texts through."""
    ends = common.cut(ends.join(nodes.select("node", "least.h1", "least.h2"), "node"))
    if ends.isEmpty():
        return ends.select("node", F.lit(None).cast("binary").alias("set"))
    likely = common.filtered(rows, ends, ["h1", "h2"], "likely", ends.count()).where("likely").select("h1", "h2", F.col("row.text").cast("string").alias("text"))
    met = likely.join(ends, ["h1", "h2"]).dropDuplicates(["node"]).select("node", "text")

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], names=["node", "set"])

    return common.cut(common.map_batches(met, sets, "node long, set binary"))


def similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Enough pairs whose ends have similar sets of shingles to connect whatever such pairs connect.

    A pair's group is the smallest node next to either end; a group of many nodes is split into blocks, and a set
    goes to each two blocks (lo, hi) that have a pair with it.
    """
    both = pairs.union(pairs.select("b", "a"))
    least = common.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    grouped = pairs.join(least.withColumnRenamed("m", "ma"), "a").join(least.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
    grouped = common.cut(grouped.select("a", "b", F.least("ma", "mb").alias("g")))
    members = grouped.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    blocks = common.with_blocks(grouped.select("g", F.struct("a", "b").alias("v")), members, SETS).select("g", "v.*", "nb")
    own = [F.pmod(F.xxhash64(c, F.lit(11)), F.col("nb")) for c in ("a", "b")]
    dealt = common.cut(blocks.select("g", F.least(*own).alias("lo"), F.greatest(*own).alias("hi"), "a", "b"))
    sent = dealt.select("g", "lo", "hi", F.explode(F.array("a", "b")).alias("node")).distinct().join(held, "node")
    sent = sent.select("g", "lo", "hi", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = sent.unionByName(dealt.withColumn("set", F.lit(None).cast("binary")))
    return rows.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", F.asc_nulls_first("b"), "a").mapInArrow(_verified, "a long, b long")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similar pairs of each group, but for those whose ends such pairs connect already; a group's sets come first."""
    now, held, root = None, {}, {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        out: list[list[int]] = [[], []]
        for g, lo, hi, a, b, x in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
            if (g, lo, hi) != now:
                now, held, root = (g, lo, hi), {}, {}
            if b is None:
                held[a] = np.frombuffer(x.as_py(), np.uint64)
            elif (i := find(a)) != (j := find(b)) and jaccard(held[a], held[b]) >= SIMILAR:
                root[i] = j
                out[0].append(a)
                out[1].append(b)
        yield _numbers(("a", "b"), out)


def similar_in_families(family: DataFrame, nodes: DataFrame, held: DataFrame, tables: int) -> DataFrame:
    """(a, b): enough pairs of one family and unequal labels that prints link and whose sets are similar to connect all such pairs; family is (node, g, label)."""
    blocks = common.with_blocks(family.select("g", F.struct("node", "label").alias("v")), family.select("g", "node"), SETS).select("g", "v.*", "nb")
    own = blocks.withColumn("b", F.pmod(F.xxhash64("node", F.lit(11)), F.col("nb")))
    met = own.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).withColumn("lo", F.least("b", "p")).withColumn("hi", F.greatest("b", "p")).drop("p", "nb")
    prints = F.array(*print_names(((0, 0),) * tables)).alias("prints")
    full = met.join(nodes.select("node", prints), "node").join(held, "node").select("g", "lo", "hi", "node", "label", "prints", "set")
    return full.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "node").mapInArrow(_in_family, "a long, b long")


def _in_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in common.group_runs(batches, ["g", "lo", "hi"]):
        bounds = np.append(common.group_starts(t, ["g", "lo", "hi"]), t.num_rows)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            own = t.slice(s, e - s)
            node, label = (own.column(c).to_numpy() for c in ("node", "label"))
            prints = own.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("set")]
            i, j = sharing_rare(sets, label)
            reach = linked(prints[i], prints[j])
            root, out = {}, [[], []]

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for a, b in zip(i[reach].tolist(), j[reach].tolist(), strict=True):
                if (p := find(int(label[a]))) != (q := find(int(label[b]))) and jaccard(sets[a], sets[b]) >= SIMILAR:
                    root[p] = q
                    out[0].append(int(node[a]))
                    out[1].append(int(node[b]))
            yield _numbers(("a", "b"), out)


def sharing_rare(sets: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of unequal labels that share one of their rarest members, so many that similar sets must share one."""
    size = np.array([len(x) for x in sets], np.int64)
    owner, (_, member, count) = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    order = np.lexsort((member, count[member], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    rare = order[place < (size - np.ceil(SIMILAR * size - 1e-9).astype(np.int64) + 1)[owner]]
    rare = rare[count[member[rare]] > 1]
    rare = rare[np.argsort(member[rare], kind="stable")]
    who, what = owner[rare], member[rare]
    found = np.zeros(0, np.int64)
    d = 1
    at = np.flatnonzero(what[:-1] == what[1:])
    while len(at):
        other = label[who[at]] != label[who[at + d]]
        found = np.union1d(found, who[at[other]] * len(sets) + who[at[other] + d])
        d += 1
        at = at[at + d < len(what)]
        at = at[what[at] == what[at + d]]
    return found // max(1, len(sets)), found % max(1, len(sets))


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of prints (a column for each table) link in some table, as blocks see it: by a key, chains and distance, and by TOTAL_BITS."""
    diff = a ^ b
    bits = np.bitwise_count(diff)
    ok = np.zeros(diff.shape, bool)
    for start in range(len(SEGMENTS)):
        t = _TURNS[start]
        ring = (diff >> t) | (diff << ((np.uint64(64) - t) & np.uint64(63)))
        one, two, three = _CHAINS[start, :3]
        key = (ring & one == 0) & ((ring & (two ^ one) == 0) | (ring & (three ^ two) == 0))
        ok |= key & within(diff, start, NEAR_BITS)
    return (ok & (bits <= NEAR_BITS)).any(axis=1) & (bits.sum(axis=1, dtype=np.int64) <= total_bits(diff.shape[1]))


def total_bits(tables: int) -> int:
    return max(NEAR_BITS, TOTAL_BITS * tables // len(TABLES))


def verified(rows: DataFrame, tables: tuple[tuple[int, int], ...] = TABLES) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, doc_id, node) for each of rows, and (node, least, root) for each node.

    least is the first of its rows: by doc_id, null last, then by hash. root is a node that stands for the component.
    """
    found = common.cut(all_described(rows, tables))
    order = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h1", "h2")
    nodes = common.cut(found.groupBy("node").agg(F.min(order).alias("least"), *(F.first(n).alias(n) for n in print_names(tables))))
    roots = similar_links(nodes, rows, tables)
    classes = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return found.select("h1", "h2", "doc_id", "node"), common.cut(classes)


def components(docs: DataFrame, tables: tuple[tuple[int, int], ...] = TABLES) -> DataFrame:
    """(doc_id, component_id): one row per document; components of documents that link and are similar."""
    found, classes = verified(rows_of(docs), tables)
    named = classes.groupBy("root").agg(F.min("least").alias("least"))
    return found.join(classes.join(named.select("root", "least.doc_id"), "root").select("node", F.col("doc_id").alias("component_id")), "node").select("doc_id", "component_id")


def digest(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp0"])

    found = common.cut(common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, fp0 long"))
    nodes = common.cut(found.groupBy("fp0").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp0")))
    classes = nodes.join(common.connected_components(links(nodes)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = common.cut(classes.select("fp0", "root", "least"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint")
    return found.join(classes.join(named, "root").select("fp0", "component_id"), "fp0").select("doc_id", hexed, "component_id")


@common.any_names
def deduplicate(docs: DataFrame, tables: tuple[tuple[int, int], ...] = TABLES) -> DataFrame:
    """One document of each verified component, with its columns: the one with the smallest doc_id.

    Of rows with equal ids, or of a component without ids, the row with the smallest hash of all its columns
    stays. Only rows that may go are shuffled whole: a filter tells them, the others pass.
    """
    rows = rows_of(docs)
    found, classes = verified(rows, tables)
    kept = classes.groupBy("root").agg(F.min("least").alias("least")).select("least.h1", "least.h2")
    counted = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    lost = common.cut(counted.join(kept.withColumn("stays", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or stays is null"))
    marked = common.filtered(rows, lost, ["h1", "h2"], "marked", lost.count())
    some = marked.where("marked").join(lost.where("stays is null"), ["h1", "h2"], "left_anti").dropDuplicates(["h1", "h2"])
    return marked.where("not marked").select("row.*").unionAll(some.select("row.*"))
