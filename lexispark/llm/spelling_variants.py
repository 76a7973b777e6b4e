"""Groups of spelling variants: words that differ by one edit, found through forward and reversed sorted dictionaries.

counts() takes the words of all documents, pre-aggregated in each slice of texts. Two words that differ by one inserted,
deleted or replaced character share a first or a last half: with m characters in the shorter one, either the first
h = ceil(m / 2) are equal, or the last m - h. So each word stands in a dictionary sorted by its first half and in one
sorted by its reversed last half, with pairs of its own length and, as the longer one, of its length less one. Blocks are
the runs of one key in a dictionary, which is dealt out by ranges of the key and scanned in order.

A block of over BLOCK words is subdivided by the same argument: of what lies between the equal first p and the last s
characters, half again is intact, at its start or at its end. So its words get two longer keys, until blocks are small
or one character is left between, where nearly all words of a block are near. Each pair is looked at in the first
block that holds it (a block passes over pairs that the first of two keys has too), so that counts need no pairs: a block
gives for each word the number of near words and the best one, and these are added up by word.

forms() picks the near word of largest count that is at least RATIO times as frequent, and follows forms to the last.

Defined cases: a null, empty or wordless text has no words; a null id counts as the text null; repeated rows count each; the length
of texts and words is not limited; ties between near words of one count go to the smaller in code-point order; an empty
table gives no words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

#: Characters of a word and times that it occurs, at least; how much more frequent a form is; words of a block, more are subdivided.
LEAST_CHARS, LEAST_COUNT, RATIO, BLOCK = 7, 2, 10, 128
#: One of so many runs loses a character by the digest's contract.
LOST = 31
#: Characters of a text that are taken at once, pairs that are compared at once.
PIECE, PAIRS = 1 << 20, 1 << 18
RUN, GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")


def lowered(text: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters, in lists of bounded size but for a longer run."""
    at = 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        if to < len(text):
            gap = GAP.search(text, to)
            to = gap.start() if gap else len(text)
        yield RUN.findall(text, at, to)
        at = to


def spelled(doc: bytes, run: str, lost: int) -> str:
    """The run as the contract spells it in a document: one code point is deleted from one of `lost` runs."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc))
    if lost and h % lost == 0:
        i = h % len(run)
        return run[:i] + run[i + 1 :]
    return run


def counts(docs: DataFrame, lost: int = 0) -> DataFrame:
    """(word, n) of words of LEAST_CHARS and more characters that occur LEAST_COUNT times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_batches(batches, common.BATCH_ROWS, common.BATCH_BYTES):
            words: Counter[str] = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, doc = Counter(), f"{'null' if doc_id is None else doc_id}:".encode()
                for piece in runs(lowered(text or "")):
                    own.update(piece)
                for word, n in own.items():
                    # A shorter run can't become a word.
                    if len(word) >= LEAST_CHARS:
                        words[spelled(doc, word, lost)] += n
            held = [(w, n) for w, n in words.items() if len(w) >= LEAST_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], names=["word", "n"])

    common.ship(docs.sparkSession)
    each = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def half(m: Column) -> Column:
    return F.ceil(m / 2).cast("int")


def placed(rows: DataFrame, places: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Rows (word, n, m) under each of the places (p, s, skip): p equal first characters, s equal last ones; pairs with `skip` equal first characters belong to another block.

    A key begins with what its dictionary is sorted by; a block that has no pairs of its own is left out.
    """
    each = F.explode(F.array(*(F.struct(p.cast("int").alias("p"), s.cast("int").alias("s"), k.cast("int").alias("skip")) for p, s, k in places)))
    out = rows.select("word", "n", "m", each.alias("x")).select("word", "n", "m", "x.*").where("p < skip")
    first, last = F.substring("word", F.lit(1), F.col("p")), F.reverse(F.substring("word", F.char_length("word") - F.col("s") + 1, F.col("s")))
    main = F.when(F.col("s") > F.col("p"), F.concat(F.lit("<"), last, F.lit(" "), first)).otherwise(F.concat(F.lit(">"), first, F.lit(" "), last))
    return out.withColumn("key", F.concat_ws(" ", main, F.col("m").cast("string"), F.col("p").cast("string"), F.col("s").cast("string"), F.col("skip").cast("string")))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (key, word, n, m, p, s, skip) of the blocks of both dictionaries, subdivided; blocks without a pair go."""
    size = F.char_length("word")
    both = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= LEAST_CHARS)).alias("m"))
    m, nothing = F.col("m"), F.lit(0)
    none = F.lit(1 << 30)
    rows, done = common.cut(placed(both, [(half(m), nothing, none), (nothing, m - half(m), half(m))])), None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.char_length("word") - F.col("m")).alias("longer"))
        # A block of longer words alone has no pair of this length.
        counted = common.cut(rows.join(sizes.where("size > 1 and longer = 0").select("key", "size"), "key"))
        large = (F.col("size") > block) & (m - F.col("p") - F.col("s") > 1)
        small = counted.where(~large).drop("size")
        done = small if done is None else done.unionByName(small)
        again = counted.where(large).drop("size")
        if again.isEmpty():
            return done
        # Of the characters between, the first x or the last m - p - s - x are intact.
        x = F.ceil((m - F.col("p") - F.col("s")) / 2)
        rows = common.cut(placed(again, [(F.col("p") + x, F.col("s"), F.col("skip")), (F.col("p"), m - F.col("p") - x, F.least(F.col("skip"), F.col("p") + x))]))


def near_pairs(short: np.ndarray, long: np.ndarray, replaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows of code points (short[i], long[i]): whether they differ by one edit, and how many first characters are equal.

    The long one has one character more, or as many, if replaced.
    """
    m = short.shape[1]
    head = np.cumprod(short == long[:, :m], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((short == long[:, -m:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return (head + tail == m - 1 if replaced else head + tail >= m), head


def near_in_block(words: list[str], n: np.ndarray, m: int, skip: int) -> list[tuple[str, int, int, str]]:
    """(word, near words, n of the best, best) of a block's words that have a near one; pairs with skip equal first characters are passed over."""
    size = np.array([len(w) for w in words])
    order = sorted(range(len(words)), key=lambda i: words[i])
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    short, longer = np.flatnonzero(size == m), np.flatnonzero(size == m + 1)

    def points(at: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), width)

    own, other = points(short, m), points(longer, m + 1)
    near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)

    def take(a: np.ndarray, b: np.ndarray) -> None:
        """Counts b for a; a comes in order."""
        if not len(a):
            return
        np.add.at(near, a, 1)
        by = np.lexsort((rank[b], -n[b], a))
        first = by[np.concatenate([[True], np.diff(a[by]) != 0])]
        for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
            if best[i] < 0 or (-n[j], rank[j]) < (-n[best[i]], rank[best[i]]):
                best[i] = j

    for there, where, replaced in ((own, short, True), (other, longer, False)):
        if not len(where):
            continue
        step = max(1, PAIRS // (len(where) * (m + 1)))
        for lo in range(0, len(short), step):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, min(lo + step, len(short))), np.arange(len(where)), indexing="ij"))
            if replaced:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            ok, head = near_pairs(own[i], there[j], replaced)
            ok &= head < skip
            a, b = short[i[ok]], where[j[ok]]
            take(a, b)
            back = np.argsort(b, kind="stable")
            take(b[back], a[back])
    return [(words[i], int(near[i]), int(n[best[i]]), words[best[i]]) for i in np.flatnonzero(near)]


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a word one edit away."""
    common.ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for table in common.group_runs(batches, ["key"]):
            starts = common.group_starts(table, ["key"])
            word, n, m, skip = (table.column(c) for c in ("word", "n", "m", "skip"))
            word, n = word.to_pylist(), n.to_numpy()
            for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                held += near_in_block(word[a:b], n[a:b], m[int(a)].as_py(), skip[int(a)].as_py())
                if len(held) > 10_000:
                    yield packed(held)
                    held = []
        yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    sorted_keys = blocks(words, block).select("key", "word", "n", "m", "skip").repartitionByRange("key").sortWithinPartitions("key", "word")
    found = sorted_keys.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.o")).alias("best_n"), F.col("b.w").alias("best"))


def forms(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n)."""
    words = common.cut(words)
    known = words.join(near(words, block), "word", "left")
    yes = F.col("best_n") >= F.col("n") * ratio
    out = common.cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(yes, F.col("best")).alias("form"), F.when(yes, F.col("best_n")).alias("form_n")))
    # Each step to a form multiplies n by the ratio, so chains are short; each round doubles the steps that are taken.
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    roots = common.cut(roots)
    while True:
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.cut(roots.join(next_, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")))
        roots = moved.drop("more")
        if moved.where("more").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The words of all documents after the contract's deletions, with their forms."""
    return forms(counts(docs, LOST))
