"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents of a source are shuffled by a hash of id and text. A source is a queue that offers its documents up to EPOCHS
times in that order; each offer gets a virtual finish time, the source's words up to and with it divided by
the source's target. All offers are ordered by finish time and taken until the budget is used up: the offers
up to time 1 always fit; after it only those that began before time 1 are left (one of each source at most, so
none runs away from its target), and they are taken in order as long as the total stays within the budget.

Targets share the budget (BUDGET times all words) by weight; weights go 5, 2, 1 through the sources in code
point order, null last. No target is above EPOCHS times its source's words; what is over goes to the others
by weight, until none is above. This is a water level: the largest of (budget - caps of the sources that
fill first) / (weights of the rest), over how many of them are full.

Running totals are taken in two steps, within lanes (a source and a piece of the hash range) and over the
lanes' totals, so no source has to fit into a task.

Defined cases: a null text has size 0; sizes of 0 are never taken; null is a source of its own; repeated rows
are documents of their own; a table without words has targets 0; ties in the shuffle (equal ids and texts) are alike; a text of any length is one
document, taken or not as a whole;
an empty table gives no rows; extra columns are ignored by the digest and kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm import common

#: Weights in turn, budget as a multiple of all words, times that a document is offered.
WEIGHTS, BUDGET, EPOCHS = (5, 2, 1), 1.5, 2
#: Hex digits of the hash that name a lane.
LANE_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"


def size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def shuffled() -> Column:
    """The shuffle key of a document: of its id and its text, so rows of one id, or without one, are dealt to all lanes."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size); one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(x) for x in WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    own = sizes.select("source", "source_size", F.row_number().over(order).alias("rank"), w.cast("long").alias("weight"))
    cap = F.col("source_size") * EPOCHS
    own = own.withColumn("ratio", cap / F.col("weight"))
    filling = Window.orderBy("ratio", "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.coalesce(F.sum(cap).over(before), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(BUDGET) - full) / rest
    own = own.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return own.select("source", "rank", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def queues(rows: DataFrame) -> DataFrame:
    """Rows (source, size, key, ...) with rank, source_size, target and cum, the source's words up to and with the row."""
    rows = rows.withColumn("lane", F.substring("key", 1, LANE_DIGITS))
    lanes = rows.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"))
    lanes = common.cut(lanes)
    by_source = targets(lanes.groupBy("source").agg(F.sum("lane_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.withColumn("ahead", F.coalesce(F.sum("lane_size").over(ahead), F.lit(0))).drop("lane_size")
    known = lanes.alias("a").join(by_source.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(slot("a.source", "a.lane"), "ahead", "rank", "source_size", "target")
    known = common.cut(known)
    # Running totals and the join go by the same column, so rows are shuffled once.
    within = Window.partitionBy("slot").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", slot("source", "lane")).withColumn("_within", F.sum("size").over(within))
    return rows.join(known, "slot").withColumn("cum", F.col("ahead") + F.col("_within")).drop("slot", "lane", "ahead", "_within")


def slot(source: str, lane: str) -> Column:
    """A lane of a source, null too, as one value; lanes have one length."""
    return F.concat(lane, F.coalesce(F.concat(F.lit("="), source), F.lit(""))).alias("slot")


def offer(epoch: int) -> Column:
    """The place of a document's offer in the global order."""
    finish = (F.col("cum") + F.col("source_size") * (epoch - 1)) / F.col("target")
    return F.struct(finish.alias("finish"), F.col("rank"), F.lit(epoch).alias("epoch"), F.col("key"), F.col("size"))


def began(epoch: int) -> Column:
    """The virtual time at which an offer begins."""
    return (F.col("cum") - F.col("size") + F.col("source_size") * (epoch - 1)) / F.col("target")


def last_taken(queued: DataFrame) -> tuple | None:
    """The last offer that is taken after time 1; none if there is no such offer."""
    some = queued.where("size > 0")
    each = F.explode(F.array(*(F.struct(offer(e).alias("o"), began(e).alias("began")) for e in range(1, EPOCHS + 1)))).alias("x")
    offers = some.select(each).select("x.o.*", "x.began")
    used, words = (r or 0 for r in (offers.where("finish <= 1").agg(F.sum("size")).first()[0], some.agg(F.sum("size")).first()[0]))
    # One row of each source at most.
    late = offers.where("finish > 1 and began < 1")
    order = Window.orderBy("finish", "rank", "epoch", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    fits = late.withColumn("total", F.sum("size").over(order)).where(F.col("total") <= words * BUDGET - used)
    last = fits.orderBy(F.desc("total")).first()
    return tuple(last)[:5] if last else None


def taken_times(end: tuple | None) -> Column:
    """How many of a document's offers are taken."""
    total = F.lit(0)
    for e in range(1, EPOCHS + 1):
        o = offer(e)
        yes = o["finish"] <= 1
        if end is not None:
            yes = yes | (began(e) < 1) & (o <= F.struct(F.lit(float(end[0])).alias("finish"), F.lit(int(end[1])).alias("rank"), F.lit(int(end[2])).alias("epoch"), F.lit(end[3]).alias("key"), F.lit(int(end[4])).alias("size")))
        total = total + F.when(yes, 1).otherwise(0)
    return F.when((F.col("size") > 0) & (F.col("target") > 0), total).otherwise(0)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size().alias("size"), shuffled().alias("key"))
    queued = common.cut(queues(common.cut(rows)))
    end = last_taken(queued)
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * taken_times(end)).alias("taken"))


@common.any_names
def mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, a row for each time, with their columns, in order of finish time."""
    row = F.struct(*docs.columns)
    wide = docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), size().alias("size"), shuffled().alias("key"))
    narrow = common.cut(wide.select("source", "size", "key"))
    end = last_taken(common.cut(queues(narrow)))
    queued = queues(wide)
    times = queued.withColumn("_times", taken_times(end)).where("_times > 0")
    epochs = F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_epoch")
    each = times.select("row", "cum", "source_size", "target", epochs)
    finish = (F.col("cum") + F.col("source_size") * (F.col("_epoch") - 1)) / F.col("target")
    return each.select("row", finish.alias("_finish")).orderBy("_finish").select("row.*")
