"""Classification metrics and verdicts, from rows with truth and pred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators import ranking
from lexispark.session import cut


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: total, correct, accuracy (0 with no rows)."""
    right = F.sum((F.col("truth") == F.col("pred")).cast("long"))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.coalesce(right, F.lit(0)).alias("correct"), F.coalesce(F.try_divide(right, n), F.lit(0.0)).alias("accuracy"))


def pairs(rows: DataFrame) -> DataFrame:
    """(truth, pred, cnt): all later metrics are made of these few rows."""
    return rows.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("cnt"))


def label_counts(rows: DataFrame) -> DataFrame:
    """(label, support, guessed, tp): how often each label is true, predicted, and both."""
    p, none, n = pairs(rows), F.lit(0).cast("long"), F.col("cnt")
    right = F.when(F.col("truth") == F.col("pred"), n).otherwise(none)
    sides = F.array(F.struct(F.col("truth").alias("label"), n.alias("t"), none.alias("q"), right.alias("tp")), F.struct(F.col("pred").alias("label"), none.alias("t"), n.alias("q"), none.alias("tp")))
    return p.select(F.inline(sides)).groupBy("label").agg(F.sum("t").alias("support"), F.sum("q").alias("guessed"), F.sum("tp").alias("tp"))


def report(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) for each label in truth or predictions; what would divide by zero is 0."""
    s, zero = label_counts(rows), F.lit(0.0)
    return s.select("label", F.coalesce(F.try_divide("tp", "guessed"), zero).alias("precision"), F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"), F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("support") + F.col("guessed")), zero).alias("f1"), "support")


def false_positives(rows: DataFrame) -> DataFrame:
    """(label, others, wrong, rate): rows of other labels, those of them that are predicted as this one, and their share."""
    others = F.sum("support").over(Window.partitionBy()) - F.col("support")  # a row for each label
    s = label_counts(rows).select("label", others.alias("others"), (F.col("guessed") - F.col("tp")).alias("wrong"))
    return s.withColumn("rate", F.coalesce(F.try_divide("wrong", "others"), F.lit(0.0)))


def threshold_curve(rows: DataFrame, steps: int = 10) -> DataFrame:
    """(step, n, accuracy): rows with a confidence of step / steps at least, and their accuracy."""
    last = F.least(F.floor(F.round("confidence", 9) * steps), F.lit(steps - 1)).cast("int")
    by = rows.groupBy(last.alias("last")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("truth") == F.col("pred")).cast("long")).alias("right"))
    each = by.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("step"), "n", "right")
    return each.groupBy("step").agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"))


def averages(rows: DataFrame) -> DataFrame:
    """Macro and weighted rows: (kind, precision, recall, f1, support)."""
    r = report(rows)
    macro = r.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")).select(F.lit("macro").alias("kind"), "*")
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c)
    weighted = r.agg(*(share(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")).select(F.lit("weighted").alias("kind"), "*")
    return macro.union(weighted)


def confusion(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(truth, pred, cnt) for each two labels, zero where there are no rows; labels are those of every, or of the rows."""
    p = cut(pairs(rows))  # read twice
    # One row with all labels, which are as few as the report's rows.
    labels = every.toDF("label") if every is not None else p.select(F.explode(F.array("truth", "pred")).alias("label"))
    labels = labels.agg(F.collect_set("label").alias("labels"))
    grid = labels.select("labels", F.explode("labels").alias("truth")).select("truth", F.explode("labels").alias("pred"))
    return grid.join(p, ["truth", "pred"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def confusion_wide(rows: DataFrame, labels: list[str]) -> DataFrame:
    return confusion(rows).groupBy("truth").pivot("pred", labels).sum("cnt")


def analysis(rows: DataFrame) -> DataFrame:
    """By work (truth, title): total, correct, accuracy, mean confidence, mean confidence when right (0 if never)."""
    right = F.col("truth") == F.col("pred")
    return rows.groupBy("truth", "title").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(right.cast("long")).alias("correct"),
        F.avg(right.cast("double")).alias("accuracy"),
        F.avg("confidence").alias("avg_confidence"),
        F.coalesce(F.avg(F.when(right, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence_correct"),
    )


def vote(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, pred, cnt, place, pct): predictions of each group, most frequent first; equals in the order of their first chunk."""
    c = rows.groupBy(*by, "pred").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(*by)
    out = c.withColumn("place", F.row_number().over(w.orderBy(F.desc("cnt"), "first"))).withColumn("pct", F.col("cnt") * 100.0 / F.sum("cnt").over(w))
    return out.drop("first")


def attribution_verdict(acc: Column) -> Column:
    return F.when(acc > 0.8, "YES").when(acc > 0.5, "PARTIAL").otherwise("NO")


def unknown_verdict(confidence: Column, top_pct: Column) -> Column:
    return F.when(confidence > 0.8, "WARN_CONF").when(top_pct > 80, "WARN_ONE").otherwise("GOOD")


def summary_flag(confidence: Column) -> Column:
    return F.when(confidence < 0.8, "ok").otherwise("warn")


def debut_verdict(acc: Column) -> Column:
    return F.when(acc > 0.8, "YES").otherwise("NO")


def against_baseline(acc: Column, baseline: float = 0.8) -> Column:
    d = acc - F.lit(baseline)
    return F.when(d > 0, "better").when(d < 0, "worse").otherwise("same")


def roc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, hits, misses, tpr, fpr, right, wrong): for each score of a group, rows with a score of it or more.

    rows: the columns by, score, positive (boolean). Equal scores (to nine places) are one point; a rate without rows is 0.
    right and wrong are the point's own rows.
    """
    one = lambda c: F.sum(c.cast("long"))
    points = rows.groupBy(*by, F.round("score", 9).alias("threshold")).agg(one(F.col("positive")).alias("right"), one(~F.col("positive")).alias("wrong"))
    sums = ranking.running(points, by, [F.desc("threshold")], {"hits": F.col("right"), "misses": F.col("wrong")})
    zero = F.lit(0.0)
    return sums.select(*by, "threshold", "hits", "misses", F.coalesce(F.try_divide("hits", "hits_total"), zero).alias("tpr"), F.coalesce(F.try_divide("misses", "misses_total"), zero).alias("fpr"), "right", "wrong")


def area(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, positives, negatives, auc): the exact area under the curve, ties by half; null without rows of both kinds."""
    r = roc(rows, by)
    # Of each negative the positives above it, and half of those beside it; in whole numbers.
    twice = F.sum(F.col("wrong") * (2 * (F.col("hits") - F.col("right")) + F.col("right")).cast("decimal(38,0)"))
    out = r.groupBy(*by).agg(F.sum("right").alias("positives"), F.sum("wrong").alias("negatives"), twice.alias("twice"))
    return out.select(*by, "positives", "negatives", F.try_divide(F.col("twice").cast("double"), 2.0 * F.col("positives") * F.col("negatives")).alias("auc"))
