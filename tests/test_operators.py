"""Splits, windows, features and metrics against small values and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexispark.operators import chunks, features, metrics, ranking, scoring, splits


def loop(n, size, stride, least):
    """Windows by a loop."""
    out, start = [], 0
    while start < n:
        m = min(size, n - start)
        if m >= least:
            out.append((start, m))
        if start + size >= n:
            break
        start += stride
    return out


@pytest.mark.parametrize("window", [(512, 256, 64), (128, 64, 100), (5, 2, 1), (4, 4, 2), (3, 5, 1)])
def test_windows(spark, window):
    sizes = [0, 1, 2, 4, 5, 6, 7, 9, 63, 64, 99, 100, 127, 128, 129, 500, 512, 513, 768, 1300]
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "doc_ord long, text string")
    rows = chunks.chunk(docs, *window).orderBy("doc_ord", "chunk_ix").collect()
    for n in sizes:
        own = [r for r in rows if r["doc_ord"] == n]
        assert [(r["start_pos"], r["n_tokens"]) for r in own] == loop(n, *window)
        assert [r["chunk_ix"] for r in own] == list(range(len(own)))
        assert all(r["tokens"][0] == f"w{r['start_pos']}" for r in own)


def test_split_sizes(spark):
    works = [("a", f"t{i}") for i in range(12)] + [("b", "only"), ("c", "x"), ("c", "y")]
    docs = spark.createDataFrame([(i, *w, "t") for i, w in enumerate(works)], "doc_ord long, author string, title string, text string")
    got = {(r[0], r[1]): r[2] for r in splits.split_works(docs).groupBy("author", "split").count().collect()}
    assert got == {("a", "test"): 2, ("a", "train"): 10, ("b", "train"): 1, ("c", "test"): 1, ("c", "train"): 1}


def test_three_parts(spark):
    rows = [(a, i) for a, n in (("e", 228), ("v", 457), ("s", 334)) for i in range(n)]
    df = spark.createDataFrame(rows, "author string, i long").withColumn("key", ranking.md5_key(42, F.col("author"), F.col("i")))
    got = {(r[0], r[1]): r[2] for r in splits.split_three(df, "key", "i").groupBy("author", "split").count().collect()}
    assert [got["e", s] for s in ("train", "validation", "test")] == [159, 34, 35]
    assert [got["v", s] for s in ("train", "validation", "test")] == [319, 68, 70]
    assert [got["s", s] for s in ("train", "validation", "test")] == [233, 50, 51]


def test_vocabulary_ties_go_to_the_first_word(spark):
    docs = spark.createDataFrame([(2, "zeta beta"), (1, "mid alpha zeta"), (3, "")], "doc_ord long, text string")
    vocab = features.vocabulary(features.word_counts(docs), 3).orderBy("rank").collect()
    assert [(r["word"], r["cnt"]) for r in vocab] == [("zeta", 2), ("mid", 1), ("alpha", 1)]


def test_scores_and_neighbours(spark):
    docs = spark.createDataFrame([(1, "a a b", "train"), (2, "a b b", "train"), (3, "a a b", "test"), (4, "", "test")], "doc_ord long, text string, split string")
    test, train, vocab = features.delta_vectors(docs, 2)
    z = {r["doc_ord"]: r["z"] for r in test.union(train).collect()}
    assert z[1] == pytest.approx([1, -1]) and z[2] == pytest.approx([-1, 1]) and z[3] == pytest.approx([1, -1])
    near = {r["doc_ord"]: (r["neighbour"], r["delta"]) for r in features.nearest(test, train).collect()}
    assert near[3] == (1, 0.0)
    assert near[4][0] == 1  # equally far: the first
    assert vocab.count() == 2


def test_constant_feature_is_zero_on_train(spark):
    rows = spark.createDataFrame([(1, [5.0]), (2, [5.0])], "doc_ord long, freq array<double>")
    assert [r["z"] for r in features.standardize(rows, features.scaler(rows)).collect()] == [[0.0], [0.0]]


def test_report(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "truth string, pred string")
    got = {r["label"]: tuple(r)[1:] for r in metrics.report(rows).collect()}
    assert got["a"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert got["b"] == pytest.approx((1 / 3, 1.0, 0.5, 1))
    assert got["c"] == (0.0, 0.0, 0.0, 1)
    avg = {r["kind"]: r["f1"] for r in metrics.averages(rows).collect()}
    assert avg["macro"] == pytest.approx((2 / 3 + 0.5) / 3) and avg["weighted"] == pytest.approx((4 / 3 + 0.5) / 4)
    assert metrics.confusion(rows).agg(F.sum("cnt"), F.count("*")).first()[:] == (4, 9)
    wide = {r["truth"]: (r["a"], r["b"], r["c"]) for r in metrics.confusion_wide(rows, ["a", "b", "c"]).collect()}
    assert wide == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 1, 0)}
    assert metrics.accuracy(rows).first()[:] == (4, 2, 0.5)
    assert metrics.accuracy(rows.limit(0)).first()["accuracy"] == 0


def test_vote_ties_go_to_the_first_chunk(spark):
    rows = spark.createDataFrame([("w", "z", 0), ("w", "a", 1), ("w", "a", 3), ("w", "z", 4)], "title string, pred string, ix int")
    got = [(r["pred"], r["place"], r["pct"]) for r in metrics.vote(rows, ["title"], ["ix"]).orderBy("place").collect()]
    assert got == [("z", 1, 50.0), ("a", 2, 50.0)]


def test_verdicts(spark):
    v = spark.range(1).select(
        metrics.unknown_verdict(F.lit(0.8), F.lit(50)), metrics.summary_flag(F.lit(0.8)), metrics.attribution_verdict(F.lit(0.8)), metrics.debut_verdict(F.lit(0.81)), metrics.against_baseline(F.lit(0.8)), metrics.unknown_verdict(F.lit(0.1), F.lit(81))
    ).first()
    assert tuple(v) == ("GOOD", "warn", "PARTIAL", "YES", "same", "WARN_ONE")


def test_softmax_and_scorers(spark):
    s = spark.range(1).select(scoring.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s")).first()["s"]
    assert s == [0.5, 0.5]
    docs = spark.createDataFrame([(1, "x", "aa bb aa"), (2, "y", "bb bb cc")], "doc_ord long, author string, text string")
    c = chunks.chunk(docs, 3, 3, 1)
    probs = scoring.probabilities(scoring.logits(docs, scoring.multinomial(docs), 3, 3, 1))
    assert {r["doc_ord"]: r["pred"] for r in scoring.predictions(probs).collect()} == {1: "x", 2: "y"}
    assert all(abs(sum(r["probs"].values()) - 1) < 1e-12 for r in scoring.probability_maps(probs).collect())
    own = scoring.score_with(c, lambda texts: (["k"] * len(texts), [float(len(t)) for t in texts]))
    assert [(r["pred"], r["confidence"]) for r in own.collect()] == [("k", 8.0), ("k", 8.0)]


@pytest.mark.parametrize("window", [(5, 2, 1), (4, 4, 2), (3, 5, 1), (8, 4, 4)])
def test_logits_are_means_over_each_window(spark, window):
    rng = random.Random(8)
    words = ["aa", "bb", "cc's", "dd-ee", "é", "zz9"]
    docs = spark.createDataFrame([(i, "xyz"[i % 3], " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((0, 1, 3, 4, 5, 9, 23, 40))], "doc_ord long, author string, text string")
    model = scoring.multinomial(docs.where("doc_ord < 6"), 4).cache()
    logp = {(r["author"], r["word"]): r["logp"] for r in model.collect()}
    known = {w for _, w in logp}
    want = {}
    for r in chunks.chunk(docs, *window).collect():
        own = [w for t in r["tokens"] for w in re.findall(r"(?<!\w)[a-z]+(?!\w)", t) if w in known]
        for a in sorted({a for a, _ in logp}):
            want[r["doc_ord"], r["chunk_ix"], a] = sum(logp[a, w] for w in own) / len(own) if own else 0.0
    got = {(r["doc_ord"], r["chunk_ix"], s["author_pred"]): s["logit"] for r in scoring.logits(docs, model, *window).collect() for s in r["scores"]}
    assert got == pytest.approx(want) and len(got) > 10
    first = scoring.logits(docs, model, *window, first=2)
    assert {(r["doc_ord"], r["chunk_ix"]) for r in first.collect()} == {(a, b) for a, b, _ in want if b < 2}


def test_delta_classifier(spark):
    rows = [(1, "x", "a a a b c"), (2, "x", "a a b b c"), (3, "y", "b c c c c"), (4, "y", "c c c b b"), (5, "y", "c c c c a")]
    docs = spark.createDataFrame(rows, "doc_ord long, author string, text string")
    model = features.Delta(3).fit(docs)
    new = spark.createDataFrame([(10, "a a a b b"), (11, "c c c c b"), (12, "")], "doc_ord long, text string")
    assert {r["doc_ord"]: r["pred"] for r in model.predict(new).where("doc_ord < 12").collect()} == {10: "x", 11: "y"}
    near = {(r["doc_ord"], r["place"]): r["author"] for r in model.neighbours(new, 3).collect()}
    votes = {r["doc_ord"]: (r["pred"], r["votes"]) for r in model.predict(new, 3).collect()}
    for i in (10, 11, 12):
        own = [near[i, p] for p in (1, 2, 3)]
        best = max(set(own), key=lambda a: (own.count(a), -own.index(a)))
        assert votes[i] == (best, own.count(best))


def test_rates_and_curve(spark):
    rows = spark.createDataFrame([("a", "a", 0.95), ("a", "b", 0.3), ("b", "b", 1.0), ("c", "b", 0.5)], "truth string, pred string, confidence double")
    got = {r["label"]: tuple(r)[1:] for r in metrics.false_positives(rows).collect()}
    assert got["a"] == (2, 0, 0.0) and got["b"] == (3, 2, pytest.approx(2 / 3)) and got["c"] == (3, 0, 0.0)
    curve = {r["step"]: (r["n"], r["accuracy"]) for r in metrics.threshold_curve(rows).collect()}
    assert curve[0] == (4, 0.5) and curve[4] == (3, pytest.approx(2 / 3)) and curve[9] == (2, 1.0)
    every = spark.createDataFrame([("a",), ("z",), ("b",)], "author string")
    assert metrics.confusion(rows.where("truth <> 'c'"), every).agg(F.sum("cnt"), F.count("*")).first()[:] == (3, 9)


def test_leave_one_work_out(spark):
    docs = spark.createDataFrame([(1, "x", "t", "aa aa bb"), (2, "x", "u", "aa bb aa"), (3, "y", "t", "cc cc bb"), (4, "y", "v", "cc bb cc"), (5, "z", "only", "dd dd dd")], "doc_ord long, author string, title string, text string")
    got = {(r["author"], r["title"]): r["pred"] for r in scoring.leave_one_work_out(docs).collect()}
    # The only work of z has no model of its own author but an even one.
    assert got[("x", "t")] == got[("x", "u")] == "x" and got[("y", "t")] == got[("y", "v")] == "y" and got[("z", "only")] == "z"
