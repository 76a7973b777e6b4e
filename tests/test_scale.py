"""What must not grow: shuffles, readings, batches and tasks; and figures that are rounded as C rounds them."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import subwords, tei
from lexispark.functions import text as tx
from lexispark.operators import explanations, features, metrics, scoring, splits
from lexispark.plans import registry
from lexispark.sources import corpus as src

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Joins are broadcast only where the code says so, as with tables of unknown size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def docs(spark):
    rng = random.Random(3)
    rows = [(i, "xyz"[i % 3], f"t{i % 7}", " ".join(rng.choice(["aa", "bb", "cc", "dd's", "é"]) for _ in range(i))) for i in range(40)]
    return spark.createDataFrame(rows, "doc_ord long, author string, title string, text string").repartition(3).localCheckpoint()


def test_words_are_counted_where_the_text_is(spark, docs):
    assert "Exchange" not in plan(features.word_counts(docs))
    vocab = features.vocabulary(features.word_counts(docs), 3).localCheckpoint()
    assert "SortAggregate" not in plan(features.vocabulary(features.word_counts(docs), 3))
    assert "Exchange" not in plan(features.frequencies(docs.select("doc_ord", "text"), vocab))
    assert {r["doc_ord"]: len(r["freq"]) for r in features.frequencies(docs.select("doc_ord", "text"), vocab).collect()} == {i: 3 for i in range(40)}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é 1"), (4, "b a b")], "doc_ord long, text string")
    assert sorted(map(tuple, features.word_counts(odd).collect())) == [(4, "a", 1, 1), (4, "b", 2, 0)]


def test_windows_are_scored_where_the_text_is(docs, monkeypatch):
    model = scoring.multinomial(docs, 3).localCheckpoint()
    scored = scoring.logits(docs, model, 5, 2, 1, 0, ("title",))
    assert "Exchange" not in plan(scored)
    whole = sorted(map(repr, scored.collect()))
    monkeypatch.setattr(scoring, "CELLS", 12)  # a few windows at once
    assert sorted(map(repr, scoring.logits(docs, model, 5, 2, 1, 0, ("title",)).collect())) == whole


def test_a_model_is_counted_without_a_row_for_each_document(docs, no_broadcast):
    """No task of the model sorts, joins or is dealt rows by document, of which there are as many as documents times words."""
    model = plan(scoring.multinomial(docs, 3))
    assert "doc_ord" not in "".join(re.findall(r"hashpartitioning\([^)]*|SortMergeJoin[^\n]*|Sort \[[^\]]*|keys=\[[^\]]*", model))


def test_works_and_labels_are_sent_to_the_texts(spark, docs, no_broadcast):
    assert "BroadcastHashJoin" in plan(splits.split_works(docs))
    if os.path.isdir(DATA):
        assert "BroadcastHashJoin" in plan(registry.queries()["l02_j03_labelled_chunks"](spark, DATA))


def test_a_test_row_goes_once_to_a_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a, b = (spark.createDataFrame([(i, rng.normal(size=20).tolist()) for i in range(n)], "doc_ord long, z array<double>").localCheckpoint() for n in (50, 900))
    sent, seen = [], features.PivotIndex.seen
    monkeypatch.setattr(features, "BLOCK", 8)
    monkeypatch.setattr(features, "SIDE", 300)
    monkeypatch.setattr(features.PivotIndex, "seen", lambda *x: sent.append(seen(*x)) or sent[-1])
    near = features.nearest(a, b, 2)
    assert near.count() == 100
    # Rings hold about 8 rows, over a hundred of them; a side has 53, so blocks are 17 or, by packing, up to twice as many.
    rows = sum(df.count() for df in sent)
    assert 50 <= rows <= 50 * 36 and sent[0].groupBy("block", "doc_ord").count().where("count > 1").isEmpty()


def test_copies_of_vectors_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    tests, rows = rng.normal(size=(40, 12)).round(1), rng.normal(size=(300, 12)).round(1)
    rows[:20] = tests[:20]
    a = [(1000 * c + i, v.tolist()) for c in range(6) for i, v in enumerate(tests)]
    b = [(100_000 + 1000 * c + i, v.tolist()) for c in range(6) for i, v in enumerate(rows)]
    frames = [spark.createDataFrame(x, "doc_ord long, z array<double>").repartition(3).localCheckpoint() for x in (a, b)]
    sent, seen = [], features.PivotIndex.seen
    monkeypatch.setattr(features.PivotIndex, "seen", lambda *x: sent.append(seen(*x)) or sent[-1])
    got = {(r["doc_ord"], r["place"]): (r["delta"], r["neighbour"]) for r in features.nearest(*frames, 4).collect()}
    want = {}
    for i, v in a:
        near = sorted((round(sum(abs(x - y) for x, y in zip(v, w, strict=True)) / 12, 9), j) for j, w in b)[:4]
        want |= {(i, p + 1): x for p, x in enumerate(near)}
    assert got == want
    assert sent[0].select("doc_ord").distinct().count() == 40
    held = features.Leaves(np.array([j for j, _ in b]), np.array([w for _, w in b]), 4)
    assert len(held.rows) == 300 and held.ids.shape == (300, 4)


@pytest.mark.parametrize("k", [1, 3])
def test_leaves_find_the_nearest(monkeypatch, k):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(features, "LEAF", 32)
    for make in (lambda n: rng.gamma(0.2, 5, (n, 11)), lambda n: rng.integers(0, 3, (n, 7)) * 1.0, lambda n: np.round(rng.standard_cauchy((n, 100)), 1), lambda n: np.ones((n, 3)), lambda n: np.zeros((n, 0))):
        rows, tests, ids = make(500), make(70), rng.permutation(500)
        rows[:35] = tests[:35]
        if rows.shape[1] > 3:
            rows[40, 0], tests[69, 1] = np.nan, np.inf
        d = np.round(features.distances(tests, rows), 9)
        d[~np.isfinite(d)] = np.inf
        for most in (np.full(70, np.inf), np.sort(d, axis=1)[:, k - 1]):
            best, who = features.Leaves(ids, rows, k).search(tests, most)
            for t in range(70):
                order = np.lexsort((ids, d[t]))[:k]
                order = order[np.isfinite(d[t, order])]
                assert best[t, : len(order)].tolist() == d[t, order].tolist() and who[t, : len(order)].tolist() == ids[order].tolist()


def test_confusion_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "truth string, pred string").coalesce(1).mapInArrow(counted, "truth string, pred string")
    assert {tuple(r) for r in metrics.confusion(rows).where("cnt > 0").collect()} == {("a", "b", 1), ("a", "a", 1), ("c", "a", 1)}
    assert read.value == 3


def test_percent_is_rounded_by_the_exact_value(spark):
    rng = random.Random(5)
    shares = [k / 80000 for k in range(0, 4000, 3)] + [0.01125, 0.011250000000000001, 0.00625, 0.10005, 1.0, 0.0, -0.01125, 12.5, 0.99999999, 1e-12] + [rng.random() for _ in range(2000)] + [a / b for a, b in ((9, 800), (7, 400), (35, 2240))]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", tx.percent(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in got] == ["%.2f%%" % (r["x"] * 100) for r in got]
    assert spark.range(1).select(tx.percent(F.lit(None).cast("double"))).first()[0] is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_missing_are_all_works_without_a_file(spark):
    n = duckdb.sql(f"SELECT count(*) FROM '{DATA}/documents.parquet' ANTI JOIN '{DATA}/labels.parquet' USING (doc_id)").fetchall()[0][0]
    assert registry.queries()["p04_missing"](spark, DATA).count() == n > 1


def test_batches_of_texts_are_bounded(spark):
    for set_up in (lambda: subwords.WordPiece(["[UNK]", "a"]).tokenizer(spark), lambda: tei.tei_text(spark, F.lit("<a/>")), lambda: features.word_counts(spark.createDataFrame([(1, "a")], "doc_ord long, text string"))):
        for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
            spark.conf.unset(f"spark.sql.execution.arrow.{name}")
        set_up()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 32 << 20


def test_remembered_words_are_few():
    model = subwords.WordPiece(["[UNK]", *"0123456789", *(f"##{i}" for i in range(10))])
    for i in range(0, 120_000, 1000):
        model.encode(" ".join(map(str, range(i, i + 1000))))
    assert len(model._known) <= 50_000 and model.pieces("907") == ["9", "##0", "##7"]


def test_gains_of_many_orders():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30):
        words = [*range(max(1, n // 2)), *rng.integers(0, max(1, n // 2), n - max(1, n // 2)).tolist()]
        found = rng.integers(0, 12, 2 * n - 1).tolist()
        weight, players = rng.normal(size=12), max(words) + 1
        orders = np.array([rng.permutation(players) for _ in range(6)])
        want = [explanations.gains(words, found, o.tolist(), weight) for o in orders]
        assert explanations.gains_of(words, found, orders, weight) == pytest.approx(np.array(want))


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path, monkeypatch):
    asked, size_of = [], src.size_of
    monkeypatch.setattr(src, "size_of", lambda s, path: asked.append(path) or size_of(s, path))
    for i in range(1500):
        (tmp_path / f"{i}.txt").write_text("x" * (i % 5))
    rows = src.read_texts(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
    assert {r["path"].rsplit("/", 1)[-1]: len(r["text"]) for r in rows.collect()} == {f"{i}.txt": i % 5 for i in range(1500)}
    assert len(asked) == 300  # only those of no bytes
