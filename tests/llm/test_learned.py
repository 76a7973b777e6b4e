"""Toxicity and quality classifiers: held-out accuracy and edge cases."""

import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import quality_classifier, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(900):
        w = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "scum", "dolt", "oaf"]) + rng.choice(["", "s", "ish"])
        good = i % 5 != 0
        docs.append((i, " ".join(w if good else [x + "%%%" for x in w]), ("en", "fr")[i % 2], f"s{i % 7}", None))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    out = toxicity.digest(docs, labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out, strict=True))
    own = out[out.held_out]
    assert (own.predicted == own.toxic).mean() > 0.93 and ((own.score >= 0.7) == (own.predicted == 1)).all()
    assert own[own.toxic == 0].predicted.mean() < 0.02 and out.score.between(0, 1).all()


def test_held_out_labels_change_nothing(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.digest(docs, x).orderBy("doc_id").toPandas().score.to_numpy() for x in (labels, turned))
    assert np.array_equal(a, b)


def test_long_texts_are_scored_whole(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    clean = "w1 w2 w3 " * 60_000
    ids = [toxicity.word_ids(t) for t in (clean, clean + "vile scum dolt oaf", "vile scum dolt oaf " + clean)]
    s = model.scores(ids)
    assert s[0] < 0.5 < s[1] and s[2] > 0.5
    small = model.pooled(ids, piece=1000)
    assert np.allclose(small, model.pooled(ids), atol=1e-5)


def test_reject_keeps_columns_and_clean_rows(labelled):
    docs, labels = labelled
    wide = docs.withColumn("score", F.lit("x")).withColumn("_threshold", F.lit(1))
    out = toxicity.reject(wide, labels)
    assert out.columns == wide.columns
    kept = {r["doc_id"] for r in out.collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(kept & toxic) < 0.1 * len(toxic) and len(kept - toxic) > 0.98 * (900 - len(toxic))


def test_toxicity_edges(labelled, edge_docs, empty_docs):
    _, labels = labelled
    n = edge_docs.count()
    for own in (labels, labels.limit(0), labels.where("toxic = 0"), labels.select(F.lit(None).cast("long").alias("doc_id"), "quality", "toxic")):
        out = toxicity.digest(edge_docs, own).collect()
        assert len(out) == n and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.digest(empty_docs, labels).count() == 0


def test_quality_classifier(labelled, edge_docs, empty_docs):
    docs, labels = labelled
    some = labels.where("doc_id % 3 <> 0")
    out = quality_classifier.digest(docs, some).join(labels, "doc_id").toPandas()
    rest = out[out.doc_id % 3 == 0]
    assert (rest.kept == (rest.quality == 1)).mean() > 0.97 and rest[rest.quality == 1].kept.mean() > 0.98
    n = edge_docs.count()
    for own in (some, some.limit(0), some.where("quality = 1")):
        got = quality_classifier.digest(edge_docs, own).collect()
        assert len(got) == n
    assert all(r["kept"] for r in got)
    assert quality_classifier.digest(empty_docs, some).count() == 0


def plain_surest(rows, sample, per_round):
    """The surest rows of a list of (id, text features, metadata features), by loops."""

    def surest(models, extra):
        out = [{}, {}]
        for v in (0, 1):
            p = np.round(quality_classifier.sigmoid(models[v].logit(np.array([r[1 + v] for r in rows]))), 9)
            for label in (0, 1):
                best = []
                for (i, t, m), x in zip(rows, p, strict=True):
                    sure = x if label else 1 - x
                    if sure >= quality_classifier.SURE and i is not None and i not in sample and i not in extra[1 - v]:
                        best.append((-sure, zlib.crc32(str(i).encode()), i, t.tobytes(), m.tobytes(), t, m))
                best.sort(key=lambda r: r[:5])
                for _, _, i, _, _, t, m in best:
                    if sum(x[0] == label for x in out[1 - v].values()) < per_round and i not in out[1 - v]:
                        out[1 - v][i] = (label, t, m)
        return out

    return surest


def test_views_teach_each_other():
    """A view that can't tell the labelled documents apart learns from the other's sure labels."""
    rng = np.random.default_rng(1)
    y = np.repeat([0.0, 1.0], 60)
    a = rng.normal(size=(120, 3)) + y[:, None] * 6
    b = rng.normal(size=(120, 3)) * 0.1
    pool_y = np.repeat([0.0, 1.0], 300)
    pool = rng.normal(size=(600, 3)) + pool_y[:, None] * 6, rng.normal(size=(600, 3)) * 0.1 + pool_y[:, None] * 6
    order = rng.permutation(120)
    rows = [(i, pool[0][i], pool[1][i]) for i in range(600)]
    text, meta, _ = quality_classifier.co_train((a[order], b[order]), y[order], plain_surest(rows, set(), 200))
    assert ((text.logit(pool[0]) > 0) == (pool_y == 1)).mean() > 0.98
    assert np.corrcoef(meta.w[:-1] @ ((pool[1] - meta.mean) / meta.scale).T, pool_y)[0, 1] > 0.9


def brute_text_view(text):
    raw = (text or "").encode()
    out = [math.sqrt(raw.count(bytes([b])) / max(1, len(raw))) for b in range(256)]
    words, lines = re.findall(rb"[^ \t\n\v\f\r]+", raw), [x for x in raw.split(b"\n") if re.search(rb"[^ \t\n\v\f\r]", x)]
    n, k = max(1, len(words)), max(1, len(lines))
    out += [min(4, x) for x in (math.log(1 + len(words)) / 8, len(raw) / n / 20, len(set(words)) / n, len(set(lines)) / k, math.log(1 + n / k) / 5, sum(map(len, lines)) / max(1, len(raw)))]
    return out


def test_views_by_loops(edge_docs):
    for r in edge_docs.collect():
        assert np.allclose(quality_classifier.text_view(r["text"]), brute_text_view(r["text"]), atol=1e-6)
        m = quality_classifier.meta_view(r["lang"], r["source"], r["n_chars"])
        want = {zlib.crc32(f"lang {r['lang']}".encode()) % 16, 16 + zlib.crc32(f"source {r['source']}".encode()) % 128, 144 + (0 if r["n_chars"] is None else min(23, 1 + r["n_chars"].bit_length()))}
        assert set(np.flatnonzero(m).tolist()) == want and m.sum() == 3


def test_logistic_and_calibration_reach_their_optimum():
    """Derivatives by loops are zero."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = (rng.random(80) < 1 / (1 + np.exp(-x[:, 0] * 2 + 0.5))).astype(float)
    m = quality_classifier.Logistic(x, y, 3.0)
    z = [[(x[i][j] - np.mean(x[:, j])) / (np.std(x[:, j]) + 1e-3) for j in range(4)] + [1.0] for i in range(80)]
    p = [1 / (1 + math.exp(-sum(w * v for w, v in zip(m.w, r, strict=True)))) for r in z]
    for j in range(5):
        slope = sum((p[i] - y[i]) * z[i][j] for i in range(80)) + (3.0 if j < 4 else 1e-3) * m.w[j]
        assert abs(slope) < 1e-6
    m.calibrate(x, y)
    logit = [sum(w * min(8, max(-8, v)) for w, v in zip(m.w, r, strict=True)) for r in z]
    n = sum(y)
    t = [(n + 1) / (n + 2) if v else 1 / (80 - n + 2) for v in y]
    p = [1 / (1 + math.exp(-(m.slope * v + m.shift))) for v in logit]
    assert abs(sum((a - b) * v for a, b, v in zip(p, t, logit, strict=True)) + 0.1 * (m.slope - 1)) < 1e-5 and abs(sum(p) - sum(t)) < 1e-5


def test_co_training_by_loops(spark, labelled, edge_docs, monkeypatch):
    """Rounds over all rows, scores and verdicts as by loops over lists, with repeated, empty and unlabelled rows."""
    monkeypatch.setattr(quality_classifier, "PER_ROUND", 15)
    docs, labels = labelled
    docs = docs.union(edge_docs.select("doc_id", "text", "lang", "source", "n_chars")).union(docs.limit(50))
    some = labels.where("doc_id % 4 = 0 and doc_id > 60").union(labels.where("doc_id between 400 and 420").withColumn("quality", 1 - F.col("quality")))
    both = {r["doc_id"] for r in some.groupBy("doc_id").agg(F.countDistinct("quality").alias("n")).where("n > 1").collect()}
    known = {r["doc_id"]: r["quality"] for r in some.collect() if r["doc_id"] not in both}
    rows = [(r["doc_id"], quality_classifier.text_view(r["text"]), quality_classifier.meta_view(r["lang"], r["source"], r["n_chars"])) for r in docs.collect()]
    hashed = {r[0]: r[1] for r in docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id")).collect()}
    sample = sorted({r[0]: r for r in rows if r[0] in known}.values(), key=lambda r: (hashed[r[0]], r[0]))
    y = np.array([known[r[0]] for r in sample], float)
    t, m, prior = quality_classifier.co_train((np.array([r[1] for r in sample]), np.array([r[2] for r in sample])), y, plain_surest(rows, set(known), 15))
    one, other, got_prior, shift = quality_classifier.fit(docs, some)
    assert got_prior == pytest.approx(prior) and both
    for a, b in ((one, t), (other, m)):
        assert np.allclose([*a.w, a.slope, a.shift], [*b.w, b.slope, b.shift], atol=1e-6)
    share = math.log(sum(known.values()) / (len(known) - sum(known.values())))
    want = []
    for i, text, meta in rows:
        zt, zm = float(t.logit(text)), float(m.logit(meta))
        want.append((i, 1 / (1 + math.exp(-max(-40, min(40, zt + zm - prior + share - prior))))))
    got = [(r["doc_id"], r["score"], r["kept"]) for r in quality_classifier.digest(docs, some).collect()]
    want, got = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1])) for x in (want, got))
    assert [r[0] for r in want] == [r[0] for r in got] and np.allclose([r[1] for r in want], [r[1] for r in got], atol=1e-6)
    assert all(r[2] == (r[1] >= 0.5) for r in got)


def test_samples_are_bounded_whatever_ids_repeat(spark, monkeypatch):
    """One id in most rows and many label rows."""
    docs = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("doc_id"), F.concat(F.lit("some words here "), F.when(F.col("id") % 20 == 0, F.lit("%%%% ####")).otherwise(F.lit("vile scum"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    labels = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(5).alias("doc_id"), (F.col("id") % 20 != 0).cast("int").alias("quality"), (F.col("id") % 20 != 0).cast("int").alias("toxic")).union(spark.range(600).selectExpr("5 as doc_id", "1 as quality", "1 as toxic"))
    seen = []
    real = quality_classifier.co_train
    monkeypatch.setattr(quality_classifier, "co_train", lambda views, y, surest: (seen.append(len(y)), real(views, y, surest))[1])
    taught = []
    fitted = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda spark, docs, y: (taught.append(len(docs)), fitted(spark, docs, y))[1])
    quality_classifier.fit(docs, labels)
    toxicity.fit(docs, labels)
    ids = {r[0] for r in docs.select("doc_id").collect()} & {r[0] for r in labels.groupBy("doc_id").agg(F.countDistinct("toxic").alias("n")).where("n = 1").collect()}
    assert seen == [len(ids)] and taught[0] <= len(ids)


def test_convolution_by_loops(labelled):
    """Embeddings, filters, pooling, calibration and thresholds as by loops."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("doc_id < 300"))
    table, rng = model.table.astype(float), random.Random(4)
    texts = [None, "", "!!", "vile", "w1 vile", "w1 w2 scum w3", " ".join(rng.choice(["w1", "dolt", "w5", "oafs"]) for _ in range(40))]
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        x = [table[zlib.crc32(w.encode()) % toxicity.BUCKETS] + table[zlib.crc32(b"^" + w[:4].encode()) % toxicity.BUCKETS + toxicity.BUCKETS] for w in words]
        x = (x or [np.zeros(toxicity.DIM)]) + [np.zeros(toxicity.DIM)] * toxicity.REACH
        pooled = []
        for width, f, b in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True):
            for n in range(toxicity.FILTERS):
                found = sorted((sum(sum(x[at + k][d] * float(f[k][d][n]) for d in range(toxicity.DIM)) for k in range(width)) + float(b[n]) for at in range(len(x) - toxicity.REACH)), reverse=True)
                pooled += [max(v, 0.0) for v in (found + [0.0] * toxicity.TOP)[: toxicity.TOP]]
        logit = sum(a * float(b) for a, b in zip(pooled, model.out, strict=True)) + model.bias
        want = 1 / (1 + math.exp(-max(-40, min(40, model.slope * logit + model.shift))))
        assert model.scores([toxicity.word_ids(text)])[0] == pytest.approx(want, abs=1e-5)
    score = np.array([rng.choice([0.1, 0.35, 0.4, 0.55, 0.6, 0.9, rng.random()]) for _ in range(200)])
    for noise in (0.0, 0.02, 0.3, 1.0):
        y = np.array([float(s > 0.45) if rng.random() > noise else float(rng.random() < 0.5) for s in score])
        order = sorted(range(200), key=lambda i: -score[i])
        good = [score[order[n]] for n in range(200) if sum(y[i] for i in order[: n + 1]) / (n + 1) >= toxicity.PRECISION]
        assert toxicity.lowest(score, y) == (min(toxicity.CEILING, max(toxicity.FLOOR, good[-1])) if good else toxicity.CUT)


def test_toxicity_of_batches_without_rows_of_a_fold(labelled):
    """The last batch of a partition may have fewer rows than there are folds."""
    docs, labels = labelled
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    assert toxicity.train([np.array([1 << 16])], np.array([1.0])).logits([]).shape == (0,)
    few = labels.where("doc_id < 100")
    whole, held = toxicity.fit(docs, few), spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        single = toxicity.fit(docs, few)
    finally:
        spark.conf.set(name, held)
    assert (single.slope, single.shift) == pytest.approx((whole.slope, whole.shift)) and single.thresholds == pytest.approx(whole.thresholds)


def test_toxicity_calibration_reaches_its_optimum(labelled):
    docs, _ = labelled
    rng = np.random.default_rng(5)
    model = toxicity.train([toxicity.word_ids(r["text"]) for r in docs.limit(80).collect()], rng.integers(0, 2, 80).astype(float))
    ids = [toxicity.word_ids(r["text"]) for r in docs.limit(200).collect()]
    z = model.logits(ids)
    y = (rng.random(200) < 1 / (1 + np.exp(-z))).astype(float)
    toxicity.calibrate(model, z, y, [["en", "fr", None][i % 3] for i in range(200)], 0.7)
    score = 1 / (1 + np.exp(-(model.slope * z + model.shift - model.moved)))
    every, own = toxicity.lowest(score, y), toxicity.lowest(score[::3], y[::3])
    assert set(model.thresholds) == {"en", "fr"} and model.threshold(None) == model.threshold("de") == model.overall == toxicity.CUT
    # The threshold over all languages comes to lie at the cut, and the others move with it.
    odds = lambda p: math.log(p / (1 - p))
    assert model.moved == pytest.approx(odds(toxicity.CUT) - odds(every))
    share = y[::3].sum() / (y[::3].sum() + toxicity.SHRINK)
    assert odds(model.thresholds["en"]) - model.moved == pytest.approx(odds(share * own + (1 - share) * every))
    n = y.sum()
    t = [(n + 1) / (n + 2) if v else 1 / (200 - n + 2) for v in y]
    p = [1 / (1 + math.exp(-(model.slope * v + model.shift - model.moved - 0.7))) for v in z]
    if model.slope > 0.05:
        assert abs(sum((a - b) * v for a, b, v in zip(p, t, z, strict=True)) + 1e-3 * (model.slope - 1)) < 1e-4 and abs(sum(p) - sum(t)) < 1e-4


def test_a_very_long_labelled_text_does_not_end_the_sample(labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "MAX_WORDS", 20_000)
    spark = docs.sparkSession
    first = labels.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    long = docs.where(F.col("doc_id") != first).union(spark.createDataFrame([(first, "w1 " * 30_000, "en", "s", 1)], docs.schema))
    seen = []
    real = toxicity.fitted
    monkeypatch.setattr(toxicity, "fitted", lambda spark, d, y: (seen.append(len(d)), real(spark, d, y))[1])
    toxicity.fit(long, labels)
    assert seen[0] > 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_of_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.digest(docs.repartition(4), labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    toxic = out[out.toxic == 1]
    assert toxic.predicted.mean() >= 0.85 and out[out.toxic == 0].predicted.mean() <= 0.01
    by = toxic.groupby("lang").predicted.agg(["mean", "size"])
    assert (by[by["size"] >= 10]["mean"] >= 0.7).all() and toxic.rejected.mean() >= 0.85 and out[out.toxic == 0].rejected.mean() <= 0.01


def test_top_ranks_and_their_gradient():
    """Ranks are the same whatever pieces a text is taken in."""
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 1 << 15, n) << 16 | rng.integers(0, 1 << 15, n) for n in (0, 1, 2, 7, 40)]
    model = toxicity.train(docs * 8, np.array([0.0, 1, 0, 1, 0] * 8))
    whole = model.pooled(docs)
    for piece in (1, 2, 3, 10):
        assert np.allclose(model.pooled(docs, piece), whole, atol=1e-6)
    ranks = whole.reshape(len(docs), -1, toxicity.TOP)
    assert (np.diff(ranks, axis=2) <= 0).all() and (ranks[1, :, 1:] == 0).all()


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows of a label than any bound that there was, and a text of over 300,000 words."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("w1 w2 "), F.when(F.col("id") % 10 == 0, "vile scum").otherwise(F.concat(F.lit("x"), F.col("id") % 50))).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.expr("repeat('w1 w2 ', 155000)")).otherwise(F.col("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    seen, fitted, counted, calibrate = [], toxicity.fitted, [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "fitted", lambda s, d, y: (seen.append(len(d)), fitted(s, d, y))[1])
    monkeypatch.setattr(toxicity, "calibrate", lambda m, z, y, langs, odds, n=None: (counted.append((len(y) if n is None else n.sum(), odds)), calibrate(m, z, y, langs, odds, n))[1])
    model = toxicity.fit(docs, labels)
    assert seen == [6000] and counted[0] == (6000, 0.0)
    clean, toxic = model.scores([toxicity.word_ids("w1 w2 x3"), toxicity.word_ids("w1 w2 vile scum")])
    assert toxic >= toxicity.CUT > clean


def test_toxicity_of_several_shards(labelled, monkeypatch):
    """Shards are learnt from in tasks of their own and averaged: reruns agree, however the rows lie, and held-out rows are told apart."""
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    known = labels.where(~toxicity.held_out())
    one, other = (toxicity.fit(x, known) for x in (docs, docs.repartition(5, F.rand(1))))
    assert (one.table == other.table).all() and (one.out == other.out).all()
    held = toxicity.score(docs, one, ["doc_id"]).toDF("doc_id", "score", "threshold").join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3


def test_averages_of_shards_by_loops():
    learners = [toxicity.Learner(1) for _ in range(3)]
    base = toxicity.Learner(1)
    rng = np.random.default_rng(8)
    for n, own in enumerate(learners):
        own.learn([rng.integers(0, 3000, 9) << 16 | rng.integers(0, 3000, 9) for _ in range(40)], np.arange(40) % 2.0, np.arange(n * 10, 40))
    rows = [r for n, own in enumerate(learners) for r in toxicity._changed(0, n, base, own)]
    for block in {r[1] for r in rows}:
        table = pa.Table.from_pylist([dict(zip(toxicity._STATE_ARROW.names, r, strict=True)) for r in rows[::-1] if r[1] == block], schema=toxicity._STATE_ARROW)
        [got] = toxicity._mean((pa.scalar(0), pa.scalar(block)), table).to_pylist()
        if block < 0:
            assert np.allclose(np.frombuffer(got["numbers"]), sum(x.numbers() for x in learners) / 3)
            continue
        places = np.frombuffer(got["places"], np.int32).tolist()
        for at, numbers in zip(places, np.frombuffer(got["numbers"], np.float32).reshape(-1, toxicity.DIM + 1), strict=True):
            met = [x for x in learners if x.seen[at] != base.seen[at] or (x.model.table[at] != base.model.table[at]).any()]
            assert np.allclose(numbers[:-1], sum(x.model.table[at] for x in met) / len(met), atol=1e-6) and np.allclose(numbers[-1], sum(x.seen[at] for x in met) / len(met), atol=1e-6)
        assert places == sorted(i for i in range(block * toxicity.BLOCK, min((block + 1) * toxicity.BLOCK, len(base.seen))) if any(x.seen[i] != base.seen[i] for x in learners))


def test_tops_are_the_same_in_pieces():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 1 << 15, n) << 16 | rng.integers(0, 1 << 15, n) for n in (0, 1, 2, 7, 40, 3)]
    model = toxicity.train(docs * 8, np.array([0.0, 1, 0, 1, 0, 1] * 8))
    flat, bounds = toxicity.joined(docs)
    values, places = model.tops(flat, bounds)
    for piece in (1, 2, 5, 12):
        found, at = model.tops(flat, bounds, piece)
        assert np.allclose(found, values, atol=1e-6)
        # Places count where there is a value; those of ties may differ by rounding only.
        real = np.moveaxis(values.reshape(len(docs), len(toxicity.WIDTHS), toxicity.FILTERS, toxicity.TOP), (1, 3), (0, 1)) > 0
        assert all((p[r] == q[r]).all() for p, q, r in zip(places, at, real, strict=True))
