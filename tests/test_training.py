"""The trained classifier, word pieces, the pivot index: against loops, libraries and brute force."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from lexispark.functions import subwords
from lexispark.operators import chunks, classifier, explanations, features, scoring
from lexispark.plans import training


def lists(*x):
    return pa.array([list(r) for r in x], pa.list_(pa.int32()))


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    w, label, x = rng.normal(size=(9, 3)), np.array([0, 2, 1, 1]), lists([0, 1, 1, 7], [3], [], [2, 2, 5])
    _, g = classifier.gradient(w, label, x)
    for i in range(9):
        for c in range(3):
            up, down = w.copy(), w.copy()
            up[i, c] += 1e-5
            down[i, c] -= 1e-5
            assert abs((classifier.gradient(up, label, x)[0] - classifier.gradient(down, label, x)[0]) / 2e-5 - g[i, c]) < 1e-6


def loop(rows, config, names):
    """The same training, row by row in one process, with dense vectors."""
    size = 1 << config.bits
    w, m, v, at = np.zeros((size + 1, len(names))), 0.0, 0.0, 0

    def vector(x):
        out = np.zeros(size + 1)
        for i in x:
            out[i] += 1
        out = np.sqrt(out)
        out /= np.linalg.norm(out) or 1
        out[-1] = 1
        return out

    def probs(x):
        z = x @ w
        e = np.exp(z - z.max())
        return e / e.sum()

    train = [(r["batch"], names.index(r["author"]), vector(r["x"])) for r in rows if r["split"] == "train"]
    check = [(names.index(r["author"]), vector(r["x"])) for r in rows if r["split"] == "validation"]
    steps, history, best, score = config.epochs * config.batches, [], w, -1
    for epoch in range(config.epochs):
        loss = 0.0
        for b in classifier.batch_order(epoch, config):
            own = [t for t in train if t[0] == b]
            g = np.zeros_like(w)
            for _, y, x in own:
                p = probs(x)
                loss -= math.log(p[y])
                p[y] -= 1
                g += np.outer(x, p)
            if not own:
                continue
            g /= len(own)
            rate = config.rate * ((at + 1) / config.warmup if at < config.warmup else (steps - at) / (steps - config.warmup))
            at += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            decayed = w - rate * config.decay * w
            decayed[-1] = w[-1]
            w = decayed - rate * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.999**at)) + 1e-8)
        right = sum(int(probs(x).argmax()) == y for y, x in check) / len(check)
        history.append((loss / len(train), -sum(math.log(probs(x)[y]) for y, x in check) / len(check), right))
        f1 = classifier.f1_scores([(names[y], names[int(probs(x).argmax())], 1) for y, x in check])[2]
        if f1 > score:
            best, score = w, f1
    return best, history


@pytest.fixture(scope="module")
def windows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        author = "abc"[i % 3]
        own = [f"{author}{rng.randint(0, 8)}" if rng.random() < 0.25 else f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 40))]
        rows.append((i, author, ("train", "train", "validation", "test")[rng.randint(0, 3)], own))
    return spark.createDataFrame(rows, "doc_ord long, author string, split string, tokens array<string>").repartition(5)


def test_training_equals_one_process(spark, windows):
    config = classifier.Config(epochs=3, batches=3, bits=8, warmup=2, rate=0.2)
    model = classifier.train(windows, ["doc_ord"], config)
    rows = classifier.featured(windows, config.bits).withColumn("batch", F.pmod(F.xxhash64(F.lit(config.seed), "doc_ord"), F.lit(config.batches))).collect()
    weights, history = loop(rows, config, ["a", "b", "c"])
    assert np.allclose(model.weights, weights, atol=1e-6)
    assert np.allclose([(h[2], h[3], h[4]) for h in model.history], history, atol=1e-6)
    assert all(h[8] == sum(r["split"] == "train" for r in rows) and h[9] == sum(len(r["x"]) for r in rows if r["split"] == "train") for h in model.history)
    scored = model.scored(windows.where("split = 'test'")).collect()
    assert sum(r["pred"] == r["author"] for r in scored) > 0.6 * len(scored) and all(abs(sum(r["probs"]) - 1) < 1e-9 for r in scored)
    assert classifier.train(windows.repartition(2), ["doc_ord"], config).history[-1][2] == pytest.approx(model.history[-1][2], abs=1e-9)


def test_patience_and_edges(spark, windows):
    still = classifier.train(windows, ["doc_ord"], classifier.Config(epochs=9, batches=1, bits=6, rate=0.0, patience=2))
    assert len(still.history) == 3 and [h[7] for h in still.history] == [True, False, False]
    nothing = windows.where("split = 'nowhere'")
    with pytest.raises(ValueError):
        classifier.train(nothing, ["doc_ord"])
    assert still.scored(nothing).count() == 0
    alone = classifier.train(windows.where("split = 'train' and author = 'a'"), ["doc_ord"], classifier.Config(epochs=1, batches=2, bits=6))
    assert alone.labels == ["a"] and alone.history[0][3:7] == (0.0, 0.0, 0.0, 0.0)


def test_better_than_counts(spark):
    """On works held out the trained classifier beats the model of word counts."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        author = "xy"[i % 2]
        # Both use the same words as often; only their order differs.
        words = [w for _ in range(20) for w in (("red", "fox") if author == "x" else ("fox", "red")) + (f"n{rng.randint(0, 40)}",)]
        rows.append((i, author, f"t{i % 12}", " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_ord long, author string, title string, text string")
    docs = docs.withColumn("split", F.when(F.col("title").isin("t0", "t1"), "test").when(F.col("title").isin("t2", "t3"), "validation").otherwise("train"))
    tokens = chunks.chunk(docs, 128, 64, 16)
    model = classifier.train(tokens.select("doc_ord", "chunk_ix", "author", "split", "tokens"), ["doc_ord", "chunk_ix"], classifier.Config(batches=4))
    trained = model.scored(tokens.where("split = 'test'").select("author", "tokens")).agg(F.avg((F.col("pred") == F.col("author")).cast("int"))).first()[0]
    counted = scoring.predictions(scoring.probabilities(scoring.logits(docs.where("split = 'test'"), scoring.multinomial(docs.where("split = 'train'")), 128, 64, 16)))
    counted = counted.join(docs.select("doc_ord", "author"), "doc_ord").agg(F.avg((F.col("pred") == F.col("author")).cast("int"))).first()[0]
    assert trained > 0.95 > counted


@pytest.fixture(scope="module")
def library():
    vocabulary = training.pieces().vocabulary
    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(vocabulary)}, unk_token=subwords.UNKNOWN, max_input_chars_per_word=subwords.LONGEST))
    t.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return t


TEXTS = ["", " \t\n", "Café naïve it's don_t", "unbelievably hyphen-ated 3.14", "日本語 テスト", "x" * 101, "x" * 100, "a​b \x00 \x07 é́", "ﬁne ﬀ ß İ", "word " * 3000, "𝔘𝔫𝔦 ∑ €5 «q»"]


def test_pieces_equal_the_library(spark, library):
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(0x20, 0x7E), rng.randint(0xA0, 0x17F), rng.randint(0x391, 0x3C9), rng.randint(0x4E00, 0x4E80)])) for _ in range(40)) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_ord long, text string").repartition(3)
    model = training.pieces()
    got = {r["doc_ord"]: r["t"] for r in df.select("doc_ord", model.tokenizer(spark)(F.col("text")).alias("t")).collect()}
    assert all(got[i] == library.encode(t).tokens for i, t in enumerate(texts)) and got[-1] == []


def test_windows_of_pieces(spark, library):
    text = " ".join(f"word{i} unbelievable" for i in range(300))
    model = training.pieces()
    rows = chunks.chunk(spark.createDataFrame([(1, text)], "doc_ord long, text string"), 64, 32, 16, model.tokenizer(spark)).withColumn("d", subwords.decode(F.col("tokens"))).orderBy("chunk_ix").collect()
    whole = library.encode(text).tokens
    assert [r["tokens"] for r in rows] == [whole[r["start_pos"] : r["start_pos"] + 64] for r in rows] and rows[-1]["start_pos"] + 64 >= len(whole)
    back = lambda t: " ".join(t).replace(" ##", "").removeprefix("##")
    assert [r["d"] for r in rows] == [back(r["tokens"]) for r in rows]


def test_small_vocabulary():
    model = subwords.WordPiece(["[UNK]", "un", "##aff", "##able", "a", "##a", "##", "!"])
    assert model.encode("Unaffable! b aa") == ["un", "##aff", "##able", "!", "[UNK]", "a", "##a"]
    assert public_tokenizers.path(training.PIECES)


def brute_nearest(test, train, k):
    out = []
    for i, a in test:
        near = sorted((round(sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a), 9) if a else 0.0, j) for j, b in train)[:k]
        out += [(i, p + 1, d, j) for p, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("case", ["clusters", "ties", "no words", "few"])
def test_nearest(spark, monkeypatch, case):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 6)) * 10
    vec = {"clusters": lambda i: (centres[i % 9] + rng.normal(size=6)).tolist(), "ties": lambda i: [float(i % 3)] * 4, "no words": lambda i: [], "few": lambda i: [float(i), 1.0]}[case]
    n = 3 if case == "few" else 700
    train, test = [(i, vec(i)) for i in range(n)], [(1000 + i, vec(i)) for i in range(60)]
    for block, sample in ((512, 4096), (16, 40)):
        monkeypatch.setattr(features, "BLOCK", block)
        monkeypatch.setattr(features, "SAMPLE", sample)
        a, b = (spark.createDataFrame(x, "doc_ord long, z array<double>").repartition(3) for x in (test, train))
        got = sorted((r["doc_ord"], r["place"], r["delta"], r["neighbour"]) for r in features.nearest(a, b, 3).collect())
        assert got == brute_nearest(test, train, 3)
    if case == "clusters":
        shares = []
        for size in (150, 700):
            r = features.pairs_met(a, b.where(f"doc_ord < {size}"), 3).first()
            shares.append(r["met"] / r["every"])
        assert shares[1] < shares[0] and shares[1] < 0.3
    empty = b.limit(0)
    assert features.nearest(a, empty).count() == 0 == features.nearest(empty, b).count()


def worth_of(words, features, held, weight):
    """The worth of a set of players, from its features alone."""
    n = len(words)
    own = [features[i] for i in range(n) if words[i] in held] + [features[n + i] for i in range(n - 1) if words[i] in held and words[i + 1] in held]
    return sum(own.count(f) ** 0.5 * weight[f] for f in set(own)) / len(own) ** 0.5 if own else 0.0


def exact_values(words, features, weight):
    players = max(words) + 1
    out = np.zeros(players)
    for p in range(players):
        rest = [q for q in range(players) if q != p]
        for k in range(players):
            share = math.factorial(k) * math.factorial(players - k - 1) / math.factorial(players)
            for held in itertools.combinations(rest, k):
                out[p] += share * (worth_of(words, features, {*held, p}, weight) - worth_of(words, features, set(held), weight))
    return out


def test_shapley_values():
    """Gains of every permutation give the exact values; a few are near them and add up to the whole."""
    rng = np.random.default_rng(3)
    weight = rng.normal(size=9)
    words = [0, 1, 2, 1, 3, 4, 0]
    features = rng.integers(0, 8, 13).tolist()
    exact = exact_values(words, features, weight)
    every = np.mean([explanations.gains(words, features, list(o), weight) for o in itertools.permutations(range(5))], axis=0)
    assert np.allclose(every, exact)
    eight, features = list(range(8)), rng.integers(0, 8, 15).tolist()
    exact = exact_values(eight, features, weight)
    value, spread = explanations.shapley(eight, features, weight, 400, [1])
    assert np.allclose(value.sum(), worth_of(eight, features, set(eight), weight)) and (np.abs(value - exact) < 5 * spread + 1e-9).all() and spread.max() < 0.1
    few = explanations.shapley(eight, features, weight, 2, [1])[0]
    assert np.allclose(few.sum(), exact.sum())


def test_explanations_add_up(spark, windows):
    model = classifier.train(windows, ["doc_ord"], classifier.Config(epochs=2, batches=2, bits=8, rate=0.2))
    test = windows.where("split = 'test'")
    rows = explanations.explained(model, test, ["doc_ord"], pairs=3, top=0).collect()
    scored = {r["doc_ord"]: r for r in model.scored(test).collect()}
    tokens = {r["doc_ord"]: r["tokens"] for r in test.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["doc_ord"], []).append(r)
    assert set(by) == {d for d, t in tokens.items() if t}
    for d, own in by.items():
        assert sum(r["value"] for r in own) == pytest.approx(own[0]["worth"], abs=1e-9) and {r["word"] for r in own} == set(tokens[d]) and own[0]["pred"] == scored[d]["pred"]
        # A softmax's log-probabilities are logits but for a constant.
        logs = np.log(scored[d]["probs"])
        best = int(np.argmax(logs))
        bias = explanations.margin(model.weights, best)[-1]
        assert own[0]["worth"] == pytest.approx(logs[best] - np.delete(logs, best).mean() - bias, abs=1e-6)
    assert rows and {r["word"][0] for r in rows if abs(r["value"]) > 0.3} <= set("abcw")
    assert sorted(map(repr, explanations.explained(model, test.repartition(2), ["doc_ord"], pairs=3, top=0).collect())) == sorted(map(repr, rows))
    assert explanations.explained(model, test, ["doc_ord"], top=2).groupBy("doc_ord").count().where("count > 2").isEmpty()
