"""Curves, running totals, windows across volumes, components, passages, TEI: against brute force, numpy, an XML parser."""

import itertools
import random
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import tei
from lexispark.operators import chunks, components, metrics, ranking, voices


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(parts)
        rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.6 else f"g{rng.randint(0, 5)}", i, rng.randint(0, 9)) for i in range(400)]
        df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
        got = {r["i"]: (r["s"], r["s_total"]) for r in ranking.running(df, ["g"], [F.desc("i")], {"s": F.col("v")}).collect()}
        assert got == {i: (sum(v for h, j, v in rows if h == g and j >= i), sum(v for h, _, v in rows if h == g)) for g, i, _ in rows}
        every = {r["i"]: r["s"] for r in ranking.running(df, [], [F.col("i")], {"s": F.lit(1)}).collect()}
        assert every == {i: i + 1 for i in range(400)}
        assert ranking.running(df.limit(0), ["g"], [F.col("i")], {"s": F.col("v")}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_roc_and_area(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), rng.random() < (0.7 if g == "a" else 0.2)) for g in "aaab" for _ in range(60)] + [("c", 0.3, True), ("c", 0.4, True)]
    df = spark.createDataFrame(rows, "g string, score double, positive boolean").repartition(4)
    areas = {r["g"]: r["auc"] for r in metrics.area(df, ["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for h, s, p in rows if h == g and p == q] for q in (True, False))
        assert areas[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert areas["c"] is None
    for r in metrics.roc(df.where("g = 'a'"), ["g"]).collect():
        own = [(s, p) for h, s, p in rows if h == "a"]
        n = sum(p for _, p in own)
        hits, misses = (sum(p == q and round(s, 9) >= r["threshold"] for s, p in own) for q in (True, False))
        assert (r["hits"], r["misses"]) == (hits, misses) and r["tpr"] == pytest.approx(hits / n) and r["fpr"] == pytest.approx(misses / (len(own) - n))


@pytest.mark.parametrize("size, stride, least", [(6, 3, 1), (5, 5, 2), (4, 7, 1), (8, 2, 3), (50, 25, 1)])
def test_windows_across_volumes(spark, size, stride, least):
    rng = random.Random(size)
    vols = [(w, v, " ".join(f"{w}{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 2, 5, 40])))) for w in ("a", "b", None) for v in range(6)] + [("one", 1, "x y z")]
    df = spark.createDataFrame(vols, "work string, volume int, text string").where("work is not null").repartition(4)
    got = sorted((r["work"], r["chunk_ix"], r["start_pos"], r["n_tokens"], tuple(r["tokens"])) for r in chunks.across(df, ["work"], "volume", size, stride, least).collect())
    want = []
    for work in ("a", "b", "one"):
        t = " ".join(x for w, _, x in sorted((v for v in vols if v[0] == work), key=lambda v: v[1])).split()
        for k in itertools.count():
            cut = t[k * stride : k * stride + size]
            if len(cut) >= least:
                want.append((work, k, k * stride, len(cut), tuple(cut)))
            if k * stride + size >= len(t):
                break
    assert got == sorted(want)
    assert chunks.across(df.limit(0), ["work"], "volume").count() == 0


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 7)) @ np.diag([5, 3, 3, 1, 0.5, 0, 2]) + 10
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)], "i long, v array<double>").repartition(4)
    n, mean, square = components.moments(df, "v")
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(square, np.cov(x.T, bias=True))
    c = components.Components.fit(df, "v", 4)
    values, vectors = np.linalg.eigh(square)
    assert np.allclose(c.variances, values[::-1][:4], rtol=1e-8) and c.total == pytest.approx(values.sum())
    for mine, own in zip(c.vectors, vectors.T[::-1], strict=False):
        assert abs(mine @ own) == pytest.approx(1, abs=1e-6) and mine[np.abs(mine).argmax()] > 0
    got = {r["i"]: r["p"] for r in df.where("i >= 0").select("i", c.project(F.col("v")).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(300)], (x - mean) @ c.vectors.T, atol=1e-8)
    assert components.moments(df.limit(0), "v")[0] == 0 and components.Components.fit(df.where("i < 2 and i >= 0").union(df.where("i = 0")), "v", 2).variances[1] < 1e-9


def test_centroids_over_time(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 1, [3.0, 0.0]), ("a", 2, [1.0, 1.0]), ("a", 5, [0.0, 0.0]), ("b", 1, [1.0, 2.0])]
    g = components.centroids(spark.createDataFrame(rows, "who string, t int, v array<double>"), ["who", "t"], "v")
    assert {(r["who"], r["t"]): (r["n"], r["centroid"]) for r in g.collect()}[("a", 1)] == (2, [2.0, 0.0])
    out = {(r["who"], r["t"]): (r["next_period"], r["similarity"]) for r in components.over_time(g, ["who"], "t").collect()}
    assert out[("a", 1)] == (2, pytest.approx(0.5**0.5)) and out[("a", 2)] == (5, None) and len(out) == 2


def test_path_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n, a, cost = rng.integers(1, 7), rng.integers(1, 4), float(rng.choice([0.0, 0.5, 2.0, 9.0]))
        scores = rng.normal(size=(n, a)) * 3
        worth = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - cost * sum(p[i] != p[i + 1] for i in range(len(p) - 1))  # noqa: B023, E731
        best = max(worth(p) for p in itertools.product(range(a), repeat=int(n)))
        assert worth(voices.best_path(scores, cost).tolist()) == pytest.approx(best)
    assert len(voices.best_path(np.zeros((0, 3)), 1.0)) == 0


def test_passages_of_two_authors(spark):
    rng = np.random.default_rng(5)
    rows, true = [], {}
    for doc in range(20):
        n, at = 40, int(rng.integers(5, 35))
        true[doc] = at
        for i in range(n):
            own = 0 if i < at else 2
            rows.append((doc, i, [float(-1.0 * (k != own) + rng.normal() * 0.5) for k in range(3)]))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(d), int(i), list(v)) for d, i, v in rows], "doc_ord long, chunk_ix int, logps array<double>").repartition(4)
    got = voices.passages(df, ["x", "y", "z"], 4.0, 64).orderBy("doc_ord", "passage").collect()
    by = {d: [(r["author"], r["first_chunk"], r["last_chunk"], r["first_token"]) for r in got if r["doc_ord"] == d] for d in true}
    assert all([p[0] for p in by[d]] == ["x", "z"] for d in true) and sum(abs(by[d][1][1] - true[d]) <= 1 for d in true) >= 18
    assert all(p[3] == p[1] * 64 and p[2] >= p[1] for d in true for p in by[d])
    docs = spark.createDataFrame([(i, f"a{i}", "w " * (i + 1), i) for i in range(5)], "doc_ord long, author string, text string, rank long")
    assert sorted((r["doc_ord"], r["first_author"], r["second_author"], r["boundary"], len(r["text"].split())) for r in voices.spliced(docs, "rank").collect()) == [(0, "a0", "a1", 1, 3), (2, "a2", "a3", 3, 7)]


def random_markup(rng, depth=0):
    """Well-formed content with all that the scanner has to know."""
    out = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.randint(0, 8)
        if kind <= 2:
            out.append(rng.choice(["plain ", "é-\n  x", "&lt;b&gt;", "&#65;&#x42;", "&amp;amp;", ">", "a\r\nb", "]"]))
        elif kind == 3:
            out.append("<!-- <body> & </p> -->")
        elif kind == 4:
            out.append("<![CDATA[<body>&amp;</body>]]>")
        elif kind == 5:
            out.append("<?pi <x> ?>")
        elif kind == 6:
            out.append("<t:lb n=\"a>b\" m='\"'/>")
        elif depth < 4:
            name = rng.choice(["p", "t:div", "body", "t:body", "teiHeader", "hi"])
            out.append(f"<{name} a = 'x'>{random_markup(rng, depth + 1)}</{name}>")
    return "".join(out)


def by_parser(document):
    def walk(e, inside):
        name = e.tag.rpartition("}")[2]
        if name == "teiHeader":
            return ""
        inside = inside or name == "body"
        out = (e.text or "") if inside else ""
        for c in e:
            out += walk(c, inside) + ((c.tail or "") if inside else "")
        return out

    return tei._HYPHEN.sub("", walk(ET.fromstring(document), False))


def test_tei_equals_a_parser():
    rng, seen = random.Random(6), 0
    for _ in range(600):
        document = f'<?xml version="1.0"?><!DOCTYPE TEI [<!ENTITY z "</body>">]><t:TEI xmlns:t="u"><t:teiHeader><body>no</body></t:teiHeader><text>{random_markup(rng)}<body>{random_markup(rng)}</body>{random_markup(rng)}</text></t:TEI>'
        text, error = tei.body(document)
        assert error is None and text == by_parser(document)
        seen += bool(text)
        broken = document.replace("</text>", "", 1)
        assert tei.body(broken)[1]
        with pytest.raises(ET.ParseError):
            ET.fromstring(broken)
    assert seen > 300


@pytest.mark.parametrize("document", ["<a><b></a></b>", "<a>&nope;</a>", "<a>& b</a>", "<a", "<a><!-- x</a>", "<a><![CDATA[x</a>", "</a>", "<a x=1></a>", "<a>&#0;</a>", "<!DOCTYPE x [", "<a>&#x110000;</a>", "<a>]]></a>"])
def test_broken_markup_is_reported(document):
    assert tei.body(document)[1]
    with pytest.raises(ET.ParseError):
        ET.fromstring(document)


def test_tei_column(spark):
    rows = [(1, "<TEI><body rend='x'><p>a &lt;b&gt; &amp;amp; wo-\n  rd<lb/>s</p></body></TEI>"), (2, None), (3, ""), (4, "<bodyguard>x</bodyguard>"), (5, "<body>so far</p>"), (6, "<TEI><!-- <body>x</body> --><tei:body>y</tei:body></TEI>")]
    got = {r["i"]: (r["t"]["body"], bool(r["t"]["error"])) for r in spark.createDataFrame(rows, "i int, x string").select("i", tei.tei_text(spark, F.col("x")).alias("t")).collect()}
    assert got == {1: ("a <b> &amp; words", False), 2: (None, False), 3: ("", False), 4: ("", False), 5: ("so far", True), 6: ("y", False)}
