"""The mix against one ordered pass in Python, and its SQL."""

import hashlib
import re

import duckdb
import pytest

from lexispark.llm import mixing, queries


def brute(docs):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    names = sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    total = {n: sum(k for k, d in zip(size, docs, strict=True) if d[2] == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    budget, full = 1.5 * sum(size), set()
    while True:
        rest = budget - sum(2 * total[n] for n in full)
        w = sum(weight[n] for n in names if n not in full)
        target = {n: 2.0 * total[n] if n in full else rest * weight[n] / w for n in names}
        over = {n for n in names if n not in full and target[n] > 2 * total[n]}
        if not over:
            break
        full |= over
    offers, cum = [], {}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for key, k, n, i in sorted((md5(f"mix:{'null' if d[0] is None else d[0]}:{md5(d[1] or '')}"), k, names.index(d[2]), i) for i, (d, k) in enumerate(zip(docs, size, strict=True))):
        cum[n] = cum.get(n, 0) + k
        if k:
            offers += [((cum[n] + e * total[names[n]]) / target[names[n]], n, e, key, k, i) for e in (0, 1) if cum[n] - k + e * total[names[n]] < target[names[n]]]
    taken, used = [0] * len(docs), 0
    for o in sorted(offers):
        used += o[4]
        if o[0] > 1 and used > budget:
            break
        taken[o[5]] += o[4]
    return size, total, target, taken


def data():
    docs = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", "d", "é", None][i % 6] if i % 2 else "hot") for i in range(400)]
    docs += [(900, None, "a"), (901, "", "b"), (None, "x y", "c"), (None, "x y", "c"), (902, "w " * 5000, "d"), (3, docs[3][1], docs[3][2]), (903, "", "none")]
    return docs


def test_against_one_pass(spark, monkeypatch):
    docs = data()
    df = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], "doc_id long, text string, source string, size int, key string, target int").repartition(5)
    size, total, target, taken = brute(docs)
    want = sorted(((d[0], k, total[d[2]], round(target[d[2]], 6), t) for d, k, t in zip(docs, size, taken, strict=True)), key=str)

    def got():
        return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.digest(df).collect()), key=str)

    assert got() == want
    monkeypatch.setattr(mixing, "LANE_DIGITS", 1)
    assert got() == want
    for n in total:
        own = sum(t for d, t in zip(docs, taken, strict=True) if d[2] == n)
        assert abs(own - target[n]) <= max([k for d, k in zip(docs, size, strict=True) if d[2] == n], default=0)
    assert "Python" not in mixing.digest(df)._jdf.queryExecution().toString()


def test_mix_repeats_rows(spark, edge_docs, empty_docs):
    docs = data()
    df = spark.createDataFrame([(*d, "t", 7) for d in docs], "doc_id long, text string, source string, rank string, cum int").repartition(3)
    out = mixing.mix(df)
    assert out.columns == df.columns
    size, _, _, taken = brute(docs)
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(taken)
    assert out.where("text is null or text = ''").count() == 0
    assert mixing.mix(empty_docs).count() == 0 == mixing.digest(empty_docs).count()
    assert mixing.digest(edge_docs).count() == edge_docs.count()
    nothing = mixing.digest(df.where("text is null or text = ''")).collect()
    assert len(nothing) == 3 and all(r["taken"] == 0 and r["target"] == 0 for r in nothing)


@pytest.mark.parametrize("rows", [400, 7, 1])
def test_sql(spark, tmp_path, rows):
    df = spark.createDataFrame(data()[-rows:], "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.MIXING).fetchall()
    got = queries.queries()["op10_mixing"](spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), r[1], r[4])
    assert [(r[0], r[1], r[2], r[4]) for r in sorted(map(tuple, got), key=key)] == [(r[0], r[1], r[2], r[4]) for r in sorted(want, key=key)]
