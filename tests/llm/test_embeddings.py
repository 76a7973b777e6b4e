"""Links and components against brute force."""

import numpy as np

from lexispark.llm import common, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, root long, copies int"


def brute(rows):
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is None or a[2] != b[2] or not sound(a[1]) or not sound(b[1]) or len(a[1]) != len(b[1]):
                continue
            x, y = (np.array(r[1], np.float32).astype(float) for r in (a, b))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    comp = [find(i) for i in range(n)]
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], k, least.get(c), r[0] is not None and r[0] == least.get(c)) for r, k, c in zip(rows, links, comp, strict=True)), key=str)


def rows():
    rng = np.random.default_rng(4)
    out = []
    for c in range(25):
        x = rng.normal(size=16)
        for _ in range(12):
            out.append([len(out), [float(v) for v in np.float32(x + rng.normal(size=16) * 0.1)], c % 3])
    out += [[len(out) + i, out[i][1], out[i][2]] for i in range(30)]
    e = out[0][1]
    out += [[900, None, 1], [901, [], 1], [902, [0.0] * 16, 1], [903, [float("nan"), *e[1:]], 0], [904, [float("inf"), *e[1:]], 0], [905, [None, *e[1:]], 0], [906, e, None], [907, e[:8], 0], [908, [2 * v for v in e], 0], [0, e, 0], [None, e, 0], [909, [-0.0, 1.0], 0], [910, [0.0, 1.0], 0]]
    return [tuple(r) for r in out]


def test_against_brute_force(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in data], SCHEMA).repartition(5)
    want = brute(data)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    missed = sum(w[1] - g[1] for w, g in zip(want, got, strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and missed <= 0.1 * sum(w[1] for w in want)
    assert sum(g[2:] == w[2:] for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)
    special = {g[0]: g for g in got if g[0] is not None and g[0] >= 900}
    assert all(special[i][1:] == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 906, 907))
    assert special[909][1] == 1 and special[910][1:] == (1, 909, False)


def test_small_blocks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows()], SCHEMA)
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    deal = common.block_pairs
    monkeypatch.setattr(common, "block_pairs", lambda keyed, key, member: deal(keyed, key, member, 4))
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str) == whole


def test_recall_at_the_threshold(spark):
    """Pairs right at the threshold, where neighbouring pivots differ most."""
    rng = np.random.default_rng(6)
    data = []
    for i in range(400):
        x, z = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        y = 0.9805 * x + np.sqrt(1 - 0.9805**2) * z
        data += [(2 * i, [float(v) for v in x], 1), (2 * i + 1, [float(v) for v in y], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    assert got.where("n_links > 0").count() >= 0.97 * 800


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
