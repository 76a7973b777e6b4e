"""Slices of batches, filters, components with hubs, blocks of groups."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import common


def test_slices_are_bounded_by_rows_and_bytes():
    rng = random.Random(2)
    for _ in range(40):
        texts = [None if rng.random() < 0.1 else "é" * rng.choice([0, 1, 5, 40, 300]) for _ in range(rng.randint(0, 60))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
        out = list(common.text_batches(iter([batch]), 7, 200))
        assert [x for b in out for x in b.column(0).to_pylist()] == list(range(len(texts)))
        for b in out:
            size = sum(len((x or "").encode()) for x in b.column(1).to_pylist())
            assert 0 < b.num_rows <= 7 and (size <= 200 or b.num_rows == 1)


def test_filter_misses_nothing(spark):
    rows = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit("x").alias("_word"))
    held = spark.range(0, 5000, 50).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    out = common.filtered(rows.drop("_word"), held, ["a", "b"], "maybe")
    assert out.count() == 5000 and out.where("a % 50 = 0 and maybe").count() == 100 and out.where("maybe").count() < 300
    assert common.filtered(rows.drop("_word"), held.limit(0), ["a", "b"], "maybe").where("maybe").count() == 0


@pytest.mark.parametrize("share", [1 / 512, 1e-9, 1.0])
def test_components_with_hubs(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HUB_SHARE", share)
    monkeypatch.setattr(common, "EDGE_ROWS", 500)
    rng = random.Random(3)
    edges = [(rng.randint(10_000, 10_900), 7) for _ in range(1500)] + [(i, i + 1) for i in range(200, 260)] + [(50, 50), (None, 3), (7, 10_001), (10_001, 7)]
    edges += [(rng.randint(20_000, 20_400), rng.randint(20_000, 20_400)) for _ in range(150)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in root}


def test_members_of_a_group_meet_in_blocks(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 100), (3, 200), (3, 201)], "key long, node long")
    dealt = common.block_pairs(rows, "key", "node", 8).collect()
    met = {}
    for r in dealt:
        met.setdefault((r["key"], r["lo"], r["hi"]), []).append((r["b"], r["node"]))
    pairs = set()
    for (k, lo, hi), members in met.items():
        pairs |= {(k, *sorted((x, y))) for b, x in members for c, y in members if x != y and (lo == hi or b != c)}
    assert pairs == {(1, i, j) for j in range(50) for i in range(j)} | {(3, 200, 201)}
