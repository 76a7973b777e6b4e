"""The pipeline's rows against its stages in plain Python, where they aren't trained."""

import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lexispark.llm import pii, queries, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    from tests_support import brute_duplicates, brute_mix

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = toxicity.reject(docs, spark.read.parquet(f"{DATA}/labels.parquet")).select("doc_id", "text", "source").orderBy("doc_id").collect()
    assert docs.count() * 0.8 < len(kept) <= docs.count()
    comp = brute_duplicates([r["text"] for r in kept])
    first = [(r["doc_id"], pii.redact(r["text"]), r["source"]) for i, r in enumerate(kept) if comp[i] == i]
    size, _, _, taken = brute_mix(first)
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for (i, text, _), k, t in zip(first, size, taken, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        if k:
            want[(i, len(ids), *sha)] += t // k
    got = Counter(map(tuple, corpus_pipeline.run(spark, DATA).collect()))
    assert got == +want


def brute_pipeline(rows):
    """Digests of (doc_id, text, lang, source) rows that the first stage kept, by loops."""
    from tests_support import brute_duplicates, brute_mix
    from tokenizers import Tokenizer

    comp = brute_duplicates([r[1] for r in rows])
    groups = {}
    for r, c in zip(rows, comp, strict=True):
        groups.setdefault(c, []).append(r)
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    kept = [(r[0], pii.redact(r[1]), r[3]) for r in first]
    size, _, _, taken = brute_mix(kept)
    library, out = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for (i, text, _), k, t in zip(kept, size, taken, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        if k:
            out[(i, len(ids), *sha)] += t // k
    return +out


def test_run_takes_edge_rows(spark, tmp_path, edge_docs):
    """Nulls, null and repeated ids, repeated rows, long and empty texts and clashing columns through all stages; a trained
    first stage and one that learns nothing."""
    wide = edge_docs.withColumn("_score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("_threshold", F.lit(0)).withColumn("h1", F.lit(3))
    wide.where("text is null or length(text) < 100000").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text", "lang", "source").collect()]
    for labels in ([(20 + i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (21, None, None)], []):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        model = toxicity.fit(wide, spark.read.parquet(str(tmp_path / "labels.parquet")).where(~toxicity.held_out()))
        kept = [r for r in rows if model.scores([toxicity.word_ids(r[1])])[0] < model.threshold(r[2])]
        got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
        assert got == brute_pipeline(kept) and len(got) > 10


def test_stages_take_empty_tables(spark, empty_docs):
    docs = empty_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
        assert name == "bpe" or out.columns == docs.columns


ODD_COLUMNS = {"a.b": "struct('x' AS v)", "back`tick": "array(1, 2)", "plain": "map('k', 1, 'j', 2)", "deep": "array(map('k', map('i', 1)))", "_more5": "1", "ROW": "cast(null as string)"}


@pytest.mark.parametrize("n", range(4))
def test_stages_take_any_column(spark, edge_docs, n):
    """Dots, backticks, maps and names that operators use themselves."""
    name, stage = corpus_pipeline.STAGES[n]
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars").where("text is null or length(text) < 100000")
    plain = Counter(map(repr, stage(spark, docs, DATA).select("doc_id", "text", "lang", "source").collect()))
    odd = docs
    for c, e in ODD_COLUMNS.items():
        odd = odd.withColumn(c, F.expr(e))
    out = stage(spark, odd, DATA)
    assert out.columns == odd.columns and [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in odd.schema]
    rows = out.collect()
    assert Counter(repr(r) for r in spark.createDataFrame(rows, out.schema).select("doc_id", "text", "lang", "source").collect()) == plain and len(rows) > 5
    assert all(r["a.b"]["v"] == "x" and r["back`tick"] == [1, 2] and r["plain"] == {"k": 1, "j": 2} for r in rows)


def test_folders_of_a_run_that_fails_are_deleted(spark, tmp_path, monkeypatch, edge_docs):
    made = []
    monkeypatch.setattr(corpus_pipeline, "scratch", lambda s, n: (made.append(str(tmp_path / n)), f"file://{tmp_path / n}")[1])

    def broken(spark, docs, sf_dir):
        raise RuntimeError("stage")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, docs, d: docs), ("two", broken)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, DATA)
    assert made and not os.path.exists(made[0])
