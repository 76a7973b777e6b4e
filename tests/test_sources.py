"""Files and tables there and back."""

import pyspark.sql.functions as F
import pytest

from lexispark import session
from lexispark.operators import splits
from lexispark.sources import corpus as src


def test_texts_and_metadata(spark, tmp_path):
    (tmp_path / "raw/a").mkdir(parents=True)
    (tmp_path / "raw/a/one.txt").write_text("﻿one two", encoding="utf-8")
    (tmp_path / "raw/two.txt").write_text("x y z", encoding="utf-8")
    (tmp_path / "raw/skip.md").write_text("no")
    files = src.read_texts(spark, str(tmp_path / "raw"))
    files = files.select(src.relative_path(files["path"], str(tmp_path / "raw")).alias("file_path"), "text")
    assert {r[0]: r[1] for r in files.collect()} == {"a/one.txt": "one two", "two.txt": "x y z"}
    works = spark.createDataFrame([("p", "T", 1800, "novel", 1, "s", "a/one.txt", None), ("q", "U", 1801, "novel", None, "s", "gone.txt", None)], "author string, title string, year int, genre string, volume int, source string, file_path string, notes string")
    meta = src.metadata_of(works, files)
    assert [r["word_count"] for r in meta.collect()] == [2]
    src.write_metadata(meta, str(tmp_path / "meta"))
    back = src.read_metadata(spark, str(tmp_path / "meta"))
    assert back.first()["volume"] == 1 and back.first()["notes"] is None
    assert [r["text"] for r in src.load_corpus(back, files).collect()] == ["one two"]
    assert [r["file_path"] for r in src.missing(works, files).collect()] == ["gone.txt"]
    assert src.present(works, files).count() == 1


def test_labels_and_splits(spark, tmp_path):
    docs = spark.createDataFrame([("b", "train", 1), ("a", "test", 2)], "author string, split string, n int")
    labels = splits.label_ids(docs)
    src.write_labels(labels, str(tmp_path / "labels"))
    assert sorted(map(tuple, src.read_labels(spark, str(tmp_path / "labels")).collect())) == [("a", 0), ("b", 1)]
    src.write_splits(docs, str(tmp_path / "splits"))
    one = src.read_split(spark, str(tmp_path / "splits"), "test")
    assert [r["n"] for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().toString()
    src.write_results(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_bad_files_are_reported_and_passed_over(spark, tmp_path):
    (tmp_path / "good.txt").write_text("fine é", encoding="utf-8")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 \xff")
    rows = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in src.scan_texts(spark, str(tmp_path)).collect()}
    assert rows == {"good.txt": ("fine é", None), "bad.txt": (None, "not UTF-8"), "empty.txt": ("", None)}
    assert src.read_texts(spark, str(tmp_path)).count() == 2


def test_texts_there_and_back(spark, tmp_path):
    texts = [("a/b c.txt", "one\ntwo"), ("é/100%.txt", ""), ("x.txt", "\ufeffmark"), ("a__b.txt", "under"), ("a/b.txt", "slash"), ("a/b/c%20.txt", "\r\n"), ("a/_hidden.txt", "h"), ("none.txt", None)]
    df = spark.createDataFrame(texts, "file_path string, text string").repartition(3)
    folder = str(tmp_path / "out")
    for _ in range(2):  # a second time over the first
        src.write_texts(df, folder)
        back = src.read_texts(spark, folder, bom=False)
        assert {r[0]: r[1] for r in back.select(src.written_path(F.col("path"), folder), "text").collect()} == {p: t for p, t in texts if t is not None and "_hidden" not in p}
    assert sum(p.is_file() and not p.name.endswith(".crc") for p in (tmp_path / "out").rglob("*")) == 7
    named = src.load_named(df.select("file_path"), folder, bom=False)
    assert {r[0]: r[1] for r in named.select("file_path", "text").collect()} == dict(texts)
    for bad in ("../x.txt", "/x.txt", "a/", ""):
        with pytest.raises(Exception, match="no path below the folder"):
            src.write_texts(spark.createDataFrame([(bad, "t")], "file_path string, text string"), folder)


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    texts = [(f"a/{i % 3}/b{i}.txt", f"text {i}") for i in range(60)] + [("top.txt", "t"), ("a/_no/x.txt", "h"), ("a/.no/x.txt", "h"), ("a/x.md", "m"), ("a/k=1/y.txt", "y"), ("z.gz.txt", "z")]
    folder = str(tmp_path / "out of it")
    for path, text in texts:
        at = tmp_path / "out of it" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    rows = src.read_texts(spark, folder)
    assert len(rows.inputFiles()) == 0  # no index of files, which a driver would hold
    want = {f"file:{folder}/{p}": t for p, t in texts if "_no" not in p and ".no" not in p and not p.endswith(".md")}
    assert {r["path"]: r["text"] for r in rows.collect()} == want
    src.remove_tree(spark, folder)
    src.remove_tree(spark, folder)
    assert not (tmp_path / "out of it").exists()
    with pytest.raises(FileNotFoundError):
        src.read_texts(spark, folder)


def test_files_that_metadata_names(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/one.txt").write_text("\ufeffone é", encoding="utf-8")
    (tmp_path / "in/empty.txt").write_bytes(b"")
    (tmp_path / "in/bad.txt").write_bytes(b"caf\xe9 \xff")
    (tmp_path / "secret.txt").write_text("no")
    names = ["sub/one.txt", "empty.txt", "bad.txt", "gone.txt", None, "../secret.txt", "sub", "sub/one.txt"]
    works = spark.createDataFrame([(i, n, f"w{i}") for i, n in enumerate(names)], "id int, file_path string, `a.b` string").repartition(3)
    rows = {r["id"]: r for r in src.load_named(works, str(tmp_path / "in")).collect()}
    assert {i: r["text"] for i, r in rows.items() if r["error"] is None} == {0: "one é", 1: "", 7: "one é"}
    assert rows[2]["error"] == "not UTF-8" and rows[3]["error"] == "missing" and rows[4]["error"] == rows[5]["error"] == "no path below the folder" and rows[6]["error"]
    assert all(r["a.b"] == f"w{i}" for i, r in rows.items())
    kept = src.load_named(works.where("id = 0"), f"file://{tmp_path}/in", bom=False).first()["text"]
    assert kept == "\ufeffone é"


def test_summary_file(spark, tmp_path):
    src.write_table(spark.createDataFrame([("a", "1,234"), ("b", None)], "author string, total string"), str(tmp_path / "s"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "s"), header=True).collect()} == {("a", "1,234"), ("b", None)}
    assert len(list((tmp_path / "s").glob("part-*"))) == 1


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "nine"))
    one, nine = (session.spread(spark.read.parquet(str(tmp_path / n))) for n in ("one", "nine"))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and one.count() == 100
    assert "Exchange" not in nine._jdf.queryExecution().toString()


def test_scratch_folders_are_deleted(spark):
    folder = session.scratch(spark, "test")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    session.remove(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
