"""Reading texts, metadata and labels; writing results. Everything goes through Spark's readers and writers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.session import cut, remove, ship, spread

#: Columns of corpus metadata, in file order.
METADATA = "author string, title string, year int, genre string, volume int, word_count int, source string, file_path string, notes string"
#: Files of a task where there are very many; bytes of files that are sent at once; entries of a folder that are.
FILES, READ, LISTED = 1000, 8 << 20, 10_000
LABELS = "author_to_id map<string,int>, id_to_author map<string,string>"


def read_texts(spark: SparkSession, folder: str, bom: bool = True) -> DataFrame:
    """(path, text) of all .txt files below a folder that are UTF-8; with bom a byte-order mark is dropped."""
    return scan_texts(spark, folder, bom).where("error is null").drop("error")


def scan_texts(spark: SparkSession, folder: str, bom: bool = True) -> DataFrame:
    """(path, text, error) of all .txt files below a folder; a file that isn't UTF-8 has no text and says so in error.

    Files that vanish or break while they are read are passed over, so one bad file doesn't end the scan, as are those that had no
    bytes when they were listed and have some now. Files and folders whose names begin with "_" or "." are hidden, as they are from
    Spark's readers; load_named opens such files. Tasks list the folders and open the files: Spark's readers would hold the state of every file in the driver.
    """
    listed = listing(spark, folder)
    top = listed.path
    # A file of no bytes may be one that is still being written.
    growing = [r["path"] for r in listed.files.where("size = 0").toLocalIterator() if size_of(spark, f"{top}/{r['path']}") != 0]
    files = listed.files.where(~F.col("path").isin(growing)) if growing else listed.files
    tasks = max(4 * spark.sparkContext.defaultParallelism, listed.files.count() // FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(top)
        paths, contents, held = [], [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with store.open_input_stream(f"{root}/{path}", compression=None) as f:
                        contents.append(f.read())
                except OSError:
                    continue
                paths.append(f"{top}/{path}")
                held += len(contents[-1])
                if held > READ or len(paths) >= FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    read = files.select("path").repartition(tasks).mapInArrow(run, "path string, content binary")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string"))
    return read.select("path", (tx.strip_bom(text) if bom else text).alias("text"), F.when(~valid, "not UTF-8").alias("error"))


@dataclass
class Listing:
    """The files below a folder (path below it, size), and the folder's own path."""

    path: str
    files: DataFrame


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path).rstrip("/")
    store, root = pafs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's path with its file system, as Spark's readers write it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(folder)
    return store.makeQualified(at).toString()


def entries(spark: SparkSession, top: str, folders: DataFrame) -> DataFrame:
    """(path, size) of what lies in the folders (path below top), listed by tasks, one folder after the other; a folder has no size."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(top)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = store.get_file_info(pafs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
                for i in range(0, len(found), LISTED):
                    part = [x for x in found[i : i + LISTED] if x.type in (pafs.FileType.File, pafs.FileType.Directory)]
                    paths = [f"{folder}/{x.base_name}".lstrip("/") for x in part]
                    sizes = [x.size if x.type == pafs.FileType.File else None for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return folders.select("path").mapInArrow(run, "path string, size long")


def listing(spark: SparkSession, folder: str) -> Listing:
    """The .txt files below a folder, level by level; the driver holds no row of them."""
    top = qualified(spark, folder)
    name = F.substring_index("path", "/", -1)
    hidden = name.startswith(".") | (name.startswith("_") & ~name.contains("=")) | name.endswith("._COPYING_")
    files, folders, tasks = None, spark.createDataFrame([("",)], "path string").coalesce(1), 1
    while tasks:
        found = cut(entries(spark, top, folders).where(~hidden))
        own = found.where(F.col("size").isNotNull() & name.endswith(".txt"))
        files = own if files is None else files.union(own)
        folders = found.where("size is null")
        tasks = min(folders.count(), 4 * spark.sparkContext.defaultParallelism)
        folders = folders.repartition(max(1, tasks))
    return Listing(top, files)


def remove_tree(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that scratch named, the folders in it by tasks, so that the driver holds none of their lists."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            top = qualified(spark, folder)
            inside = entries(spark, top, spark.createDataFrame([("",)], "path string").coalesce(1)).where("size is null")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                store, root = store_of(top)
                for b in batches:
                    for path in b.column(0).to_pylist():
                        with suppress(FileNotFoundError):
                            store.delete_dir(f"{root}/{path}")
                    yield b.slice(0, 0)

            inside.select("path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string").count()
    finally:
        remove(spark, folder)


def size_of(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getFileStatus(at).getLen() if store.exists(at) else None


def relative_path(path: Column, folder: str) -> Column:
    """The part of a path below the folder."""
    return F.substring_index(path, folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)


def read_metadata(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """With infer the types are taken from the file, which reads it twice; without, columns that aren't wanted aren't parsed."""
    return spark.read.csv(path, header=True, inferSchema=True) if infer else spark.read.csv(path, header=True, schema=METADATA)


def write_metadata(df: DataFrame, path: str) -> None:
    df.select(*(c.split()[0] for c in METADATA.split(", "))).write.mode("overwrite").csv(path, header=True)


def load_corpus(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata with the text of its file (columns file_path, text); works without a file drop out."""
    return files.join(metadata, "file_path")


def load_named(metadata: DataFrame, folder: str, bom: bool = True) -> DataFrame:
    """The rows of metadata with text and error: each task opens the files below folder that its rows name in file_path.

    A file that is missing, is not UTF-8 or can't be read gives its row with the error and no text, as does a null path or one
    that leads out of the folder. Nothing is listed or joined, so only files that are named are read.
    """
    ship(metadata.sparkSession)
    names = metadata.columns
    own = metadata.toDF(*(f"_{i}" for i in range(len(names))))  # whatever the columns' names
    at = names.index("file_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for b in batches:
            for i, path in enumerate(b.column(at).to_pylist()):  # a row at a time, as a file may be large
                text, error = None, None
                try:
                    with store.open_input_stream(f"{root.rstrip('/')}/{inner(path)}") as f:
                        text = f.read().decode("utf-8-sig" if bom else "utf-8")
                except FileNotFoundError:
                    error = "missing"
                except UnicodeDecodeError:
                    error = "not UTF-8"
                except (ValueError, OSError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([text], pa.string()), pa.array([error], pa.string())], names=[*b.schema.names, "text", "error"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own.schema), "text string", "error string"])
    return own.mapInArrow(run, schema).toDF(*names, "text", "error")


def inner(path: str | None) -> str:
    """A path that stays below its folder."""
    parts = (path or "").split("/")
    if not path or path.startswith("/") or ".." in parts or parts[-1] in ("", "."):
        raise ValueError("no path below the folder")
    return path


def present(works: DataFrame, files: DataFrame) -> DataFrame:
    """Works whose file is there."""
    return works.join(files.select("file_path"), "file_path", "left_semi")


def missing(works: DataFrame, files: DataFrame) -> DataFrame:
    """Works whose file isn't there."""
    return works.join(files.select("file_path"), "file_path", "left_anti")


def metadata_of(works: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata with word counts of the works whose file is there."""
    counted = files.select("file_path", tx.word_count(F.col("text")).cast("int").alias("word_count"))
    return works.drop("word_count").join(counted, "file_path")


def write_table(df: DataFrame, path: str) -> None:
    """A table with a header, as one file where it is small: summaries have a row for each author."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_texts(texts: DataFrame, folder: str) -> None:
    """A file below folder for each row, at its file_path, with the bytes of its text and no more; an empty text gives a file of no bytes, a null one none.

    Each task writes the files of its rows, under names of their own that are changed when they are whole, so a task that
    runs again does no harm. Each path should occur once.
    """
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        made: set[str] = set()
        n = 0
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                name = f"{root.rstrip('/')}/{inner(path)}"
                above = name.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                own = f"{above}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as f:
                    f.write(text.encode())
                store.move(own, name)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    texts.select("file_path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def written_path(path: Column, folder: str) -> Column:
    """The file_path that write_texts was given, from the path of the file."""
    return relative_path(path, folder)


def write_labels(labels: DataFrame, path: str) -> None:
    """One JSON object with both directions, from (author, label)."""
    pairs = F.sort_array(F.collect_list(F.struct("author", F.col("label").cast("int").alias("label"))))
    to_id = F.map_from_entries(pairs)
    from_id = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["label"].cast("string").alias("k"), p["author"].alias("v"))))
    labels.agg(to_id.alias("author_to_id"), from_id.alias("id_to_author")).coalesce(1).write.mode("overwrite").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(author, label) from such a file, label as integer."""
    one = spark.read.schema(LABELS).json(path)
    return one.select(F.explode("id_to_author").alias("label", "author")).select("author", F.col("label").cast("int"))


def write_splits(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Only the folder of that split is read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus: doc_ord, author, title, year, text."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select(F.col("doc_id").alias("doc_ord"), F.col("lang").alias("author"), F.col("source").alias("title"), (F.lit(1700) + F.col("doc_id") % 115).cast("int").alias("year"), "text")
