"""Exact deduplication as a stateful stream over the files of a table.

arrive() follows the source with Structured Streaming and notes for each row its id, the SHA-256 of its text and its
content locator (file and row in it). remember() follows these notes with a streaming aggregation whose state is keyed
by the first KEY_BYTES bytes of the digest, lies in RocksDB on the executors' disks with its log in the shared folder,
and never expires: of each digest it retains the row that stays (largest id, with its locator) and the number of rows.
Both streams take what is new and stop, and go on after what they have read when they are called again; so does a
stream that was broken off. The state holds no texts, and only digests are shuffled, pre-aggregated in each task.

verify() checks hits: where a digest has several rows, the files named by their locators are read again and texts
are grouped by digest and all their bytes, so that copies are collapsed in each task before the shuffle. A
digest with two different texts is noted as collided; its rows are then grouped by their bytes instead. Groups
are checked again only when they have grown.

Defined cases: a null text is an empty one, equal to other empty texts; of equal ids, and among null ids, the row whose locator is
largest stays, and a null id stays only if the group has no other; texts of any length are compared whole; an empty table gives no rows;
repeated rows are one group, of which one row stays; other columns of the source are not read, whatever their names. The source is a
Parquet table, a file or a folder; files are read once, so a file that is changed later is not seen again.
"""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexispark.llm import common
from lexispark.session import remove, scratch

#: Bytes of the digest that key the state; bytes of input in one micro-batch.
KEY_BYTES, TRIGGER_BYTES = 16, 1 << 40
#: Settings of the state store: memory is bounded for each executor, and no disk is set aside ahead for each partition's store.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
EMPTY = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def key(sha: Column, key_bytes: int) -> Column:
    return F.unhex(F.substring(sha, 1, 2 * key_bytes))


def source_schema(spark: SparkSession, path: str) -> str:
    """doc_id and text as the table has them."""
    kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    return f"doc_id {kinds['doc_id']}, text {kinds['text']}"


def finished(writer: DataStreamWriter) -> None:
    """Runs a stream over what there is."""
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def arrive(spark: SparkSession, path: str, folder: str, trigger_bytes: int = TRIGGER_BYTES) -> None:
    """Notes (doc_id, sha, path, row) of the rows of new files of the table at path in folder/seen."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = spark.readStream.schema(source_schema(spark, path)).option("maxBytesPerTrigger", str(trigger_bytes))
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):  # a stream follows folders
        files = files.option("pathGlobFilter", at.getName())
        path = str(at.getParent())
    rows = files.parquet(path).select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text(), 256).alias("sha"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    finished(rows.writeStream.format("parquet").option("path", f"{folder}/seen").option("checkpointLocation", f"{folder}/arrived"))


def seen(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, sha string, path string, row long").parquet(f"{folder}/seen")


def remember(spark: SparkSession, folder: str, key_bytes: int = KEY_BYTES, trigger_bytes: int = TRIGGER_BYTES) -> None:
    """Takes new notes into the state."""
    notes = spark.readStream.schema(seen(spark, folder).schema).option("maxBytesPerTrigger", str(trigger_bytes)).parquet(f"{folder}/seen")
    groups = notes.groupBy(key(F.col("sha"), key_bytes).alias("key")).agg(F.max(F.struct("doc_id", "path", "row")).alias("kept"), F.count(F.lit(1)).alias("n"))
    with settings(spark, STORE):
        finished(groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state"))


def state(spark: SparkSession, folder: str) -> DataFrame:
    """What the state retains: key, kept (doc_id, path, row), n."""
    held = spark.read.format("statestore").load(f"{folder}/state")
    names = {c: held.schema[c].dataType.names for c in ("key", "value")}
    kept, n = names["value"]
    return held.select(F.col("key")[names["key"][0]].alias("key"), F.col("value")[kept].alias("kept"), F.col("value")[n].alias("n"))


def contents(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(sha, text) with locator of the rows that are named by (path, row), read from their files; some others may come along.

    The files' names come to the driver, as those of any scan do.
    """
    paths = [unquote(r[0]) for r in rows.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "doc_id long, sha string, text string, path string, row long")
    read = spark.read.schema(source_schema(spark, paths[0])).parquet(*paths)
    read = read.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text(), 256).alias("sha"), text().alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    return common.filtered(read, rows, ["path", "row"], "_named", rows.count()).where("_named").drop("_named")


def verify(spark: SparkSession, folder: str, key_bytes: int = KEY_BYTES) -> None:
    """Compares all bytes of the texts of groups that have grown to two and more; notes what is checked, and collided keys."""
    several = state(spark, folder).where("n > 1").select("key", "n")
    noted = f"{folder}/checked"
    if exists(spark, noted):
        several = several.join(spark.read.schema("key binary, n long, texts long").parquet(noted), ["key", "n"], "left_anti")
    several = common.cut(several)
    if several.isEmpty():
        return
    own = seen(spark, folder).withColumn("key", key(F.col("sha"), key_bytes))
    hits = common.cut(common.filtered(own, several, ["key"], "_hit", several.count()).where("_hit").select("path", "row"))
    # The filter may let other rows through: they are groups of their own here, and the join drops them.
    texts = contents(spark, hits).groupBy(key(F.col("sha"), key_bytes).alias("key"), "text").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    several.join(texts, "key").select("key", "n", "texts").write.mode("append").parquet(noted)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def collided(spark: SparkSession, folder: str) -> DataFrame | None:
    """Keys of different texts, if there are any."""
    if not exists(spark, f"{folder}/checked"):
        return None
    keys = common.cut(spark.read.parquet(f"{folder}/checked").where("texts > 1").select("key").distinct())
    return None if keys.isEmpty() else keys


def result(spark: SparkSession, folder: str, key_bytes: int = KEY_BYTES) -> DataFrame:
    """A row for each one noted: doc_id, keep_id, group_size, kept, text_sha256, path, row."""
    rows = seen(spark, folder).withColumn("key", key(F.col("sha"), key_bytes))
    groups = state(spark, folder)
    apart = collided(spark, folder)
    out = rows.join(groups if apart is None else groups.join(apart, "key", "left_anti"), "key").select("doc_id", "sha", "path", "row", "kept", "n")
    if apart is not None:
        texts = contents(spark, rows.join(apart, "key", "left_semi")).withColumn("key", key(F.col("sha"), key_bytes)).join(apart, "key", "left_semi")
        own = texts.groupBy("key", "text").agg(F.max(F.struct("doc_id", "path", "row")).alias("kept"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(texts.join(own, ["key", "text"]).select(*out.columns))
    stays = (F.col("kept.path") == F.col("path")) & (F.col("kept.row") == F.col("row"))
    return out.select("doc_id", F.col("kept.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"), "path", "row")


def ingest(spark: SparkSession, path: str, folder: str, key_bytes: int = KEY_BYTES, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """Takes the new files of the table at path into the state below folder and returns the rows of all files so far."""
    arrive(spark, path, folder, trigger_bytes)
    remember(spark, folder, key_bytes, trigger_bytes)
    verify(spark, folder, key_bytes)
    return result(spark, folder, key_bytes)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of all rows of the table; the state is deleted when they are written."""
    folder = scratch(spark, "exact")
    try:
        return common.cut(ingest(spark, path, folder).drop("path", "row"))
    finally:
        remove(spark, folder)
