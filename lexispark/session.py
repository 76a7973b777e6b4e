"""Session settings, shared folders and checkpoints."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that the queries are planned for; a cluster may set its own number of shuffle partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "lexispark", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


#: Bytes for each core below which a table of few files is dealt to all cores.
SMALL_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, dealt to all cores. Any other is split as its files are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all work is on one machine, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="lexispark-"))
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch named."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def ship_texts(spark: SparkSession) -> None:
    """ship(), for functions of whole texts: their batches are bounded too. The limits stay set in the session, smaller ones are left as they are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexispark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    name = Path(tempfile.mkdtemp(prefix="lexispark-")) / "lexispark.zip"
    name.write_bytes(held.getvalue())
    sc.addPyFile(str(name))  # served by the driver; executors fetch it from there
    sc._lexispark_shipped = True
