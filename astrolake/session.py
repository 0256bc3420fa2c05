"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Runtime settings of a scan.  Parsing is bound by the processor, not by bytes: small partitions are
# worth a task.  Batches handed to Python are bounded by bytes, whatever the size of a file.
# Rule expressions are wide: the JVM never compiles a generated method above 8000 bytes of code, so
# such a stage must fall back to smaller methods instead of running interpreted.
SCAN_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # node rows go to the files of their families as they come, without a sort of the wide rows
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the scan settings the session has not chosen itself.  Plans read them when they run, so
    they stay; none of them changes a result or slows other work down."""
    for key, value in SCAN_SETTINGS.items():
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark.  A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("astrolake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder: on a cluster a folder of
    one machine would be lost, or unseen, by the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="astrolake-")
        context.setCheckpointDir(folder)
    return folder


_TABLES: dict[str, SparkSession] = {}


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Frames made and run in here lose their shuffle files when they have run, whose results are kept
    elsewhere.  Otherwise these stay until the driver happens to collect its garbage: those of all
    steps of a scan lie on disk at once."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def write_files(df: DataFrame, path: str, partition_by: str | None = None, **options) -> None:
    """Write `df` as Parquet files, and free what was shuffled for them."""
    with shuffles_freed(df.sparkSession):
        writer = df.select("*").write.options(**options)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_table(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write `df` to a new table in the shared folder; gives its path.  With `partition_by`, a folder
    for each value of that column.  Whoever asks for a table
    drops it, or leaves it to `release`, which runs at the end of the program."""
    folder = work_folder(df.sparkSession).rstrip("/")
    path = f"{folder}/astrolake/{name}-{uuid.uuid4().hex}"
    write_files(df, path, partition_by, compression="zstd")
    _TABLES[path] = df.sparkSession
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table made by `write_table`."""
    if "/astrolake/" not in path:
        raise ValueError(f"not a table of this package: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _TABLES.pop(path, None)


def release() -> None:
    """Drop every table of `write_table` that is still there.  Results that read them end here."""
    for path, spark in list(_TABLES.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            drop_table(spark, path)


atexit.register(release)


def spread(df: DataFrame) -> DataFrame:
    """`df` for a join whose sides both grow with the tables: both are shuffled, neither is broadcast.

    The optimizer's sizes are no guide here.  It carries the bytes of a few stored columns through the
    parse job, its aggregations and the texts, and takes millions of rows for a few megabytes.
    """
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """`df` computed now and kept in the shared folder.

    Used where several operators read one expensive result.  The rows outlive lost executors and cut
    the lineage.  Spark owns the files: with `spark.cleaner.referenceTracking.cleanCheckpoints` it
    removes them once nothing refers to them.
    """
    work_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint()
