"""Incremental scan: files that arrive in a drop folder are scanned batch by batch.

Rules look at one file at a time, so a batch needs no state from earlier ones.  A node store spares
the parsing of contents that an earlier batch, or an earlier scan, has met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from astrolake.operators.scan import Scan
from astrolake.session import settled
from astrolake.sources.code_files import code_files, scannable


def incoming_files(spark: SparkSession, folder: str, tables_per_batch: int = 1000) -> DataFrame:
    """Stream of Parquet files with (repo_id, path, content).  A batch takes at most
    `tables_per_batch` of them; the rest waits for the next one."""
    rows = spark.readStream.schema("repo_id string, path string, content binary").option(
        "maxFilesPerTrigger", tables_per_batch).parquet(folder)
    return scannable(code_files(rows))


def scan_stream(files: DataFrame, out: str, checkpoint: str,
                store: str | None = None) -> StreamingQuery:
    """Append the findings of each batch below `out`; stops when all waiting files are done.

    Each batch writes its own partition and replaces it, so a batch that is run again after a
    failure leaves no duplicates.  With the folder of a `store`, copies of a content in later batches
    are not parsed again.
    """
    base = out.rstrip("/")

    def scan(batch: DataFrame, batch_id: int) -> None:
        # The batch is read by the parse job and by several joins: keep its files.
        with Scan.full(settled(batch), store) as run:
            for name, findings in (
                ("security_findings", run.security_findings()),
                ("quality_findings", run.quality_findings()),
            ):
                findings.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")

    return (
        files.writeStream.foreachBatch(scan)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
