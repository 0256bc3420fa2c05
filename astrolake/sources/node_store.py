"""Parse results kept between scans: a content that has been parsed once is not parsed again.

    <path>/<grammar>/nodes/batch=<id>/family=<name>/   node rows of the contents of a batch
    <path>/<grammar>/contents/batch=<id>/              (content_sha), written last

A batch counts once its contents are written, so a run that fails leaves rows nobody reads and its
files are parsed again by the next one.  Where two runs have parsed a content at the same time, the
batch with the smaller id holds it.  The grammar names the Python version of the workers (that of
the driver, as Spark demands) and the rows and columns kept: after a change of either, contents are
parsed anew.
"""

from __future__ import annotations

import hashlib
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from astrolake.operators.nodes import (
    NODE_SCHEMA,
    RUN_STATEMENTS,
    Needs,
    content_owners,
    syntax_nodes,
    with_family,
)
from astrolake.session import settled, spread, write_files


def grammar_of(needs: Needs) -> str:
    uses = needs.uses and [sorted(names) for names in needs.uses]
    kept = repr((sorted(needs.kinds), sorted(needs.columns), NODE_SCHEMA, RUN_STATEMENTS, uses))
    version = ".".join(map(str, sys.version_info[:2]))
    return f"python{version}-{hashlib.sha256(kept.encode()).hexdigest()[:12]}"


class NodeStore:
    """Node rows of every content seen so far, as far as `needs` names them."""

    def __init__(self, spark: SparkSession, path: str, needs: Needs):
        self.spark = spark
        self.needs = needs
        self.base = f"{path.rstrip('/')}/{grammar_of(needs)}"
        kept = [f for f in StructType.fromDDL(NODE_SCHEMA) if f.name in needs.columns]
        self._schema = StructType(kept).add("family", "string")

    def _batches(self) -> list[str]:
        """Ids of the finished batches: one name per run, whatever the run has parsed."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/contents/*/_SUCCESS")
        system = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(
            found.getPath().getParent().getName().removeprefix("batch=")
            for found in system.globStatus(pattern) or ())

    def _read(self, table: str, schema: StructType | str) -> DataFrame:
        """Rows of the finished batches, with their `batch`."""
        columns = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        columns = StructType(list(columns)).add("batch", "string")
        paths = [f"{self.base}/{table}/batch={batch}" for batch in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).option(
            "basePath", f"{self.base}/{table}").parquet(*paths)

    def contents(self) -> DataFrame:
        """(content_sha, batch): where each content is held."""
        return self._read("contents", "content_sha string").groupBy("content_sha").agg(
            F.min("batch").alias("batch"))

    def add(self, files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
        """Parse the contents of `files` the store does not hold.  Gives their hashes.  Which these
        are is found without the texts, in the `listing` of the files if there is one."""
        listing = files if listing is None else listing
        fresh, some = content_owners(listing), listing
        if self._batches():
            # folded before they meet; kept, since whether there are any is asked before the parse
            known = self._read("contents", "content_sha string").select("content_sha")
            fresh = some = settled(fresh.join(known, "content_sha", "left_anti"))
        if some.select("content_sha").isEmpty():  # no batch without contents
            return fresh.select("content_sha")
        batch = uuid.uuid4().hex
        nodes = f"{self.base}/nodes/batch={batch}"
        rows = with_family(syntax_nodes(files, self.needs, fresh))
        write_files(rows, nodes, "family", compression="zstd")
        # Every parsed content has a status row, so the rows themselves say what has been parsed.
        done = self.spark.read.schema(self._schema).parquet(nodes)
        done = done.filter("family = 'status'").select("content_sha")
        write_files(done, f"{self.base}/contents/batch={batch}")
        return self.spark.read.schema("content_sha string").parquet(
            f"{self.base}/contents/batch={batch}")

    def nodes(self, files: DataFrame) -> DataFrame:
        """Node table for `files`, which the store must hold (`add`).

        It may hold more than the contents of `files`, since findings meet their files by content.
        Only where these are under half of the store are the others left out: reading few of many
        contents is worth a semi-join, reading most of them is not.
        """
        stored = self._read("nodes", self._schema)
        listed = self._read("contents", "content_sha string")
        twice = listed.groupBy("content_sha").agg(
            F.min("batch").alias("batch"), F.count("*").alias("n")).filter("n > 1")
        if len(self._batches()) > 1 and not twice.isEmpty():
            late = listed.join(twice.withColumnRenamed("batch", "_held"), "content_sha").filter(
                "batch <> _held").select("content_sha", "batch")
            stored = stored.join(late, ["content_sha", "batch"], "left_anti")
        # An estimate will do: nothing but the amount of reading depends on it.
        wanted = files.agg(F.approx_count_distinct("content_sha")).first()[0]
        if wanted * 2 < listed.count():
            stored = stored.join(
                spread(files.select("content_sha").distinct()), "content_sha", "left_semi")
        return stored.drop("batch")
