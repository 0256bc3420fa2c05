"""A scan of a file table, start to end."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.functions.predicates import of_kind
from astrolake.operators import findings, quality, report
from astrolake.operators.nodes import (
    STATUS,
    Needs,
    parse_status,
    rows_of,
    syntax_nodes,
    with_family,
)
from astrolake.operators.triggers import may_fire, may_note
from astrolake.session import drop_table, settled, spread, tuned, write_table
from astrolake.sources.node_store import NodeStore


def _short(name: Column) -> Column:
    """The bytes that 64 hexadecimal digits stand for; of any other name its characters and 33 zeros,
    which no hash is as long as."""
    other = F.concat(F.encode(name, "UTF-8"), F.lit(bytearray(33)))
    return F.when(name.rlike("\\A[0-9a-f]{64}\\z"), F.unhex(name)).otherwise(other)


def _long(key: Column) -> Column:
    """The name that `_short` was given."""
    other = F.decode(F.substring(key, F.lit(1), F.octet_length(key) - 33), "UTF-8")
    return F.when(F.octet_length(key) == 32, F.lower(F.hex(key))).otherwise(other)


class Scan:
    """Parse once, read often.

    `rule` and `check` alone are lazy and read the parse job directly (the taint trace computes its
    hits at once).  Anything that needs more
    than one pass over the nodes goes through `nodes`, which is written once to the shared folder
    with only the rows and columns in use.  Used as a context manager, the scan removes that table
    at the end; results must have been written by then.
    """

    def __init__(self, files: DataFrame, needs: Needs | None = None,
                 parsed_if: Column | None = None, store: str | None = None):
        self.spark = tuned(files.sparkSession)
        self.files = files
        self.needs = needs
        self.parsed_if = parsed_if
        self.store = store
        self._tables: list[str] = []

    def __enter__(self) -> Scan:
        return self

    def __exit__(self, *_) -> None:
        while self._tables:
            drop_table(self.spark, self._tables.pop())

    def _drop(self, name: str) -> None:
        for table in [t for t in self._tables if f"/astrolake/{name}-" in t]:
            self._tables.remove(table)
            drop_table(self.spark, table)

    def _kept(self, rows: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self._tables.append(write_table(rows, name, partition_by))
        return self.spark.read.schema(rows.schema).parquet(self._tables[-1])

    def _written(self, nodes: DataFrame) -> DataFrame:
        """`nodes` stored by family: a reader takes only the folders of the kinds it wants."""
        return self._kept(with_family(nodes), "nodes", "family")

    @classmethod
    def security(cls, files: DataFrame) -> Scan:
        """Scan for security findings only: files no rule can fire on are not parsed."""
        return cls(files, findings.rule_needs(), may_fire(findings.all_rules()))

    @classmethod
    def quality(cls, files: DataFrame) -> Scan:
        return cls(files, quality.QUALITY_NEEDS)

    @classmethod
    def full(cls, files: DataFrame, store: str | None = None) -> Scan:
        """Security, quality and parse status.  With the folder of a `store`, contents that an
        earlier scan has parsed are taken from there, and new ones are added to it."""
        needs = findings.rule_needs() | quality.QUALITY_NEEDS | STATUS
        return cls(files, needs._replace(uses=findings.uses()), store=store)

    @cached_property
    def _hashed(self) -> DataFrame:
        """The files without their texts, by the hash of their content.  A scan that parses every file
        writes them once, so that the texts are read or made once more only."""
        slim = self.files.select("repo_id", "path", "is_test", "content_sha")
        if self.parsed_if is not None:
            return slim
        return self._kept(self._shortened(slim), "files")

    def _shortened(self, files: DataFrame) -> DataFrame:
        return files.withColumn("content_sha", _short(F.col("content_sha"))) if self._numbered else files

    @property
    def _numbered(self) -> bool:
        """Whether the tables of this scan name a content by a number.  The hash of 64 characters would
        be most of what is stored and shuffled."""
        return self.parsed_if is None and self.store is None and self.needs is not None \
            and {*STATUS.kinds} <= {*self.needs.kinds}

    @cached_property
    def listing(self) -> DataFrame:
        """The files without their texts, by the `content_sha` that `nodes` has."""
        if not self._numbered:
            return self._hashed
        numbers = rows_of(self.nodes, *STATUS.kinds).where(of_kind(*STATUS.kinds)).select(
            F.col("hash").alias("_hash"), F.col("content_sha").alias("_number"))
        listed = self._hashed.join(
            spread(numbers), F.col("content_sha") == F.col("_hash"), "left"
        ).select("repo_id", "path", "is_test", F.col("_number").alias("content_sha"))
        kept = self._kept(listed, "listing")
        self._drop("files")
        return kept

    @cached_property
    def nodes(self) -> DataFrame:
        """The node table.  Where it is `_numbered`, its `content_sha` is a number that only `listing`
        knows."""
        if self.store is not None:
            held = NodeStore(self.spark, self.store, self.needs)
            held.add(self.files, self._hashed)
            return held.nodes(self._hashed)
        listed = self._hashed if self.parsed_if is None else None
        files = self._to_parse(self.parsed_if)
        return self._written(
            syntax_nodes(self._shortened(files), self.needs, listed, numbered=self._numbered))

    def _to_parse(self, condition: Column | None) -> DataFrame:
        return self.files if condition is None else self.files.filter(condition)

    def rule(self, rule_id: str, snippets: bool = False) -> DataFrame:
        """Findings of one rule, straight from the parse job unless they need the nodes twice."""
        files = self._to_parse(may_fire((rule_id,)))
        nodes = syntax_nodes(files, findings.rule_needs((rule_id,), snippets))
        if snippets:
            nodes = self._written(nodes)
        return findings.security_findings(self.files, nodes, (rule_id,), snippets)

    def check(self, check: str, threshold: int | None = None) -> DataFrame:
        """Findings of one quality check, straight from the parse job.  `threshold` replaces that of
        `complexity` or `nesting_depth`."""
        needs, build = quality.QUALITY_BUILDERS[check]
        if threshold is not None and check not in quality.THRESHOLDS:
            raise ValueError(f"{check} has no threshold")
        limit = quality.THRESHOLDS.get(check, 0) if threshold is None else threshold
        nodes = syntax_nodes(self._to_parse(may_note(check, limit)), needs)
        if threshold is not None:
            return findings.quality_findings(self.files, build(nodes, threshold))
        return findings.quality_findings(self.files, build(nodes))

    def security_findings(self, snippets: bool = True) -> DataFrame:
        return findings.security_findings(self.listing, self.nodes, snippets=snippets)

    def quality_findings(self, **thresholds: int) -> DataFrame:
        """`complexity_threshold` and `nesting_threshold` replace the fixed ones."""
        return findings.all_quality_findings(self.listing, self.nodes, **thresholds)

    def security_counts(self) -> DataFrame:
        return findings.security_counts(self.listing, self.nodes)

    def quality_counts(self) -> DataFrame:
        hits = quality.quality_content_findings(self.nodes)
        return findings.quality_counts(self.listing, hits)

    def status(self) -> DataFrame:
        """One row per distinct content, by its hash."""
        if not self._numbered:
            return parse_status(self.nodes)
        return parse_status(self.nodes, "hash").withColumn("content_sha", _long(F.col("content_sha")))

    def numbered_status(self) -> DataFrame:
        """One row per distinct content, by the `content_sha` of `listing`."""
        return parse_status(self.nodes)

    def dashboard(self) -> DataFrame:
        """The counts are computed and kept one after the other, so that the rows shuffled for them do
        not lie on disk together."""
        counts = [settled(counted) for counted in (
            report.parse_summary(self.listing, self.numbered_status()),
            self.security_counts(), self.quality_counts())]
        return report.dashboard_of(*counts)
