"""The file table: `code_files(repo_id, path, size_bytes, content, content_sha, is_test)`."""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolake.fixed_values import EXCLUDED_DIRECTORIES, SOURCE_EXTENSIONS
from astrolake.functions.paths import (
    has_extension,
    in_excluded_directory,
    is_test_path,
    within_size,
)
from astrolake.session import settled

COLUMNS = ("repo_id", "path", "size_bytes", "content", "content_sha", "is_test")


def code_files(contents: DataFrame) -> DataFrame:
    """Complete `(repo_id, path, content BINARY)` rows to the file table."""
    return contents.select(
        "repo_id",
        "path",
        F.octet_length("content").cast("long").alias("size_bytes"),
        "content",
        F.sha2("content", 256).alias("content_sha"),
        is_test_path(F.col("path")).alias("is_test"),
    )


def scannable(
    files: DataFrame,
    extensions: Iterable[str] = SOURCE_EXTENSIONS,
    excludes: Iterable[str] = EXCLUDED_DIRECTORIES,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """Directory prune and extension filter, and a size cap where the caller asks for one.  All are
    column filters that stand before the content is read: the size cap reaches the Parquet scan.
    `skipped_by_size` lists what a cap leaves out."""
    wanted = has_extension(F.col("path"), extensions) & ~in_excluded_directory(
        F.col("path"), excludes)
    if max_file_bytes is not None:
        wanted = within_size(F.col("size_bytes"), max_file_bytes) & wanted
    return files.filter(wanted)


def skipped_by_size(
    files: DataFrame,
    max_file_bytes: int,
    extensions: Iterable[str] = SOURCE_EXTENSIONS,
    excludes: Iterable[str] = EXCLUDED_DIRECTORIES,
) -> DataFrame:
    """(repo_id, path, size_bytes, reason) of every file that only the given cap leaves out."""
    return scannable(files, extensions, excludes).filter(
        ~within_size(F.col("size_bytes"), max_file_bytes)
    ).select("repo_id", "path", "size_bytes",
             F.lit(f"larger than {max_file_bytes} bytes").alias("reason"))


def read_table(spark: SparkSession, path: str, **limits) -> DataFrame:
    """Scannable files of a stored file table (Parquet)."""
    return scannable(spark.read.parquet(path), **limits).select(*COLUMNS)


def _listing(spark: SparkSession, root: str, excludes: tuple[str, ...]) -> DataFrame:
    """Every file below `root` as (path, size_bytes).

    One job per directory level: each task lists its share of the level's directories, so no
    machine walks the whole tree.  Spark's own listing is not used because it hides names that
    start with `_` or `.`, such as `__init__.py`.
    """
    prune = in_excluded_directory(F.concat(F.col("path"), F.lit("/")), excludes)

    def entries_of(directory):
        try:
            with os.scandir(os.path.join(root, directory)) as entries:
                for entry in entries:
                    path = f"{directory}/{entry.name}" if directory else entry.name
                    if entry.is_dir(follow_symlinks=False):
                        yield path, True, 0
                        continue
                    try:
                        yield path, False, entry.stat().st_size
                    except OSError:
                        continue
        except OSError:
            return

    def scan(batches):
        for batch in batches:
            for directory in batch["path"]:
                found = entries_of(directory)
                while part := list(islice(found, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "is_dir", "size_bytes"])

    level = spark.createDataFrame([("",)], "path string")
    files = None
    while True:
        entries = settled(
            level.mapInPandas(scan, "path string, is_dir boolean, size_bytes long")
        )
        here = entries.filter(~F.col("is_dir")).select("path", "size_bytes")
        files = here if files is None else files.unionByName(here)
        level = entries.filter(F.col("is_dir") & ~prune).select("path")
        if level.isEmpty():
            return files
        level = level.repartition("path")


def read_folder(
    spark: SparkSession,
    root: str,
    repo_id: str,
    extensions: Iterable[str] = SOURCE_EXTENSIONS,
    excludes: Iterable[str] = EXCLUDED_DIRECTORIES,
    max_file_bytes: int | None = None,
) -> DataFrame:
    """File table of a folder all executors can see.  Unreadable files are skipped."""
    base = os.path.realpath(root)
    if not os.path.isdir(base):
        raise NotADirectoryError(f"Not a directory: {base}")
    listed = scannable(_listing(spark, base, tuple(excludes)), extensions, excludes,
                       max_file_bytes)

    def load(batches):
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                yield pd.DataFrame({"path": [path], "content": [content]})

    loaded = listed.select("path").repartition("path").mapInPandas(
        load, "path string, content binary"
    )
    return code_files(loaded.select(F.lit(repo_id).alias("repo_id"), "path", "content"))
