"""Column predicates on paths and source labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from astrolake.fixed_values import (
    EXCLUDED_DIRECTORIES,
    EXCLUDED_DIRECTORY_SUFFIX,
    REPOSITORY_URL_PATTERN,
    SOURCE_EXTENSIONS,
)


def in_excluded_directory(path: Column, excludes: Iterable[str] = EXCLUDED_DIRECTORIES) -> Column:
    """A directory on the way to the file (not the file name itself) is excluded."""
    parts = F.split(path, "/")
    directories = F.slice(parts, 1, F.size(parts) - 1)
    names = list(excludes)
    return F.exists(
        directories, lambda d: d.isin(names) | d.endswith(EXCLUDED_DIRECTORY_SUFFIX)
    )


def extension(path: Column) -> Column:
    """Suffix of the file name with its dot; a name such as `.py` has none."""
    return F.regexp_extract(path, r"[^/](\.[^/.]+)$", 1)


def has_extension(path: Column, extensions: Iterable[str] = SOURCE_EXTENSIONS) -> Column:
    wanted = [e if e.startswith(".") else f".{e}" for e in extensions]
    return extension(path).isin(wanted)


def within_size(size_bytes: Column, limit: int) -> Column:
    return size_bytes <= F.lit(limit)


def is_test_path(path: Column) -> Column:
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(unix, "/"), -1)
    return (
        F.concat(F.lit("/"), unix).contains("/tests/")
        | name.startswith("test_")
        | name.endswith("_test.py")
    )


def is_repository_url(label: Column) -> Column:
    """Letters and digits of any script count, as do all whitespace characters around the label.
    The final `$` also accepts one line break, which trimming has removed."""
    # The word class of Java differs: it takes combining marks and leaves out superscripts.
    pattern = REPOSITORY_URL_PATTERN.replace(r"\w", r"\p{L}\p{N}_")
    return stripped(label).rlike(pattern)


def stripped(text: Column) -> Column:
    """Trim every Unicode whitespace character at both ends."""
    space = r"[\s\x1c-\x1f]"
    return F.regexp_replace(F.regexp_replace(text, f"(?U)^{space}+", ""), f"(?U){space}+$", "")
