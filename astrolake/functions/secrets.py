"""Credentials written into prose: the literal-assignment idea applied to free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolake.functions.predicates import is_sensitive_name

# A name, an equals sign and a literal in double or single quotes that is not empty.
QUOTED_ASSIGNMENT = r"""([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*(?:"([^"\n]+)"|'([^'\n]+)')"""


def secret_literals(documents: DataFrame, key: str, text: str, min_length: int = 1) -> DataFrame:
    """(key, occurrence, var, literal) for each sensitive-looking assignment in the whole text."""
    pattern = F.lit(QUOTED_ASSIGNMENT)
    # One of the two literal groups is empty in every match.
    literals = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(2)),
        F.regexp_extract_all(text, pattern, F.lit(3)), lambda a, b: F.concat(a, b),
    )
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("var"), literals.alias("literal"),
    )
    return (
        documents.filter(F.col(text).contains("="))
        .select(key, F.posexplode(pairs).alias("occurrence", "hit"))
        .select(key, "occurrence", "hit.var", "hit.literal")
        .filter(is_sensitive_name(F.col("var")) & (F.length("literal") >= min_length))
    )
