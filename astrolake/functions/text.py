"""Column functions on messages and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from astrolake.fixed_values import PREVIEW_CHARS


def filled(template: Column, **values: Column) -> Column:
    """Put values into the `{name}` places of a message template."""
    for name, value in values.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        template = F.replace(template, F.lit(f"{{{name}}}"), text)
    return template


def preview(message: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.when(
        F.length(message) > chars, F.concat(F.substring(message, 1, chars), F.lit("..."))
    ).otherwise(message)


def html_escaped(text: Column) -> Column:
    """Scanned text is not trusted: escape the five characters that mean something in HTML."""
    for plain, escaped in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;"),
    ):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text
