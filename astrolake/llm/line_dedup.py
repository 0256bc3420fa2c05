"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

A line descends the tree by its number of tokens and then by its leading tokens; the leaf holds the
lines that agree in both.  In a leaf, templates generalise a line:

* the line as a whole, with the tokens that hold a digit open (`<*>`), if at least half of its tokens
  and at least `MIN_FIELDS_FIXED` are fixed; else the line as it stands, so that rows of numbers,
  dates and amounts only recur if they are equal;
* three more, each with one window of the tokens behind the leading ones open as well.  A window is
  a third of those tokens, at most three tenths of the line, and a template counts only if at least
  two thirds of the tokens, and at least `MIN_FIXED`, are fixed even if the window held no number.

Two lines of one leaf whose differences lie within one window so share a template, and a line with
a unique half shares none.  A template that occurs in enough documents recurs; its first line stays,
its other lines are dropped.  A line of `LONG` tokens or more is a passage: as a whole it recurs in
two documents already.

Templates are compared by a 32-bit hash of the leaf and a 63-bit one, so a line costs a few numbers in
the shuffles and its text none.  The upper half of the first is taken: its zero bytes lie beside others
in the rows, which compression leaves out.  Documents per template are counted with partial aggregation, so a line that stands in a
third of all documents is folded before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolake.session import settled

DEPTH = 3
MIN_DOCS = 3
MIN_FIXED = 8
MIN_FIELDS_FIXED = 4
LONG = 50
LONG_DOCS = 2
LEAF_BITS = -1 << 32  # the upper half


def _fields_open(bare: Column) -> Column:
    """A trimmed line, its tokens with a digit open."""
    return F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, "[^ ]*[0-9][^ ]*", "<*>")) \
        .otherwise(bare)


def templates(lines: DataFrame, depth: int = DEPTH, min_fixed: int = MIN_FIXED) -> DataFrame:
    """Rows of `lines` with `leaf` and `template` of each template of `_line`; a blank line has none.
    The lowest bit of `template` is 1 for a long line as a whole.

    Each step is a column of its own, kept apart by a generator: the optimizer would otherwise put
    the split into every place that uses it.
    """
    kept = [name for name in lines.columns if name != "_line"]
    line = F.col("_line")
    plain = F.when(line.contains("\t") | line.contains("\r"), F.translate(line, "\t\r", "  ")) \
        .otherwise(line)
    bare = lines.select(*kept, F.trim(plain).alias("_bare")).where(F.col("_bare") != "")
    opened = bare.select(
        *kept, "_bare", F.explode(F.array(_fields_open(F.col("_bare")))).alias("_open"))
    split = opened.select(
        *kept, "_bare", "_open", F.explode(F.array(F.split("_open", " "))).alias("_tokens"))
    size = F.size("_tokens")
    marks = (F.length("_open") - F.length(F.replace("_open", F.lit("<*>"), F.lit("")))) / 3
    rest = F.greatest(size - depth, F.lit(0))
    sized = split.select(
        *kept, "_bare", "_open", "_tokens", size.alias("_size"), rest.alias("_rest"),
        (size - marks.cast("int")).alias("_fixed"),
        F.least(F.ceil(rest / 3), F.floor(size * 3 / 10)).cast("int").alias("_wide"),
    )
    n, fixed, wide = F.col("_size"), F.col("_fixed"), F.col("_wide")
    whole = F.when((2 * fixed >= n) & (fixed >= MIN_FIELDS_FIXED), F.col("_open")) \
        .otherwise(F.col("_bare"))

    def window(number: int, start: Column) -> Column:
        behind = depth + start + wide
        return F.xxhash64(F.lit(number), F.slice("_tokens", F.lit(1), depth + start),
                          F.slice("_tokens", behind + 1, n - behind))

    spare = F.col("_rest") - wide
    starts = [F.lit(0), F.floor(spare / 2).cast("int"), spare]
    counts = (wide > 0) & (3 * (fixed - wide) >= 2 * n) & (fixed - wide >= min_fixed)
    whole_hash = F.xxhash64(F.lit(0), whole).bitwiseAND(-2).bitwiseOR((n >= LONG).cast("long"))
    hashes = F.when(counts, F.array(whole_hash, *(
        window(number, start).bitwiseAND(-2) for number, start in enumerate(starts, start=1)
    ))).otherwise(F.array(whole_hash))
    return sized.select(
        *kept, F.xxhash64(n, F.slice("_tokens", 1, depth)).bitwiseAND(LEAF_BITS).alias("leaf"),
        F.explode(hashes).alias("template"),
    )


def drop_recurring_lines(df: DataFrame, id_column: str, text_column: str, depth: int = DEPTH,
                         min_docs: int = MIN_DOCS, min_fixed: int = MIN_FIXED) -> DataFrame:
    """`df` with the recurring lines taken out of its text column.

    Lines are what stands between \\n; tokens are what stands between spaces (tabs and \\r count as
    spaces).  A template recurs if it occurs in at least `min_docs` documents, a line of `LONG` tokens
    or more as a whole in `LONG_DOCS`.  Its first line, by id (null last), then position, stays.  A line is dropped if it is not the first of some
    recurring template it has.  Blank lines stay, null texts stay null, a text that loses all lines
    becomes empty.  Rows equal in id and text are one document and are treated alike.
    """
    names = df.columns
    keyed = df.withColumn("_doc", F.xxhash64(F.col(id_column), F.col(text_column)))
    lines = keyed.select(
        F.col(id_column).alias("_id"), "_doc",
        F.posexplode(F.split(text_column, "\n")).alias("_at", "_line"),
    )
    found = templates(lines, depth, min_fixed)
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "_doc", "_at")
    passage = F.col("template").bitwiseAND(1) == 1
    per_document = found.groupBy("leaf", "template", "_id", "_doc").agg(F.min("_at").alias("_at"))
    recurring = settled(
        per_document.groupBy("leaf", "template")
        .agg(F.count("*").alias("docs"), F.min(place).alias("first"))
        .where((F.col("docs") >= min_docs) | passage & (F.col("docs") >= LONG_DOCS))
        .select("leaf", "template", "first")
    )
    dropped = found.join(recurring, ["leaf", "template"]).where(place != F.col("first"))
    # A document's dropped positions are at most its lines.
    by_document = dropped.groupBy("_id", "_doc").agg(F.collect_set("_at").alias("_dropped"))
    by_document = by_document.select(
        F.col("_id").alias("_lost_id"), F.col("_doc").alias("_lost_doc"), "_dropped"
    )
    joined = keyed.join(
        by_document,
        F.col(id_column).eqNullSafe(F.col("_lost_id")) & (F.col("_doc") == F.col("_lost_doc")),
        "left",
    )
    parts = F.split(text_column, "\n")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_dropped"))
    text = F.when(F.col("_dropped").isNull(), F.col(text_column)).otherwise(
        F.array_join(F.transform(left, lambda at: F.element_at(parts, at + 1)), "\n")
    )
    return joined.select(*(
        text.alias(name) if name == text_column else F.col(name) for name in names
    ))
