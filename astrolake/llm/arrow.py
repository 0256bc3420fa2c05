"""Columns computed by Python over Arrow batches, in slices of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Bytes of input a slice holds at most (one row always fits).  It bounds the working arrays.
SLICE_BYTES = 1 << 20
# Bytes Spark sends to a worker at once, where the session has not set it.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch, unless the session has done so.  Plans read the setting when they
    run, so it stays; it changes no result."""
    if not spark.conf._jconf.contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose `column` has about `limit` bytes."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        sizes = 4 * pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    else:
        sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > limit:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def with_computed(
    df: DataFrame,
    column: str,
    outputs: str,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """`df` with columns computed from the string or binary `column`.

    `outputs` is a DDL list of the new columns; an existing column of the same name is replaced.
    `make` runs once per task and gives the function from a slice of `column` to the new columns.
    All other columns pass through unchanged.
    """
    bound_batches(df.sparkSession)
    added = StructType.fromDDL(outputs)
    names = set(added.names)
    kept = [name for name in df.columns if name not in names]
    source = df.select(
        df[column].alias("_input"), *(df[name] for name in kept)
    )
    schema = StructType(list(source.schema.fields[1:]) + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        target = None
        for batch in batches:
            for part in slices(batch, 0, limit):
                arrays = part.columns[1:]
                if target is None:
                    fields = [part.schema.field(i + 1) for i in range(len(arrays))]
                    target = pa.schema(fields + list(to_arrow_schema(added)))
                new = compute(part.column(0))
                new = [a.cast(target.field(len(arrays) + i).type) for i, a in enumerate(new)]
                yield pa.RecordBatch.from_arrays(arrays + new, schema=target)

    return source.mapInArrow(run, schema)
