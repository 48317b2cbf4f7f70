"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship
from ..sources.shared import Rounds, shared_folder, stored

__all__ = ["Rounds", "bounded_batches", "map_rows", "shared_folder", "stored", "text_of"]

#: Rows in one Arrow batch.  With long texts this bounds what a Python worker
#: holds at once; Spark's default of 10,000 rows is too much for that.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the session's Arrow batches at ``rows`` rows or fewer, and let its
    workers import this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str,
    start: Callable[[], Callable[..., list[tuple]]],
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """Map batches of rows in Python, one output row for each input row.

    ``start`` runs once in a task and returns a function from the column lists
    of a batch to the list of output rows.
    """
    bounded_batches(df.sparkSession, rows)
    made = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(*columns).mapInArrow(_mapper(made, start), schema)


def _mapper(out: pa.Schema, start):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if not batch.num_rows:
                continue
            step = step or start()
            made = step(*(c.to_pylist() for c in batch.columns))
            columns = list(zip(*made)) if made else [[] for _ in out]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, out)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return run


def text_of(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
