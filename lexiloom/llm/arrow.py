"""Arrow helpers: run a function over bounded slices of rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text in a slice; bounds the temporaries of one call whatever the batch size is.
SLICE_CHARS = 2_000_000


#: Rows in a batch that goes to a worker, at most: rows can be long, and a batch is held several times over.
BATCH_ROWS = 2_000


def give_back() -> None:
    """Frees what a task held: workers live on, and the next stage needs the memory."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str | None, chars: int = SLICE_CHARS) -> Iterator[dict[str, list]]:
    """Columns of consecutive rows with about ``chars`` characters of ``text``, a row at least."""
    n = batch.num_rows
    if text is None:
        yield batch.to_pydict()
        return
    texts = batch.column(batch.schema.get_field_index(text))
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, k in enumerate(lengths):
        if i > start and size + k > chars:
            yield batch.slice(start, i - start).to_pydict()
            start, size = i, 0
        size += k
    if n > start:
        yield batch.slice(start, n - start).to_pydict()


def map_slices(
    df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[dict], dict]], text: str | None = "text", chars: int = SLICE_CHARS
) -> DataFrame:
    """``mapInArrow`` with ``make()`` called once a task; its result takes and gives columns as lists or arrays.

    Spark reads the rows of a batch from the session when the result is computed, so the session's
    setting is lowered to ``BATCH_ROWS`` where it is higher; it is not raised again.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(schema, prefers_large_types=False)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for cols in slices(batch, text, chars):
                got = fn(cols)
                if got is not None and len(got[out.names[0]]):
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)
                got = cols = None
        fn = None
        give_back()

    return df.mapInArrow(run, schema)
