"""DuckDB inside the tasks of mapInArrow: one connection a task, batches cut to a bounded number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one SQL statement sees; a longer text is alone. Lists of its units take some tens of times as much.
SLICE_BYTES = 2 << 20


def connection() -> duckdb.DuckDBPyConnection:
    """A connection of one thread that never spills to the task's folder: its tables are slices."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `most` bytes in a column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def answers(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema, **tables: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a statement over Arrow tables registered by name, as batches of a schema."""
    for name, rows in tables.items():
        con.register(name, pa.Table.from_batches([rows]))
    yield from con.sql(sql).to_arrow_table().select(schema.names).cast(schema).to_batches()
    for name in tables:
        con.unregister(name)
