"""How the text operators run vectorised Python: whole columns in, whole columns out, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20
#: For what makes arrays of many times a text's size, or of a fixed size for each row however short its text.
SMALL_BYTES, SMALL_ROWS = 1 << 20, 1 << 10


def slices(batch: pa.RecordBatch, text: str | None, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, at most ``rows``, whose texts have at most so many bytes together; a longer text comes alone."""
    if not batch.num_rows:
        return
    if text is None:
        yield batch
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        to = min(to, at + rows) if rows else to
        yield batch.slice(at, to - at)
        at = to


def add_columns(df: DataFrame, fields: str, fn: Callable[[pa.RecordBatch], list], *, text: str | None = "text", keep: list[str] | None = None, small: bool = False) -> DataFrame:
    """df's columns (or those in keep) and new ones that fn makes of a slice. A new column replaces one of its name.

    small: slices of ``SMALL_BYTES`` and ``SMALL_ROWS``.
    """
    new = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in taken and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, *((SMALL_BYTES, SMALL_ROWS) if small else ())):
                made = fn(piece)
                old = [piece.column(piece.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*old, *made], names=[*names, *new.names])

    return df.mapInArrow(run, StructType([*kept, *new]))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it: for helper columns beside those that a table brings."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
