"""Rows of Arrow batches on executors, a few at a time: what Python holds does not grow with a batch or a task."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa

#: Rows, and bytes of them, that are held as Python values at once.
ROWS, BYTES = 256, 4 << 20

TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def schema_of(text: str) -> pa.Schema:
    """Of a flat schema as Spark writes it: `a string, b int`."""
    return pa.schema([(n, TYPES[t]) for n, t in (x.strip().split(" ") for x in text.split(","))])


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Views of the batches of at most so many rows, fewer where these are long."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Named tuples of the rows, values as Python has them."""
    kind = None
    for piece in pieces(batches):
        kind = kind or namedtuple("Row", piece.schema.names)
        yield from map(kind._make, zip(*(c.to_pylist() for c in piece.columns), strict=True))


def batches_of(rows: Iterable[Sequence], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows (values in the schema's order), each as small as `pieces` gives them."""
    wide = [i for i, t in enumerate(schema.types) if pa.types.is_binary(t) or pa.types.is_string(t)]
    held: list[Sequence] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(row[i]) for i in wide if row[i] is not None)
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
