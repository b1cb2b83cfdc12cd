"""Arrow passes over texts whose Python workers hold few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: A piece ends with so many rows, or with the row that brings its first column to so many characters.
ROWS, CHARS = 256, 1 << 20


def in_pieces(of: Callable, kind: pa.DataType) -> Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.Array]]:
    """``of`` of each row's values, put out piece by piece as Arrow arrays of ``kind``.

    Spark sends up to 10,000 rows or 64 MB at once. They stay as they come; the Python values of one piece are all that a worker
    holds besides, so that its memory does not follow the rows of its task.
    """

    def pieces(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        out, chars = [], 0
        for row in zip(*columns, strict=True):
            values = [x.as_py() for x in row]
            out.append(of(*values))
            chars += len(values[0] or "")
            if len(out) == ROWS or chars >= CHARS:
                yield pa.array(out, kind)
                out, chars = [], 0
        if out:
            yield pa.array(out, kind)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from pieces(batch if isinstance(batch, tuple) else (batch,))  # one column comes as it is
            del batch  # it is not to stay beside the next one

    return run


def piecewise(of: Callable, kind: pa.DataType, returns: str) -> Callable:
    """``in_pieces`` as a function of columns. Not deterministic for the planner: what stands behind it is not to run it again."""
    return F.arrow_udf(in_pieces(of, kind), returns).asNondeterministic()
