"""A user's own batched function over a table (inventory J1).

``map_batched`` hands a Python function batches of columns, as lists, and
takes back any number of rows: one row may become several (long texts cut
into windows) or none (filters).  The rows that come back say which row of the batch
they come from, and the key columns are attached from that, so a function
can't lose or mix them up.  Batches are bounded in rows and in bytes: a text
of many megabytes is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024
#: The result's column that holds, for each row, the position in the batch of the row it comes from.
ORIGIN = "origin"

Batch = dict[str, list]


def _pieces(batch: pa.RecordBatch, rows: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into pieces of at most ``rows`` rows and ``limit`` bytes, one row at least."""
    start = 0
    while start < batch.num_rows:
        n = min(rows, batch.num_rows - start)
        while n > 1 and batch.slice(start, n).nbytes > limit:
            n = max(1, n // 2)
        yield batch.slice(start, n)
        start += n


def _one(fn: Callable[[Batch], Batch], piece: pa.RecordBatch, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    out = dict(fn({c: piece.column(c).to_pylist() for c in piece.schema.names}))
    origin = out.pop(ORIGIN, None)
    wanted = [f.name for f in schema if f.name not in keys]
    if set(out) != set(wanted):
        raise ValueError(f"the function returned the columns {sorted(out)}, not {sorted(wanted)}")
    sizes = {len(v) for v in out.values()} or {piece.num_rows if origin is None else len(origin)}
    if len(sizes) != 1:
        raise ValueError(f"the function returned columns of different lengths: { {c: len(v) for c, v in out.items()} }")
    n = sizes.pop()
    if origin is None:
        if n != piece.num_rows:
            raise ValueError(f"{n} rows came back for {piece.num_rows}: the function must return {ORIGIN!r} to change their number")
        origin = range(n)
    if len(origin) != n or any(not 0 <= k < piece.num_rows for k in origin):
        raise ValueError(f"{ORIGIN!r} must name a row of the batch for each of the {n} rows returned")
    take = pa.array(origin, pa.int64())
    return pa.RecordBatch.from_arrays(
        [piece.column(f.name).take(take).cast(f.type) if f.name in keys else pa.array(out[f.name], f.type) for f in schema], schema=schema)


def map_batched(df: DataFrame, fn: Callable[[Batch], Batch], returns: StructType, keys: list[str],
                batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``fn`` over batches of ``df``; one row (keys..., returned columns...) per row returned.

    ``fn`` gets a dict of lists, one per column of ``df``, and returns a dict
    of equally long lists named as in ``returns``.  If it returns another
    number of rows it adds ``origin``: for each row the position in the batch of
    the row it comes from.  Without rows the function isn't called.
    """
    clash = set(keys) & set(returns.names)
    if clash:
        raise ValueError(f"returned columns named like keys: {sorted(clash)}")
    full = StructType([*[df.schema[k] for k in keys], *returns.fields])
    schema = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b, batch_rows, batch_bytes):
                for out in _pieces(_one(fn, piece, keys, schema), BATCH_ROWS, batch_bytes):
                    yield out

    return df.mapInArrow(run, full)
