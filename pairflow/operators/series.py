"""Functions of one whole series at a time, in the order of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _starts(batch: pa.RecordBatch, keys: int) -> list[int]:
    """Rows of a batch whose key differs from that of the row before."""
    new = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in batch.columns[:keys]:
        a, b = c[1:], c[:-1]
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= differs.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def by_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], f: Callable[..., Sequence[np.ndarray] | None], out: str) -> DataFrame:
    """``keys`` and the columns ``out`` (a DDL string): the arrays that ``f`` makes of the arrays of ``values`` of each series.

    ``f`` gets doubles (null as NaN) in the order of ``order`` and returns arrays of one length, or None for no rows. Series are dealt out by key and sorted by Spark, and
    a task goes through its series one after the other; it holds 8 bytes for each value of a single series. A series has a row for
    each of its dates, so its length is bounded by the calendar, not by the size of the table.
    """
    kinds = {f_.name: f_.dataType.simpleString() for f_ in df.schema.fields}
    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], out])
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[list[np.ndarray]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            found = f(*[np.concatenate(c) for c in zip(*held, strict=True)])
            if found is not None and len(found[0]):
                names = [pa.repeat(pa.scalar(v, t), len(found[0])) for v, t in zip(key, schema.types, strict=False)]
                yield pa.RecordBatch.from_arrays([*names, *[pa.array(c, t) for c, t in zip(found, schema.types[width:], strict=True)]], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[width:]]
            starts = _starts(batch, width)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own = tuple(c[a].as_py() for c in batch.columns[:width])
                if held and own != key:
                    yield from closed()
                    held = []
                key = own
                held.append([c[a:b] for c in columns])
        if held:
            yield from closed()

    # by a hash of the keys: Spark leaves out a shuffle by columns that a join below has dealt out by, and when it then broadcasts that join's
    # other side at run time and reads its files in place, a series would lie in several tasks
    rows = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return rows.select(*keys, *values).mapInArrow(run, ddl)
