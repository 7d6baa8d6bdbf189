"""Text expressions and row maps that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII text takes the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of text that a row map turns into Python objects at once.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with at most about ``most`` bytes, or one row."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_binary(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, past - at)
        at = past


def append(df: DataFrame, inputs: Sequence[str], added: str, start: Callable[[], Callable[..., Sequence]]) -> DataFrame:
    """``df`` with the columns of the DDL string ``added``, computed slice by slice in map tasks.

    ``start()`` is called once a task and gives the function from lists of the ``inputs`` to one list
    for each added column. All other columns pass through as Arrow, so nulls and large numbers keep
    their values. Columns of ``df`` with the names of added ones are replaced.
    """
    new = StructType.fromDDL(added)
    base = df.drop(*[c for c in new.names if c not in inputs])
    rest = [f for f in base.schema.fields if f.name not in new.names]
    types = list(to_arrow_schema(new).types)
    kept, names = [f.name for f in rest], [f.name for f in rest] + new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for b in (part for whole in batches for part in slices(whole)):
            found = compute(*[b.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(x, type=t) for x, t in zip(found, types, strict=True)]], names=names)

    return base.mapInArrow(run, StructType([*rest, *new.fields]))
