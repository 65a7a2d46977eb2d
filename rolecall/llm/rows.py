"""Row-wise Arrow passes: new columns from a text column, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that are worked on at once; bounds the memory of a task
#: whatever the number of rows in an Arrow batch. One longer text is a slice of its own.
SLICE_CHARS = 4_000_000


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters (or bytes) each; no text is taken out of ``texts`` for that."""
    sizes = pc.binary_length(texts) if pa.types.is_binary(texts.type) else pc.utf8_length(texts)
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size + 64
    if start < len(texts):
        yield start, len(texts)


def sliced(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` characters of column ``text``, so that few texts are objects at once."""
    for batch in batches:
        for start, end in slices(batch.column(text), limit):
            yield batch.slice(start, end - start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    fields: StructType,
    text: str = "text",
    keep: list[str] | None = None,
    limit: int = SLICE_CHARS,
) -> DataFrame:
    """``keep`` columns (default all) of every row, followed by ``fields``; about ``limit`` characters at once.

    ``make`` runs once in every task and returns a function from a list of texts
    (null is given as the empty text) to one list or array for each field. A
    kept column with the name of a new field gives way to the new one. Repeated
    rows stay repeated; an empty table gives an empty table.
    """
    new = {name.lower() for name in fields.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*(df[f"`{c}`"] for c in dict.fromkeys([*kept, text])))
    schema = StructType([source.schema[c] for c in kept] + fields.fields)
    arrow = to_arrow_schema(schema)
    place = source.columns.index(text)
    places = [source.columns.index(c) for c in kept]

    def run(batches):
        work = make()
        for batch in sliced(batches, place, limit):
            made = work([x or "" for x in batch.column(place).to_pylist()])
            columns = [batch.column(i) for i in places] + list(made)
            columns = [
                c if isinstance(c, pa.Array) and c.type == f.type else _array(c, f.type)
                for c, f in zip(columns, arrow, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
