"""Columns computed in Python beside columns that only pass through."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .workers import lean


def with_columns(docs: DataFrame, inputs: Sequence[str], compute: Callable[..., Sequence[Sequence]],
                 made: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """``docs`` with the columns ``made``, which replace columns of the same
    names in place.  ``compute`` gets the ``inputs`` of an Arrow batch as lists
    and returns a list for each new column.  All else passes through as Arrow,
    whatever its type."""
    types = dict(made)
    fields = [T.StructField(f.name, types.get(f.name, f.dataType)) for f in docs.schema.fields]
    fields += [T.StructField(n, t) for n, t in made if n not in docs.columns]
    arrow = {n: to_arrow_type(t) for n, t in made}
    inputs = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = compute(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in inputs])
            cols = {n: pa.array(v, arrow[n]) for n, v in zip(arrow, new, strict=True)}
            old = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            both = {**old, **cols}
            yield pa.RecordBatch.from_arrays(list(both.values()), list(both))

    return docs.mapInArrow(lean(run), T.StructType(fields))
