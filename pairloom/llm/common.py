"""What the operators of this folder share.

Operators take a table of documents and the names of its id and text columns,
read no other column, and so don't mind further columns of any name. A null
text counts as empty unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pairloom.storage import new_path

#: Arrow types of the DDL types used here (fixed values).
ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}

#: Texts handled at once inside a task.
SLICE = 256

Texts = list[str | None]


def per_text(make: Callable[[], Callable[[Texts], dict[str, Any]]], fields: dict[str, str]) -> Callable[[Any], Column]:
    """A column function from text to a struct.

    ``make()`` is called once per task; what it returns gets up to ``SLICE``
    texts and gives one list per field. Only the text leaves the JVM.
    """
    ddl = ", ".join(f"{name}: {kind}" for name, kind in fields.items())

    @arrow_udf(f"struct<{ddl}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            parts = [work(batch.slice(i, SLICE).to_pylist()) for i in range(0, len(batch), SLICE)]
            columns = [
                pa.chunked_array([pa.array(p[name], ARROW[kind]) for p in parts], ARROW[kind]).combine_chunks()
                for name, kind in fields.items()
            ]
            yield pa.StructArray.from_arrays(columns, list(fields))

    return run.asNondeterministic()  # else a filter on one field runs it twice


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    For results that are read more than once or that hang on how rows were
    dealt out: a lost executor then leads to no second, different answer.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict[str, Any]]:
    """``staged``, and aggregates taken while the rows are written."""
    path, seen = new_path(df.sparkSession, name), Observation()
    df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def same(a: Column, b: Column) -> Column:
    """Equal, or both null."""
    return a.eqNullSafe(b)


def one_row_each(docs: DataFrame, keep: DataFrame, key: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``keep``, one row for each key.

    ``key`` names expressions over ``docs``; ``keep`` has columns of these
    names, no key twice, and ``rows``, the number of rows of ``docs`` with that
    key. All columns of ``docs`` stay as they are.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    left = docs.select(held, *[c.alias(f"_{k}") for k, c in key.items()])
    on = None
    for k in key:
        part = same(F.col(f"_{k}"), F.col(f"_keep_{k}"))
        on = part if on is None else on & part
    right = keep.select(*[F.col(k).alias(f"_keep_{k}") for k in key], F.col("rows").alias("_rows"))
    found = left.join(right, on)
    once = found.filter("_rows = 1").select("_row")
    again = found.filter("_rows > 1").dropDuplicates([f"_{k}" for k in key]).select("_row")
    return once.unionByName(again).select("_row.*")
