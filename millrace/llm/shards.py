"""Shards: blocks of documents whose contents are numbers of a dictionary.

A task codes what its documents hold (words, pairs of token ids) by a dictionary of its
own, one for each shard. Only the entries of these dictionaries, not their occurrences,
go through a shuffle to be given what is known of them in the whole corpus, and come back
as one array for each shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import shared_path

#: Bytes of text of a shard, about; a longer text is a shard of its own. Shards in a written file.
SHARD, IN_FILE = 4 << 20, 8


def cut(sizes: list[int], most: int = SHARD) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of neighbours that add up to ``most``, or of one larger than that."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i - first
            first, total = i, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes) - first


def write_shards(rows: DataFrame, build: Callable[[list[bytes]], dict], columns: str, name: str, text: str = "text", most: int = SHARD) -> DataFrame:
    """A written table (shard, rows, *columns): ``rows`` holds all columns besides the text, one entry a document.

    ``build`` gives the other columns, as ``columns`` names their types, from the texts in
    UTF-8 (null is empty). A shard's number is that of its task and its place there; it is
    unique because of each task one attempt's rows are written.
    """
    held = rows.drop(text)
    row = T.StructType(held.schema.fields)
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("rows", T.ArrayType(row)), *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)
    kept = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            texts = [x or b"" for x in batch.column(batch.schema.get_field_index("_bytes")).to_pylist()]
            for first, n in cut([len(x) for x in texts], most):
                some = pa.StructArray.from_arrays([batch.column(batch.schema.get_field_index(f"_{i}")).slice(first, n) for i in range(len(kept))], fields=list(arrow.field("rows").type.value_type))
                built = build(texts[first : first + n]) | {"shard": [next(number)], "rows": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), some)}
                yield pa.RecordBatch.from_arrays([_one(built[f.name], f.type) for f in arrow], schema=arrow)

    # Columns travel under names of their own, so that none of the given ones can clash.
    sent = rows.select(*[held[c].alias(f"_{i}") for i, c in enumerate(kept)], rows[text].cast("binary").alias("_bytes"))
    path = shared_path(rows.sparkSession, name)
    sent.mapInArrow(run, schema).write.option("maxRecordsPerFile", IN_FILE).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _one(value, kind: pa.DataType) -> pa.Array:
    """An Arrow array of one row."""
    if isinstance(value, pa.Array) and value.type == kind and len(value) == 1:
        return value
    if pa.types.is_list(kind):
        items = value.cast(kind.value_type) if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items).cast(kind)
    return pa.array(value, kind)


def flat(rows: pa.Array, more: dict, schema: pa.Schema) -> pa.RecordBatch:
    """The entries of a struct array as rows, with more columns."""
    fields = dict(zip([f.name for f in rows.type], rows.flatten()))
    return pa.RecordBatch.from_arrays([pa.array(more[f.name], f.type) if f.name in more else fields[f.name] for f in schema], schema=schema)
