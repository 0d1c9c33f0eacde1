"""Helpers shared by the operators: scans, Arrow batch loops, written tables."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.session import materialize_table

#: Characters of text that a Python task works on at once (bounds its memory).
BLOCK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the cluster's shared checkpoint folder and read again:
    a lost executor costs a read, not the work behind it."""
    return materialize_table(df, f"llm-{name}")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; a null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_blocks(batch: pa.RecordBatch, limit: int = BLOCK_CHARS, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text, or one row, each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
