"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelode.session import checkpoint_folder, cut_lineage


#: Rows that an operator sees at a time, so that what it makes of them stays small.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` with a set-up per task: ``make()`` gives the function that turns a batch into batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                yield from work(batch.slice(first, BATCH_ROWS))
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    return df.mapInArrow(run, schema)


def chunks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each, a single longer text alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each text begins and ends; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Rows of an intermediate table that go to one task.
TASK_ROWS = 200_000


def row_count(df: DataFrame) -> int:
    """Rows of a stored table, counted by task and added up by the driver, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["n"])

    return sum(r.n for r in df.select(df.columns[0]).mapInArrow(run, "n long").collect())


def compact(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` with its lineage cut, in as few partitions as its rows need: each task that reads it writes shuffle files."""
    out = cut_lineage(df)
    return out.coalesce(row_count(out) // task_rows + 1)
