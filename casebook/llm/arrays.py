"""Arrow helpers for tasks that walk over the words of whole texts in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_CHARS = 1_500_000
BATCH_ROWS = 512
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(column) -> pa.LargeStringArray:
    """The column as one large-string array; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def in_batches(rows: DataFrame) -> DataFrame:
    """``rows``, sent to tasks in batches of at most ``BATCH_ROWS`` texts.

    Spark's default of 10,000 rows a batch is meant for numbers. The session
    keeps the smaller setting: it is read when the plan runs.
    """
    conf = rows.sparkSession.conf
    if int(conf.get(BATCH_CONF)) > BATCH_ROWS:
        conf.set(BATCH_CONF, BATCH_ROWS)
    return rows


def blocks(batches: Iterator[pa.RecordBatch], text: str, rows: int, chars: int = BLOCK_CHARS) -> Iterator[pa.Table]:
    """Regroup the rows of a task, in order, into tables of bounded length.

    A table ends at ``rows`` rows or ``chars`` bytes of text; a longer text is
    a table of its own. Empty tasks give no table.
    """
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, length in enumerate(lengths.tolist()):
            if n and (n >= rows or size + length > chars):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, n, size, start = [], 0, 0, i
            n += 1
            size += length
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
        held.clear()
    # The worker goes on with other tasks: what this one needed goes back to the system.
    pa.default_memory_pool().release_unused()


def coded_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Runs of characters other than ASCII white space.

    Returns the bounds of each text's words, the word numbers and the distinct
    words that the numbers stand for.
    """
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices)
    distinct = coded.dictionary.to_pylist()
    if "" in distinct:
        real = codes != distinct.index("")
        kept = np.concatenate([[0], np.cumsum(real)])
        return kept[bounds], codes[real], distinct
    return bounds, codes, distinct


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs: each start followed by its length of successors."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
