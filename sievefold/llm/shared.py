"""Shared storage, bounded batches and word splitting used by all operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefold.sources.store import Scratch

__all__ = ["Scratch", "bound_batches", "hashable", "keep_columns", "let", "library_tokenizer", "row_keys", "slices", "split_words", "with_text"]

#: Words are maximal runs of characters other than space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]"


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two longs, never null, that tell rows apart by id and text; equal rows share them.

    128 bits whatever the id's type; a null id is kept apart from all others.
    """
    apart = F.col(id_col).isNull()
    return F.xxhash64(id_col, text_col, apart), F.xxhash64(text_col, apart, id_col)


def hashable(df: DataFrame) -> list[Column]:
    """The columns of the frame that a hash can take, for a lasting order among rows that are equal otherwise."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


#: Bytes of rows in a batch on its way to Python. By Spark's own bound, 64 MB or 10,000 rows, the JVM and Python each hold tens of MB a task.
ARROW_BYTES = 8 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session bounds Arrow batches by ``ARROW_BYTES`` from now on, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(name, str(ARROW_BYTES))
    return df


def with_text(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """(row, text) of batches of whole rows: the text is the row's own field, so it is sent once."""
    for batch in batches:
        row = batch.column(0)
        yield pa.RecordBatch.from_arrays([row, row.field(place)], names=["row", "text"])


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``max_bytes`` of ``column`` or one row.

    At the end the worker, which is kept for later tasks, gives back what Arrow holds free.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[pa.Array, "pa.Array"]:
    """(words of all texts, row number of each word), in order; null has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # splits at the separators and nothing else
    rows, words = pc.list_parent_indices(parts), pc.list_flatten(parts)
    keep = pc.greater(pc.binary_length(words), 0)
    return words.filter(keep), rows.filter(keep)


def keep_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns under the names an operator uses inside.

    Extra columns of the input, whatever their names, can't clash.
    """
    return bound_batches(df).select(*[F.col(f"`{name}`").alias(inner) for inner, name in wanted.items()])


def library_tokenizer(path: str):
    """A tokenizer of the tokenizers library, kept to the task's own thread; tasks are what runs side by side."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` uses it in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)
