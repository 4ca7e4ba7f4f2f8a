"""What the operators share: the shared folder, files in it, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.store import discard, materialise, shared_dir  # noqa: F401


#: ASCII white space.
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def unused(columns: Iterable[str], name: str) -> str:
    """name, with as many underscores as it takes to be none of the columns, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The whole text in parts of about size bytes, cut behind ASCII white space: no word is split.

    So lists of words stay small however long the text is; a part is larger only where one word is.
    """
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def count_words(text: bytes) -> int:
    return sum(len(c.split()) for c in word_chunks(text))


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_file(path: str, chunks: Iterable[bytes]) -> int:
    """Writes under a name of this attempt and renames: a lost or doubled task leaves no half file."""
    store, at = open_fs(path)
    part = f"{at}.{uuid.uuid4().hex}.part"
    size = 0
    with store.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    store.move(part, at)
    return size


def key_text(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, under names of its own: other columns cannot clash."""
    cols = [df[key].cast("long").alias("key"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text")]
    return df.select(*cols, *(df[c].alias(c) for c in more))


def relax(keep_tokens: bool = False) -> None:
    """Gives memory that a task has freed back to the system: idle Python workers then hold little."""
    if not keep_tokens and (tokens := sys.modules.get(f"{__package__}.tokens")):
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def calm(f: Callable, keep_tokens: bool = False) -> Callable:
    """f over batches, and relax() when its task ends. The workers get the package, whatever folder the driver runs in."""
    ship(SparkSession.active())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(parts)
        finally:
            relax(keep_tokens)

    return run


def raw(column: pa.Array) -> list:
    """The strings of a column as UTF-8 bytes; nulls are None."""
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
