"""Exact duplicates by Grace hash deduplication.

Level 0: each task collapses the copies in its own rows, in an open-addressing table that compares complete
contents, and deals one record for each content to partitions by its hash. Each partition then fills such a
table; once it holds its budget, records of other contents go to spill files in the shared folder, dealt by
further bits of the hash, and each file is treated in the same way until every bucket fits.
A content that a third of all rows share reaches its partition as one record from each task.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .common import batches, calm, materialise, open_fs, raw, shared_dir, unused

FANOUT = 16
#: Of one task's rows of a content, the one that may stay (its number is `rep`) carries content, hash and count.
_LOCAL = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("rep", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])
LOCAL = "key long, row long, rep long, hash long, n long, text binary"
_CLASS = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
CLASS = "rep long, keep_id long, keep_row long, group_size long, text_sha256 string"


class Table:
    """Open addressing with linear probing; slots hold indexes of entries, and contents are compared in full."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.size = 0

    def find(self, h: int, text: bytes) -> int:
        """The entry that holds text, or ~slot of the free slot for it."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return e
            at = (at + 1) & mask
        return ~at

    def put(self, free: int, h: int, text: bytes) -> int:
        self.slots[~free] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.size += len(text) + 120
        if 2 * len(self.texts) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for e, x in enumerate(self.hashes):
                at = x & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = e
        return len(self.texts) - 1


Record = tuple[int, int, int, int | None, int, bytes]  # hash, rep, n, best, best_row, text


def better(a: tuple[int | None, int], b: tuple[int | None, int]) -> bool:
    """a stays rather than b: the larger key, null least, and of equal keys the larger row."""
    least = -(1 << 63) - 1
    return (least if a[0] is None else a[0], a[1]) > (least if b[0] is None else b[0], b[1])


class Spill:
    """One file of records; it goes when it has been read or the task ends."""

    def __init__(self, folder: str, level: int, part: int) -> None:
        self.store, at = open_fs(folder)
        self.path = f"{at}/{level}-{part}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.path, compression="zstd")

    def add(self, r: Record) -> None:
        h, rep, n, best, row, text = r
        self.out.write(struct.pack("<QqqqqBI", h, rep, n, best or 0, row, best is None, len(text)) + text)

    def read(self) -> Iterator[Record]:
        size = struct.calcsize("<QqqqqBI")
        with self.store.open_input_stream(self.path, compression="zstd") as f:
            while head := f.read(size):
                h, rep, n, best, row, none, length = struct.unpack("<QqqqqBI", head)
                yield h, rep, n, None if none else best, row, f.read(length)

    def drop(self) -> None:
        if not self.out.closed:
            self.out.close()
        if self.store.get_file_info(self.path).type != 0:
            self.store.delete_file(self.path)


def grace(records: Iterator[Record], folder: str, budget: int, level: int = 0, spilled: Callable[[int], None] = lambda level: None) -> Iterator[tuple]:
    """(rep, keep_id, keep_row, group_size, sha256) of every record, with no more than about budget bytes of contents in memory.

    A content in the table keeps its later records here; all records of any other content go to the same file.
    """
    table, stats, reps = Table(), [], []
    files: dict[int, Spill] = {}
    try:
        for h, rep, n, best, row, text in records:
            e = table.find(h, text)
            if e < 0 and table.size + len(text) > budget and table.texts:
                part = (h >> (60 - 4 * level)) % FANOUT if level < 15 else xxhash.xxh64_intdigest(text, level) % FANOUT
                if part not in files:
                    files[part] = Spill(folder, level, part)
                    spilled(level)
                files[part].add((h, rep, n, best, row, text))
                continue
            if e < 0:
                e = table.put(e, h, text)
                stats.append([n, best, row])
            else:
                s = stats[e]
                s[0] += n
                if better((best, row), (s[1], s[2])):
                    s[1], s[2] = best, row
            reps.append((rep, e))
        shas = [hashlib.sha256(t).hexdigest() for t in table.texts]
        table = Table()
        for rep, e in reps:
            yield rep, stats[e][1], stats[e][2], stats[e][0], shas[e]
        reps = []
        for f in files.values():
            f.out.close()
            yield from grace(f.read(), folder, budget, level + 1, spilled)
            f.drop()
    finally:
        for f in files.values():
            f.drop()


def _dealt(docs: DataFrame, key: str, text: str, budget: int, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(local, classed): a row for each row of docs with its number, its class's number in its task, and carried columns
    c0, c1, ...; and the class of each of those numbers. local is a written table, so numbers no longer change."""
    spark = docs.sparkSession
    # null texts count as empty, but stay null in what is carried
    source = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))
    held = [f"c{i}" for i in range(len(carry))]

    def collapse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        i = TaskContext.get().partitionId() << 36
        held_back: list[pa.RecordBatch] = []
        table, members, stats, size = Table(), [], [], 0

        def flush():
            first = held_back[0].column("row")[0].as_py()
            total = sum(b.num_rows for b in held_back)
            cols = {c: [None] * total for c in ("hash", "n", "text")}
            for e, (n, _, best_row) in enumerate(stats):
                h = table.hashes[e]
                at = best_row - first
                cols["hash"][at], cols["n"][at], cols["text"][at] = h - (1 << 64) if h >> 63 else h, n, table.texts[e]
            done = 0
            for b in held_back:
                part = {c: pa.array(v[done : done + b.num_rows], _LOCAL.field(c).type) for c, v in cols.items()}
                part["rep"] = pa.array([stats[e][2] for e in members[done : done + b.num_rows]], pa.int64())
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([part[c] if c in part else b.column(c) for c in (*_LOCAL.names, *held)], names=[*_LOCAL.names, *held])

        for b in parts:
            keys, rows = b.column("key").to_pylist(), range(i, i + b.num_rows)
            i += b.num_rows
            for k, t, row in zip(keys, raw(b.column("text")), rows):
                h = xxhash.xxh64_intdigest(t)
                e = table.find(h, t)
                if e < 0:
                    e = table.put(e, h, t)
                    stats.append([1, k, row])
                else:
                    s = stats[e]
                    s[0] += 1
                    if better((k, row), (s[1], s[2])):
                        s[1], s[2] = k, row
                members.append(e)
            slim = [c for c in b.schema.names if c != "text"]
            held_back.append(pa.RecordBatch.from_arrays([*(b.column(c) for c in slim), pa.array(rows, pa.int64())], names=[*slim, "row"]))
            size += sum(b.column(c).nbytes for c in held)
            if table.size > budget or len(members) > 200_000 or size > budget:
                yield from flush()
                held_back, table, members, stats, size = [], Table(), [], [], 0
        if members:
            yield from flush()

    schema = LOCAL + "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in held)
    folder = shared_dir(spark, "grace-spill")
    local = materialise(source.mapInArrow(calm(collapse), schema), "grace-local", folder)

    def classes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for part in parts:
                for h, rep, n, best, t in zip(*(part.column(x).to_pylist() for x in ("hash", "rep", "n", "key", "text"))):
                    yield h & 0xFFFFFFFFFFFFFFFF, rep, n, best, rep, t

        yield from batches(grace(records(), folder, budget), _CLASS)

    heads = local.filter("text is not null").select("hash", "rep", "n", "key", "text")
    return local, heads.repartition("hash").mapInArrow(calm(classes), CLASS)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 32 << 20) -> DataFrame:
    """Per row of docs: key, row, keep_id, group_size, kept, text_sha256; one row of each content is kept.

    Texts are equal when identical; null counts as empty. The row with the largest key stays, null keys being
    least; of rows that share both key and text one stays. Rows are numbered. An empty table gives no rows; other
    columns, whatever their names, change nothing.
    budget: bytes of distinct contents that one task holds, and the longest content; more go to spill files.
    """
    local, classed = _dealt(docs, key, text, budget, ())
    kept = F.col("row") == F.col("keep_row")
    return local.select("key", "row", "rep").join(classed, "rep").select("key", "row", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def distinct_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 32 << 20) -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all columns as they were.

    The row that stays is one of those that carry their class's content, so whole rows are taken from the table of the
    first pass; docs is read once. A null text that stays is null.
    """
    others = [c for c in docs.columns if c != text]
    null = unused(docs.columns, "null")
    local, classed = _dealt(docs.withColumn(null, docs[text].isNull()), key, text, budget, [*others, null])
    gone = classed.filter("rep != keep_row").select("rep")
    heads = local.filter("text is not null").join(gone, "rep", "left_anti")
    place = {c: F.col(f"c{i}") for i, c in enumerate([*others, null])}
    place[text] = F.when(~place[null], F.col("text").cast(docs.schema[text].dataType))
    return heads.select(*(place[c].alias(c) for c in docs.columns))
