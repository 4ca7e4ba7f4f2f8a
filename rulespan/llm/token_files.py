"""Token-id files: independent zstandard frames, a document index, a trailing seek table with frame checksums.

Layout of a file (integers little-endian):
  data frames     each an independent zstandard frame of whole 32-bit ids, cut at frame_bytes (long documents span frames)
  index           a skippable frame (0x184D2A50): a zstandard frame of per-document records <key int64><has key uint8><ids uint64>
  seek table      a skippable frame (0x184D2A5E) in zstandard's seekable format: per frame compressed size,
                  decompressed size and the low 32 bits of the content's XXH64; then frame count, descriptor 0x80, 0x8F92EAB1
A reader takes the footer, then the index, then only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, calm, key_text, materialise, open_fs, raw, shared_dir, write_file
from .tokens import default_path, encoder

INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_DOC = struct.Struct("<qBQ")
_ENTRY = struct.Struct("<III")


def encode_file(docs: Iterable[tuple[int | None, bytes]], frame_bytes: int = 1 << 20, level: int = 3, totals: list | None = None) -> Iterator[bytes]:
    """The chunks of a file that holds docs: (key, its ids as bytes). Memory: one frame and the index."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
    entries, index, held = [], bytearray(), bytearray()

    def frame(content: bytes) -> bytes:
        out = pack.compress(content)
        entries.append(_ENTRY.pack(len(out), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return out

    n = ids = 0
    for key, data in docs:
        index += _DOC.pack(key or 0, key is not None, len(data) // 4)
        n, ids = n + 1, ids + len(data) // 4
        held += data
        while len(held) >= frame_bytes:
            yield frame(bytes(held[:frame_bytes]))
            del held[:frame_bytes]
    if held:
        yield frame(bytes(held))
    body = pack.compress(bytes(index))
    entries.append(_ENTRY.pack(len(body) + 8, 0, 0))
    yield struct.pack("<II", INDEX_MAGIC, len(body)) + body
    table = b"".join(entries) + struct.pack("<IBI", len(entries), 0x80, FOOT_MAGIC)
    yield struct.pack("<II", SEEK_MAGIC, len(table)) + table
    if totals is not None:
        totals += [n, ids]


class TokenFile:
    """Reads a file; only the frames that are asked for are fetched, checked and decompressed."""

    def __init__(self, path: str) -> None:
        import zstandard

        store, at = open_fs(path)
        self.file = store.open_input_file(at)
        self.unpack = zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC:
            raise ValueError(f"{path}: no seek table")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames, offset, start = [], 0, 0
        for packed, plain, check in _ENTRY.iter_unpack(table):
            if plain:
                self.frames.append((offset, packed, start, plain, check))
                start += plain
            else:
                head = self._at(offset, packed)
                self.docs = [(key if has else None, ids) for key, has, ids in _DOC.iter_unpack(self.unpack.decompress(head[8:]))]
            offset += packed

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        offset, packed, _, plain, check = self.frames[i]
        out = self.unpack.decompress(self._at(offset, packed), max_output_size=plain)
        if xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i}: checksum differs")
        return out

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(key, ids before it in the file, its ids as bytes) of the documents at the places wanted, or of all."""
        have, at, f, start = -1, b"", 0, 0
        for i, (key, ids) in enumerate(self.docs):
            a, b = 4 * start, 4 * (start + ids)
            if wanted is None or i in wanted:
                out = bytearray()
                while f < len(self.frames) and self.frames[f][2] + self.frames[f][3] <= a:
                    f += 1
                g = f
                while g < len(self.frames) and self.frames[g][2] < b:
                    if have != g:
                        have, at = g, self.frame(g)
                    base = self.frames[g][2]
                    out += at[max(0, a - base) : b - base]
                    g += 1
                yield key, start, bytes(out)
            start += ids


def write_token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes docs in ascending key order (null keys first, equal keys by the text's first 32 characters, then by a hash of it) and returns a manifest.

    Manifest: file, path, docs, ids, start (ids in all files before). Text is range-partitioned by key and encoded
    after that shuffle, once; rows of one key, also of the null key, spread over ranges too, and repeated rows by their place. Null text: as empty, the end id alone. An empty table gives no files; other columns, whatever
    their names, change nothing. A task holds one document's ids, however long, and a frame.
    """
    # a folder of our own goes with the manifest
    own = [] if folder else [folder := shared_dir(docs.sparkSession, "tokens")]
    path = tokenizer or default_path()
    end = struct.pack("<I", end_id)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path)
        part = TaskContext.get().partitionId()
        # the attempt's own name: the manifest, committed once, names the file that counts
        at = f"{folder}/part-{part:06d}-{TaskContext.get().taskAttemptId()}.tok"

        def encoded():
            for b in parts:
                for k, t in zip(b.column("key").to_pylist(), raw(b.column("text"))):
                    yield k, enc.ids(t.decode("utf-8", "replace")) + end

        totals: list[int] = []
        write_file(at, encode_file(encoded(), totals=totals))
        if totals[0]:
            yield pa.RecordBatch.from_pydict({"file": [part], "path": [at], "docs": [totals[0]], "ids": [totals[1]]})

    order = ("key", "head", "tie", "place")
    dealt = key_text(docs, key, text).select("*", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    files = materialise(dealt.mapInArrow(calm(write, keep_tokens=True), "file long, path string, docs long, ids long"), "token-files", *own)
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


_READ = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def read_token_files(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Per document of the files: key, start, n_tokens, ids_crc32, and ids as bytes if asked for. One task a few files.

    start runs over all files in key order. Documents are read one at a time, repeated and empty ones too; a manifest
    without files gives no rows.
    """
    schema = _READ if ids else pa.schema(list(_READ)[:-1])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for at, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                    for k, before, data in TokenFile(at).read():
                        row = (k, start + before, len(data) // 4, zlib.crc32(data))
                        yield (*row, data) if ids else row

        yield from batches(rows(), schema, 1000)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism) * 4
    dealt = manifest.select("path", "start").repartition(n)
    return dealt.mapInArrow(calm(read), "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
