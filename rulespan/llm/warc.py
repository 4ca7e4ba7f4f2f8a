"""WARC archives in which every record is a Zstandard frame and a dictionary leads the file.

A file starts with a skippable frame (0x184D2A5D) that holds the dictionary; each record follows as a frame of its
own, compressed with it, so that a reader can start at any record. The dictionary is trained on records of the file;
where they are too few or too alike to train on, it is raw content: the records' own bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, calm, materialise, open_fs, raw, shared_dir, write_file

DICT_MAGIC = 0x184D2A5D
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
#: Bytes of a file's dictionary, and of the sample it is trained on: parts of records of PART_BYTES, taken evenly over a
#: file's first HELD_BYTES of records, which a task holds until then.
DICT_BYTES, SAMPLE_BYTES, PART_BYTES, HELD_BYTES = 64 << 10, 4 << 20, 32 << 10, 16 << 20
#: Bytes of a dictionary's segments: given, not searched for, which would take ten times as long.
SEGMENT = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value: str) -> str:
    """A header's value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers, HTTP headers and payload of a record; a response's payload digest is computed anew and must agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    web = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = lambda x: int(x.split(":")[2]) if x.split(":")[2] else None
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{h['WARC-Record-ID']}: payload digest differs")
    return {
        "page_id": page(h["WARC-Record-ID"]), "url": _unline(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, "payload_bytes": int(web["Content-Length"]),
        "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": page(h["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def train(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for the records; empty only where there are none."""
    import zstandard

    parts = [r[i : i + PART_BYTES] for r in records for i in range(0, len(r), PART_BYTES)]
    sample = parts[:: max(1, sum(map(len, parts)) // SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, sample)) // 8), sample, k=SEGMENT, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # raw content: matches are cheapest at its end, where the first records stand
        return b"".join(reversed(sample))[-size:]


def encode_archive(records: Iterable[bytes], held_bytes: int = HELD_BYTES, level: int = 3) -> Iterator[bytes]:
    """The chunks of an archive: the dictionary is trained on the first held_bytes of records, then each record is a frame."""
    import zstandard

    it, held, size = iter(records), [], 0
    for r in it:
        held.append(r)
        size += len(r)
        if size >= held_bytes:
            break
    trained = train(held)
    yield struct.pack("<II", DICT_MAGIC, len(trained)) + trained
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    for r in held:
        yield pack.compress(r)
    held.clear()
    for r in it:
        yield pack.compress(r)


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one after another; memory holds a record and a read buffer."""
    import zstandard

    store, at = open_fs(path)
    with store.open_input_stream(at, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        trained = f.read(n)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        rest = b""
        while True:
            one, out = unpack.decompressobj(), []
            while not one.eof:
                if not rest and not (rest := f.read(1 << 18)):
                    break
                out.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            if not one.eof:
                if out and any(out):
                    raise ValueError(f"{path}: ends within a record")
                return
            yield b"".join(out)


def decide(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST_REVISIT) -> DataFrame:
    """key, url, html, digest, refers_to (null: a response) of each row.

    Of equal payloads (SHA-1 and length) of at least `least` bytes the largest key is the response. Rows that share
    that key too are all responses, and so are payloads that only rows of null keys have. Digests are grouped with
    partial aggregation, and only digests found more than once are joined back.
    """
    rows = pages.select(pages[key].cast("long").alias("key"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    twice = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("key").alias("first")).filter("n > 1").drop("n")
    twice = materialise(twice, "warc-repeats")
    return rows.join(twice, ["digest", "bytes"], "left").select("key", "url", "html", "digest", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", folder: str | None = None, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row; returns path and records of each archive.

    Null html is an empty payload, a null url no target, a null key none in the record's id; repeated rows give a
    record each; an empty table gives no archives. A task holds HELD_BYTES of records, or one record if it is longer.
    Other columns, whatever their names, change nothing.
    """
    # a folder of our own goes with the table of its files
    own = [] if folder else [folder := shared_dir(pages.sparkSession, "warc")]

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = f"{folder}/part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.zst"
        n = 0

        def records():
            nonlocal n
            for b in parts:
                for k, u, h, d, r in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), raw(b.column("html")), b.column("digest").to_pylist(), b.column("refers_to").to_pylist()):
                    n += 1
                    yield make_record(k, u, h, d, r, date)

        write_file(at, encode_archive(records()))
        if n:
            yield pa.RecordBatch.from_pydict({"path": [at], "records": [n]})

    return materialise(decide(pages, key, html, url, least).mapInArrow(calm(write), "path string, records long"), "warc-files", *own)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in the archives."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for at in b.column("path").to_pylist():
                    for record in read_archive(at):
                        r = parse_record(record)
                        yield tuple(r[c] for c in _OUT.names)

        yield from batches(rows(), _OUT)

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism) * 4
    return archives.select("path").repartition(n).mapInArrow(calm(read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
