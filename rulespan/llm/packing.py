"""Packing of documents into sequences, the mixture of sources held by deficit round-robin.

Every source has a queue. For each window of `width` ids a source's deficit grows by width times its target share;
sources are visited in turn and send as many ids as their deficits allow. Deficits below `least` wait for later
windows, so that pieces do not become tiny. What a window still lacks comes from the queues with the largest
deficits, which may then be negative. Deficits pass from window to window; and the deficits that a partition
starts with are those left by all partitions before it: since a partition packs all its documents, they follow
from the partitions' totals, and partitions need not wait for each other.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, calm, materialise, raw, shared_dir, write_file
from .token_files import TokenFile, encode_file
from .tokens import default_path, encoder

WIDTH = 2048
LEAST = 128

Piece = tuple[int, int, int, int, int]  # document, start in it, length, sequence, offset


def windows(total: int, width: int = WIDTH) -> list[int]:
    """Lengths of the sequences that hold total ids: full ones, then powers of two, which need no padding."""
    rest = total % width
    return [width] * (total // width) + [1 << b for b in reversed(range(width.bit_length())) if rest >> b & 1]


def pack(queues: dict[str, list[tuple[int, int]]], share: dict[str, float], deficit: dict[str, float], width: int = WIDTH, least: int = LEAST) -> Iterator[Piece]:
    """Pieces of the documents in queues (source -> (document, its ids) in order). Every id lies in one piece, every window is full.

    deficit is the state at the start and holds the state at the end.
    """
    order = sorted(queues, key=lambda s: (-share.get(s, 0), s))
    left = {s: sum(n for _, n in queues[s]) for s in order}
    at = {s: [0, 0] for s in order}  # document in the queue, ids of it that have gone
    for seq, size in enumerate(windows(sum(left.values()), width)):
        offset = 0

        def send(s: str, n: int):
            nonlocal offset
            n = min(n, left[s], size - offset)
            left[s] -= n
            deficit[s] = deficit.get(s, 0.0) - n
            q, place = queues[s], at[s]
            while n > 0:
                doc, ids = q[place[0]]
                k = min(n, ids - place[1])
                if k:
                    yield doc, place[1], k, seq, offset
                offset += k
                n -= k
                place[1] += k
                if place[1] == ids:
                    place[0], place[1] = place[0] + 1, 0

        live = [s for s in order if left[s]]
        for s in live:
            deficit[s] = deficit.get(s, 0.0) + size * share.get(s, 0.0)
        for s in live[seq % len(live) :] + live[: seq % len(live)]:
            if offset < size and deficit[s] >= min(least, left[s]):
                yield from send(s, int(deficit[s]))
        while offset < size:
            s = max((s for s in live if left[s]), key=lambda s: (deficit[s], s))
            yield from send(s, max(least, int(deficit[s])))


_PIECES = pa.schema([(c, pa.int64()) for c in ("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("source", pa.string())])


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, end_id: int = 1, targets: dict[str, float] | None = None, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    targets: share by source; by default each source's share of all ids. Null text is as empty (the end id alone);
    null sources are one source of their own; null keys and repeated rows are packed as any others. An empty table
    gives no pieces; other columns, whatever their names, change nothing. Documents are dealt to partitions by a hash
    of key and place, so that each has about the mix of the whole, encoded there once and kept in token files in the
    shared folder; sequence ids count through all partitions without gaps. Very long texts are encoded whole and cut.
    """
    spark = docs.sparkSession
    path, folder = tokenizer or default_path(), shared_dir(spark, "packing")
    end = struct.pack("<I", end_id)
    # rows' places are part of the hash, 64 at a time: rows of one key are dealt to all partitions, and the parts of a document stay together
    source_docs = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), docs[source].cast("string").alias("source"))
    dealt = source_docs.repartition(F.xxhash64("key", F.shiftright(F.monotonically_increasing_id(), 6)))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        at = f"{folder}/part-{part:06d}-{TaskContext.get().taskAttemptId()}.tok"
        totals: dict[str | None, int] = {}
        sources: list[str | None] = []

        def encoded():
            for b in parts:
                for k, t, s in zip(b.column("key").to_pylist(), raw(b.column("text")), b.column("source").to_pylist()):
                    ids = enc.ids(t.decode("utf-8", "replace")) + end
                    totals[s] = totals.get(s, 0) + len(ids) // 4
                    sources.append(s)
                    yield k, ids

        write_file(at, encode_file(encoded()))
        names = list(totals)
        place = {s: i for i, s in enumerate(names)}
        which = b"".join(struct.pack("<I", place[s]) for s in sources)
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(names), pa.int64()), pa.array([at] * len(names)), pa.array(names, pa.string()), pa.array([totals[s] for s in names], pa.int64()), pa.array(range(len(names)), pa.int64()), pa.array([which] + [None] * (len(names) - 1), pa.binary())],
                names=["bin", "path", "source", "ids", "place", "which"],
            )

    files = materialise(dealt.mapInArrow(calm(write, keep_tokens=True), "bin long, path string, source string, ids long, place long, which binary"), "packing-files", folder)

    # one row for each bin and source; none for a document
    whole = files.agg(F.sum("ids")).first()[0] or 0
    if targets is None:
        share = files.groupBy(F.col("source").alias("of")).agg((F.sum("ids") / F.lit(max(1, whole))).alias("share"))
    else:
        share = spark.createDataFrame([(s, float(x)) for s, x in targets.items()] or [("", 0.0)], "of string, share double")
    bins = files.groupBy("bin").agg(F.sum("ids").alias("total"))
    n_windows = F.expr(f"total div {width} + bit_count(total % {width})")
    in_order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("total").over(in_order), F.lit(0)).alias("before"), F.coalesce(F.sum(n_windows).over(in_order), F.lit(0)).alias("first"))
    sent = F.coalesce(F.sum("ids").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = (
        files.select("bin", "path", "source", "ids", "place", "which", sent.alias("sent"))
        .join(bins, "bin")
        .join(F.broadcast(share) if targets is not None else share, F.col("source").eqNullSafe(F.col("of")), "left")
        .select("bin", "path", "source", "place", "which", "first", F.coalesce("share", F.lit(0.0)).alias("share"), (F.col("before") * F.coalesce("share", F.lit(0.0)) - F.col("sent")).alias("deficit"))
    )
    plans = state.groupBy("bin").agg(F.max("path").alias("path"), F.max("first").cast("long").alias("first"), F.max("which").alias("which"), F.sort_array(F.collect_list(F.struct("place", "source", "share", "deficit"))).alias("sources"))

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for at, first, which, sources in zip(*(b.column(c).to_pylist() for c in ("path", "first", "which", "sources"))):
                    names = [x["source"] for x in sources]
                    tag = [f"={s}" if s is not None else "-" for s in names]
                    of = struct.unpack(f"<{len(which) // 4}I", which)
                    file, queues = TokenFile(at), {t: [] for t in tag}
                    for i, (_, n) in enumerate(file.docs):
                        queues[tag[of[i]]].append((i, n))
                    share = {t: x["share"] for t, x in zip(tag, sources)}
                    # lengths suffice to pack; ids are then read once, a document at a time
                    cuts = [array("q") for _ in file.docs]
                    for i, *piece in pack(queues, share, {t: x["deficit"] for t, x in zip(tag, sources)}, width, least):
                        cuts[i].extend(piece)
                    for i, (key, _, ids) in enumerate(file.read()):
                        c = cuts[i]
                        for start, n, seq, offset in zip(c[::4], c[1::4], c[2::4], c[3::4]):
                            yield key, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, first + seq, offset, names[of[i]]

        yield from batches(rows(), _PIECES, 5000)

    n = max(1, spark.sparkContext.defaultParallelism) * 4
    return plans.select("path", "first", "which", "sources").repartition(n).mapInArrow(calm(fill), "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
