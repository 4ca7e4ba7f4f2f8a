"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within an even radius r have a value within r / 2 of both. So each distinct fingerprint emits all
values within r / 2 of itself, the values are shuffled, and fingerprints that share a value are links after
verification. Fingerprints that share a value are within r of each other all together, so the links from a
value's smallest fingerprint to the others join what all its pairs join, without their square.
Texts are read in parts, so that memory holds counts or eight bytes a shingle, never a text's list of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import calm, key_text, materialise, raw, word_chunks
from .components import connected_components

SEED = 42
#: byte -> eight counters of a byte each, one for each of its bits
_SPREAD = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.uint8).reshape(-1).view("<u8")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in unsigned hashes, lowest bit first."""
    lanes = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    out = np.zeros(64, dtype=np.int64)
    for i in range(0, len(lanes), 255 * 256):
        part = lanes[i : i + 255 * 256]
        # 255 ones fill a byte at most
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        out += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return out


def shingle_blocks(text: bytes, k: int) -> Iterator[np.ndarray]:
    """The hashes of all k-word shingles of the whole text, A-Z lowered, a part of the text at a time.

    Fewer words than k: the whole sequence is the one shingle; no words: nothing.
    """
    digest, last, n = xxhash.xxh64_intdigest, [], 0
    for chunk in word_chunks(text):
        words = chunk.translate(_LOWER).split()
        n += len(words)
        last += words
        if len(last) >= k:
            yield np.array([digest(b" ".join(x), SEED) for x in zip(*(last[i:] for i in range(k)))], dtype=np.uint64)
            last = last[len(last) - k + 1 :]
    if 0 < n < k:
        yield np.array([digest(b" ".join(last), SEED)], dtype=np.uint64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    blocks = list(shingle_blocks(text, k))
    return np.concatenate(blocks) if blocks else np.array([], dtype=np.uint64)


def simhash(blocks: Iterable[np.ndarray]) -> int:
    """Bit i is 1 if over half of all hashes in the blocks have it; 0 without hashes."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        counts += bit_counts(h)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """key, fp (the 64 bits as a signed long) of each row: A-Z lowered, words between ASCII space, k-word shingles, repeats included.

    Fewer words than k: the whole sequence is the one shingle. No words, or null text: fingerprint zero. Very long
    texts are counted part by part. Each row gives one row, repeated ones too; an empty table gives none; other
    columns, whatever their names, change nothing.
    """

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fps = np.array([simhash(shingle_blocks(t, k)) for t in raw(b.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(fps)], names=["key", "fp"])

    return key_text(docs, key, text).mapInArrow(calm(make), "key long, fp long")


def masks(bits: int, radius: int) -> list[int]:
    """All values of `bits` bits with at most radius bits set, as signed longs."""
    out = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def ball_links(fps: DataFrame, fp: str = "fp", bits: int = 64, radius: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints within an even radius, verified; their components are those of all such pairs.

    Repeated fingerprints count once. A value has at most as many fingerprints as a ball has values, 65 here, so no
    group grows with the input. An empty table gives no links.
    """
    if radius % 2:
        raise ValueError("the radius must be even: halves of an odd one don't bound a value's pairs by it")
    flips = F.array(*(F.lit(m) for m in masks(bits, radius // 2)))
    emitted = fps.select(F.col(fp).alias("fp")).distinct().select("fp", F.posexplode(flips).alias("i", "mask")).select(F.expr("fp ^ mask").alias("value"), "i")
    # the shuffle carries the mask's number, a byte once compressed; the fingerprint follows from it
    emitted = emitted.repartition("value").select("value", F.col("value").bitwiseXOR(flips[F.col("i")]).alias("fp"))
    first = emitted.withColumn("a", F.min("fp").over(Window.partitionBy("value")))
    met = first.filter("a != fp").select("a", F.col("fp").alias("b"))
    return met.filter(F.bit_count(F.expr("a ^ b")) <= radius).distinct()


def fingerprint_groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """key, fp, component_id of each row of prints (key, fp): the smallest key that links between fingerprints reach.

    Rows of equal fingerprints, fingerprint zero too, are one node whatever their number; nothing is emitted for
    their pairs.
    """
    nodes = prints.groupBy("fp").agg(F.min("key").alias("least"))
    roots = connected_components(ball_links(nodes, "fp", 64, radius)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("key", "fp", "component_id")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """Per row of docs: key, fp, component_id (the smallest key that links reach, the row's own included; null keys are ignored where another is).

    Repeated rows and rows of equal fingerprints are in one component. An empty table gives no rows. Texts, nulls and
    other columns: as in fingerprints().
    """
    return fingerprint_groups(materialise(fingerprints(docs, key, text, k), "simhash"), radius)


# --- similarity of five-word shingles, for the pipeline -----------------------------------------------------------

#: Bands of MinHashes: a pair of similarity s shares a band's value with probability s^BAND_HASHES, for any kind of edit.
BANDS, BAND_HASHES = 32, 6
#: Rows of a block whose pairs one task compares, their shingles together, and columns of the matrices it multiplies.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 4 << 20, 2048


def band_values(hashes: np.ndarray, bands: int = BANDS, size: int = BAND_HASHES) -> np.ndarray:
    """A signed long for each band: the hash of the `size` smallest values that as many hash functions take on distinct hashes."""
    n = bands * size
    draw = np.random.default_rng(SEED)
    factor, add = (draw.integers(0, 1 << 64, (n, 1), dtype=np.uint64) for _ in range(2))
    factor |= np.uint64(1)
    least = np.full(n, np.uint64((1 << 64) - 1))
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, i : i + 2048] * factor + add).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED + i) for i, x in enumerate(least.reshape(bands, size))], dtype=np.uint64).view(np.int64)


def _banded(docs: DataFrame, k: int, bands: int, size: int) -> DataFrame:
    """row, fp (SimHash of the k-word shingles), n (distinct shingles), values (of the bands); rows without words have none."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows, fps, sizes, values = [], [], [], []
            for r, t in zip(b.column("row").to_pylist(), raw(b.column("text"))):
                every = shingle_hashes(t, k)
                if len(every):
                    h = np.unique(every)
                    rows.append(r)
                    fps.append(simhash([every]))
                    sizes.append(len(h))
                    values.append(band_values(h, bands, size))
            flat = pa.array(np.concatenate(values) if values else np.array([], dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * bands, pa.int32()), flat)
            made = [pa.array(rows, pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(made, names=["row", "fp", "n", "values"])

    return docs.select("row", "text").mapInArrow(calm(make), "row long, fp long, n long, values array<long>")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """row, set: the distinct 64-bit hashes of the k-word shingles of each whole text, ascending, as bytes."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([np.unique(shingle_hashes(t, k)).tobytes() for t in raw(b.column("text"))], pa.binary())], names=["row", "set"])

    return texts.mapInArrow(calm(make), "row long, set binary")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Common elements of each of the sets x and each of y (or of x again): a product of incidence matrices, some columns at a time."""
    every = x if y is None else x + y
    which = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    which, column = which[shared], column[shared]
    order = np.argsort(column, kind="stable")
    which, column = which[order], np.cumsum(np.diff(column[order], prepend=-1) > 0) - 1
    out = np.zeros((len(x), len(y or x)), dtype=np.float64)
    ends = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for first, lo, hi in zip(range(0, len(ends) * COLUMNS, COLUMNS), ends, ends[1:]):
        dense = np.zeros((len(every), COLUMNS), dtype=np.float32)
        dense[which[lo:hi], column[lo:hi] - first] = 1
        out += dense[: len(x)] @ dense[0 if y is None else len(x) :].T
    return out


def _like(x: list[np.ndarray], y: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    both = _overlaps(x, y)
    total = np.add.outer([float(len(s)) for s in x], [float(len(s)) for s in y or x])
    return both >= similarity * (total - both) - 1e-9


def spanning_links(rows: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what all pairs of the similarity join, no more than rows less one."""
    near = _like(sets, None, similarity)
    free, out = np.ones(len(rows), dtype=bool), []
    for i in range(len(rows)):
        stack = [i] if free[i] else []
        free[i] = False
        while stack:
            a = stack.pop()
            met = np.flatnonzero(near[a] & free)
            free[met] = False
            out += [(rows[a], rows[b]) for b in met]
            stack += met.tolist()
    return out


def _grouped(parts: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the columns names: (their values, the rows' other columns)."""
    last, held = None, []
    for p in parts:
        others = [c for c in p.schema.names if c not in names]
        for at, row in zip(zip(*(p.column(c).to_pylist() for c in names)), zip(*(p.column(c).to_pylist() for c in others))):
            if at != last:
                if held:
                    yield last, held
                last, held = at, []
            held.append(row)
    if held:
        yield last, held


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _block_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links within each block of a value. rows: value, block, row."""

    def links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(parts, ("value", "block")):
            held.sort(key=lambda r: r[0])
            found = spanning_links([r for r, _ in held], [_numbers(s) for _, s in held], similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = rows.join(sets, "row").select("value", "block", "row", "set").repartition("value", "block").sortWithinPartitions("value", "block")
    return dealt.mapInArrow(calm(links), "a long, b long")


def deal_outer(rows: DataFrame, data: DataFrame) -> DataFrame:
    """Rows of a value outside its largest component, each with a part of all rows of the value after it, in partitions ordered by value and part.

    rows: of outer_rows(); data: row and what is compared.
    """
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hashed = lambda n: F.pmod(F.xxhash64("row", F.lit(2)), F.col(n))
    out = rows.filter("comp != main").select("value", spread("blocks").alias("block"), hashed("copies").alias("outer"), F.lit(True).alias("held"), "row", "comp", "n")
    all_rows = rows.select("value", hashed("blocks").alias("block"), spread("copies").alias("outer"), F.lit(False).alias("held"), "row", "comp", "n")
    return out.union(all_rows).join(data, "row").repartition("value", "block", "outer").sortWithinPartitions("value", "block", "outer", F.col("held").desc())


def outer_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between the rows of a value outside its largest component and all its others. rows: value, row, comp, main (the largest component), copies, blocks."""

    def links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, comps, at = [], {}, None
        for p in parts:
            cols = [p.column(c).to_pylist() for c in ("value", "block", "outer", "held", "row", "comp", "set")]
            found, batch = [], []

            def compare():
                if held and batch:
                    near = _like([_numbers(s) for _, _, s in batch], [_numbers(s) for _, _, s in held], similarity)
                    for i, j in np.argwhere(near):
                        (a, ca, _), (b, cb, _) = batch[i], held[j]
                        while ca in comps:
                            ca = comps[ca]
                        while cb in comps:
                            cb = comps[cb]
                        if ca != cb:
                            comps[max(ca, cb)] = min(ca, cb)
                            found.append((a, b))
                batch.clear()

            for value, block, outer, is_held, row, comp, data in zip(*cols):
                if (value, block, outer) != at:
                    compare()
                    held, comps, at = [], {}, (value, block, outer)
                (held if is_held else batch).append((row, comp, data))
            compare()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return deal_outer(rows, sets).select("value", "block", "outer", "held", "row", "comp", "set").mapInArrow(calm(links), "a long, b long")


def _blocks(m: Column, n: Column) -> Column:
    """Blocks of bounded size for m rows with n shingles together."""
    return F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(n / BLOCK_SHINGLES)).cast("long")


def _distinct_values(members: DataFrame, *keep: Column) -> DataFrame:
    """value and the kept aggregates, of one of the values that have the same rows; members: value, row, n."""
    mark = [F.count("*").alias("m"), F.sum("n").alias("n"), *(F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"x{i}") for i in (0, 1))]
    per = members.groupBy("value").agg(*mark, *keep).filter("m > 1")
    others = [c for c in per.columns if c not in ("m", "x0", "x1")]
    return per.groupBy("m", "x0", "x1").agg(F.min_by(F.struct(*others), "value").alias("of")).select("m", "of.*")


def outer_rows(members: DataFrame) -> DataFrame:
    """What outer_links() takes, of members: value, row, n, comp. Values whose rows are in one component are left out, and of values with the same rows all but one."""
    several = _distinct_values(members, F.min("comp").alias("least"), F.max("comp").alias("last")).filter("least != last").select("value")
    rows = materialise(members.join(several, "value", "left_semi"), "similar-rest")
    sizes = rows.groupBy("value", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    main = sizes.groupBy("value").agg(F.max(F.struct("m", "comp", "n")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    main = main.select("value", F.col("top.comp").alias("main"), _blocks(F.col("m"), F.col("n")).alias("blocks"), _blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("copies"))
    return materialise(rows.join(main, "value").select("value", "row", "n", "comp", "main", "copies", "blocks"), "similar-outer")


def value_groups(members: DataFrame, src: DataFrame, k: int, similarity: float) -> DataFrame:
    """row, root: the components of all pairs of rows that share a value and have the similarity of their k-word shingles.

    members: value, row, n (the row's shingles, distinct); src: row, text. Only texts of rows that share a value are read.
    """
    rows = _value_rows(members)
    # written first: Spark then knows their size, and shuffles the texts only where they are too many to broadcast
    wanted = materialise(rows.select("row").distinct(), "similar-wanted")
    return _row_groups(rows, materialise(shingle_sets(src.join(wanted, "row", "left_semi"), k), "similar-sets"), similarity)


def set_groups(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """As value_groups(), of a written table of row, set (the rows that share a value at least)."""
    return _row_groups(_value_rows(members), sets, similarity)


def _value_rows(members: DataFrame) -> DataFrame:
    """value, row, n, blocks (its value's blocks of bounded size) of members; of values with the same rows one counts."""
    groups = _distinct_values(members).select("value", _blocks(F.col("m"), F.col("n")).alias("blocks"))
    return materialise(members.join(groups, "value").select("value", "row", "n", "blocks"), "similar-rows")


def _row_groups(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """row, root: the components of all pairs of rows that share a value and have the similarity. rows: of _value_rows(); sets: row, set.

    Rows of a value are dealt to blocks of bounded size, and a task compares all pairs of a block by a product of
    matrices: no pair is a row of a table, and no more links leave a block than join it. Where a value has several blocks, one row of each component
    is compared next, which leaves most rows in one large component; then all rows outside it are compared with every
    row of the value. So no pair of a value is left out but of rows that are in one component already.
    """
    links = materialise(_block_links(rows.select("value", F.pmod(F.xxhash64("row", F.lit(2)), "blocks").alias("block"), "row"), sets, similarity), "similar-links")
    large = materialise(rows.filter("blocks > 1"), "similar-large")
    roots = connected_components(links)
    if not large.isEmpty():

        def in_components() -> DataFrame:
            found = roots.select(F.col("node").alias("row"), "root")
            return large.join(found, "row", "left").select("value", "row", "n", F.coalesce("root", "row").alias("comp"))

        firsts = in_components().groupBy("value", "comp").agg(F.min_by(F.struct("row", "n"), "row").alias("r")).select("value", "r.*")
        firsts = materialise(firsts, "similar-firsts")
        count = firsts.groupBy("value").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
        firsts = firsts.join(count, "value").select("value", F.pmod(F.xxhash64("row", F.lit(3)), "blocks").alias("block"), "row")
        links = links.union(materialise(_block_links(firsts, sets, similarity), "similar-links"))
        roots = connected_components(links)
        links = links.union(materialise(outer_links(outer_rows(in_components()), sets, similarity), "similar-links"))
        roots = connected_components(links)
    return roots.select(F.col("node").alias("row"), "root")


def similar_groups(docs: DataFrame, row: str, text: str, k: int = 5, similarity: float = 0.8, bands: int = BANDS, size: int = BAND_HASHES, radius: int = 2) -> DataFrame:
    """row, root: groups of rows joined by pairs whose sets of k-word shingles have at least this Jaccard similarity.

    Candidates are rows whose fingerprints fall into one group by ball hashing (fingerprint_groups), and pairs that
    share a value of one of `bands` bands of `size` MinHashes of the same shingles, for what differs by more bits: a
    pair at similarity s is missed by these with probability (1 - s^size)^bands, below 0.0001 at 0.8, wherever the
    texts differ. The similarity of candidates is then computed from the shingles of both whole texts. row must be a unique long; rows
    in no pair are not returned, and so are rows without words and null texts. Repeated texts are similar. Texts of
    fewer than k words are compared by their whole word sequence. Very long texts take eight bytes a shingle. An
    empty table gives no rows; other columns, whatever their names, change nothing.
    """
    src = docs.select(docs[row].cast("long").alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    banded = materialise(_banded(src, k, bands, size), "similar")
    groups = fingerprint_groups(banded.select(F.col("row").alias("key"), "fp"), radius).select(F.col("key").alias("row"), F.xxhash64("component_id").alias("value"))
    balls = groups.join(banded.select("row", "n"), "row").select("value", "row", "n")
    members = banded.select(F.explode("values").alias("value"), "row", "n").union(balls)
    return value_groups(members, src, k, similarity)
