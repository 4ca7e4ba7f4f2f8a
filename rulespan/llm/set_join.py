"""Join of documents whose sets of word shingles have at least a Jaccard similarity, by universe-partition pigeonhole.

Sizes fall into bands. The universe of shingles is hashed into a number of segments that is fixed for a band, and a set
is cut into its segments' subsets. Sets of a pair differ in at most h elements (h follows from their sizes), so among any
h + 1 segments one has equal subsets; with deletions, among any ceil((h + 1) / 2) segments one differs by a single element
at most, and then one subset, less one of its elements, is the other. A set is indexed in its own band, and also in a
band below that has partners of it.

Per band the cheaper of the allocations is taken, by the number of its sets and of their elements: subsets with s spare
segments, or whole subsets and their one-deletion neighbourhoods. Spare segments buy selectivity: a pair shares s + 1 subsets
at least, so each set may leave out its s most frequent ones (one global order for all: rarest first, empty subsets
last) and the pair still meets in another. Subsets that no other set has are counted among the rarest, so most sets have
nothing left to join. What meets is verified from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import calm, key_text, materialise, raw, word_chunks
from .components import connected_components
from .simhash import deal_outer, outer_links, outer_rows, set_groups

#: Bands begin at these multiples of each other; less than 1 / similarity would have a set visit more than one band below.
RATIO = 1.5
#: Sets that a task remembers, so that it gives the signatures of copies once.
REMEMBERED = 1 << 18
#: Bits of the filter that texts pass before they are joined to those that are wanted.
FILTER_BITS = 1 << 23
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, well mixed (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """The ordered distinct 64-bit hashes of the k-word shingles of the whole text, A-Z lowered, a part of it at a time.

    A shingle's hash is that of the sum of its words' hashes, each times a factor of its place. Fewer words than k: the
    whole sequence is the one shingle; no words: none.
    """
    found, last = [], np.empty(0, np.uint64)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for chunk in word_chunks(text):
        new = chunk.translate(_LOWER).split()
        last = np.r_[last, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))]
        n = len(last) - k + 1
        if n > 0:
            h = last[:n] * factors[0]
            for i in range(1, k):
                h += last[i : n + i] * factors[i]
            found.append(mixed(h))
            last = last[n:]
    if not found and len(last):
        found.append(mixed((last * factors[: len(last)]).sum(keepdims=True)))
    return np.unique(np.concatenate(found)) if found else last


class Sizes:
    """What sizes say at a similarity of percent / 100: bands, and in how many elements partners may differ."""

    def __init__(self, percent: int) -> None:
        if not RATIO > 100 / percent:
            raise ValueError(f"a similarity over {100 / RATIO:.0f} percent is needed")
        self.percent = percent
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * RATIO)))

    def differ(self, a: int, b: int) -> int:
        """Elements in which sets of these sizes differ at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def most(self, band: int) -> int:
        """The largest size in a band."""
        return self.starts[band + 1] - 1

    def parts(self, n: int) -> list[tuple[int, int]]:
        """(band, elements in which the set may differ from a partner met there): its own band, for partners no smaller or in it, and the one below."""
        own = self.band(n)
        out = [(own, self.differ(n, n * 100 // self.percent))]
        if own and self.most(own - 1) * 100 >= n * self.percent:
            out.append((own - 1, self.differ(n, self.most(own - 1))))
        return out

    def widest(self, band: int) -> int:
        """The largest such number in a band."""
        top = self.most(band)
        return self.differ(top, top * 100 // self.percent)


def tail(mean: float, more_than: int) -> float:
    """Probability that a Poisson number exceeds more_than."""
    if mean > 500 or more_than > mean + 40 * (mean + 1) ** 0.5:  # near enough, and sums would not end or begin at 0
        return float(more_than < mean + 8 * mean**0.5)
    term, total = exp(-mean), 0.0
    for i in range(more_than + 1):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1.0 - total)


def allocate(sizes: Sizes, band: int, sets: int, elements: int) -> tuple[bool, int]:
    """(one-deletion neighbourhoods?, spare segments) of a band with so many sets and elements: what costs least rows.

    A set costs its emitted rows, and all sets of the band if more of its segments are empty than it may leave out.
    """
    n, widest = max(1.0, elements / max(1, sets)), sizes.widest(band)
    own = sizes.differ(int(n), int(n) * 100 // sizes.percent)
    empty = lambda segments: exp(-n / segments)

    def plain(spare: int) -> float:
        emitted = own + 1 + spare
        return emitted + sets * tail(emitted * empty(widest + 1 + spare), spare)

    halves, used = (widest + 2) // 2, (own + 2) // 2
    deleted = used * (1 + n / halves) + sets * used * empty(halves)
    options = [(plain(s), False, s) for s in sorted({round((widest + 1) * x) for x in (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0)} | {0, 1, 2})]
    _, deletes, spare = min([*options, (deleted, True, 0)])
    return deletes, spare


def subsets(hashes: np.ndarray, band: int, segments: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `wanted` segments of a set of hashes, but empty ones: (number, value of its subset), and each element's (segment, value) as rows of one array."""
    value = mixed(hashes + np.uint64(band))
    # the upper half of the value chooses the segment; a subset's value is the sum of its elements'
    segment = ((value >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    if wanted < segments:
        keep = segment < np.uint64(wanted)
        segment, value = segment[keep], value[keep]
    order = np.argsort(segment.astype(np.uint16) if segments < 1 << 16 else segment, kind="stable")
    segment, value = segment[order], value[order]
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]][: len(segment)])
    sums = np.add.reduceat(value, first) if len(first) else value
    return segment[first], sums, np.stack([segment, value])


def named(segment: np.ndarray, value: np.ndarray, band: int) -> np.ndarray:
    """A signed 64-bit name of a subset in a segment of a band."""
    return mixed(value + segment * _M2 + np.uint64((band + 1) * int(_M1) % (1 << 64))).view(np.int64)


def signatures(hashes: np.ndarray, sizes: Sizes, plans: dict[int, tuple[bool, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(values, whether each is a whole subset, 2 x what may be left out + 1 if below its band) of a set in each of its bands.

    With spare segments, `wanted` are used and those that are empty count as left out first; where too few are not empty,
    the empty ones are values too. With deletions nothing may be left out.
    """
    for nth, (band, h) in enumerate(sizes.parts(len(hashes))):
        if not h or band not in plans:
            continue
        deletes, spare = plans[band]
        segments = (sizes.widest(band) + 2) // 2 if deletes else sizes.widest(band) + 1 + spare
        wanted = (h + 2) // 2 if deletes else h + 1 + spare
        segment, sums, each = subsets(hashes, band, segments, wanted)
        left = len(segment) - (h + 1)
        if deletes or left < 0:
            none = np.setdiff1d(np.arange(wanted, dtype=np.uint64), segment)
            segment, sums = np.r_[segment, none], np.r_[sums, np.zeros(len(none), np.uint64)]
        values, whole = named(segment, sums, band), np.ones(len(segment), dtype=bool)
        if deletes:
            less = np.zeros(wanted, np.uint64)
            less[segment.astype(np.int64)] = sums
            values = np.r_[values, named(each[0], less[each[0].astype(np.int64)] - each[1], band)]
            whole = np.r_[whole, np.zeros(each.shape[1], dtype=bool)]
        yield values, whole, 2 * (0 if deletes else max(0, left)) + nth


def set_names(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, n (distinct k-word shingles), name and second (two 64-bit hashes of the set), body (hash of the text) of each row."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            n, names = [], []
            for t in raw(b.column("text")):
                h = shingles(t, k)
                d = xxhash.xxh3_128_digest(h.tobytes())
                n.append(len(h))
                names.append(d)
            both = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), b.column("body")], names=["key", "n", "name", "second", "body"])

    src = key_text(docs, key, text)
    return src.withColumn("body", F.xxhash64("text")).mapInArrow(calm(make), "key long, n long, name long, second long, body long")


def signature_rows(docs: DataFrame, key: str, text: str, k: int, sizes: Sizes, plans: dict[int, tuple[bool, int]]) -> DataFrame:
    """value, name, whole, spare: the signatures of each task's distinct sets."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in parts:
            held: list[tuple] = []
            size = 0
            for t in raw(b.column("text")):
                h = shingles(t, k)
                both = xxhash.xxh3_128_digest(h.tobytes())
                if both in seen:
                    continue
                # only saves rows: a set that is forgotten gives its rows again, which change nothing
                if len(seen) < REMEMBERED:
                    seen.add(both)
                name = int.from_bytes(both[:8], "little", signed=True)
                for values, whole, spare in signatures(h, sizes, plans):
                    held.append((values, np.full(len(values), name), whole, np.full(len(values), spare)))
                    size += len(values)
                if size > 1 << 17:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return key_text(docs, key, text).select("text").mapInArrow(calm(make), "value long, name long, whole boolean, spare int")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    value, name, whole, spare = (np.concatenate(c) for c in zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(value), pa.array(name), pa.array(whole), pa.array(spare.astype(np.int32))], names=["value", "name", "whole", "spare"])


def candidates(rows: DataFrame) -> DataFrame:
    """value, name, n_sets: the signatures that a set keeps after its most frequent ones are left out. rows: of signature_rows()."""
    over = Window.partitionBy("value")
    shared = rows.withColumn("n_sets", F.count("*").over(over)).withColumn("least", F.min("name").over(over)).withColumn("last", F.max("name").over(over)).withColumn("any", F.max("whole").over(over))
    shared = shared.filter("least != last AND any").select("value", "name", "spare", "n_sets").distinct()
    # unique ones are the rarest, so what a set leaves out is among these
    place = F.row_number().over(Window.partitionBy("name", "spare").orderBy(F.col("n_sets").desc(), "value"))
    return shared.withColumn("place", place).filter(F.col("place") > F.expr("spare div 2")).select("value", "name", "n_sets").distinct()


def shingle_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: key, n (distinct k-word shingles), component_id (the smallest key that links reach, the row's own included).

    A-Z are lowered, words stand between ASCII space; fewer words than k: the whole sequence is the one shingle. Rows link
    when 100 x intersection >= percent x union of their sets. No words, or null text: the empty set, linked with
    nothing, component_id the row's own key. Rows of equal sets are one node whatever their number. Null keys are
    ignored where a component has another; repeated rows are rows; very long texts take eight bytes a shingle; an
    empty table gives no rows; other columns, whatever their names, change nothing.

    Shingles count as equal if their 64-bit hashes are, sets if their 128-bit hashes are. Signatures name a set by 64 of
    those bits; two sets of one such name are compared with all that either meets, though not with each other. What is
    sent to the driver is a row a size band, under a hundred, and a broadcast filter of FILTER_BITS bits.
    """
    sizes = Sizes(percent)
    rows = materialise(set_names(docs, key, text, k), "set-names")
    first = F.min(F.struct("key", "body")).alias("first")
    nodes = materialise(rows.filter("n > 0").groupBy("name", "second").agg(F.max("n").alias("n"), F.min("key").alias("least"), first).select("name", "second", "n", "least", "first.*", F.monotonically_increasing_id().alias("row")), "set-nodes")
    starts = F.array(*(F.lit(s) for s in sizes.starts))
    per = nodes.groupBy((F.size(F.filter(starts, lambda s: s <= F.col("n"))) - 1).alias("band")).agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    plans = {r.band: allocate(sizes, r.band, r.sets, r.elements) for r in per.collect()}

    found = materialise(candidates(signature_rows(docs, key, text, k, sizes, plans)), "set-candidates")
    met = materialise(found.join(nodes.select("name", "row", "n"), "name").select("value", "row", "n", "n_sets"), "set-members")
    links = similar_members(met, _sets(docs, key, text, k, nodes.join(met.select("row").distinct(), "row", "left_semi")), percent)
    roots = connected_components(links).select(F.col("node").alias("row"), "root")
    rooted = nodes.join(roots, "row", "left").select("name", "second", "least", F.coalesce("root", "row").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("name", "second", "component_id")
    return rows.join(classes, ["name", "second"], "left").select("key", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap of at least two bits an element, whose bits say whether an odd number of elements falls there.

    Bitmaps differ in no more bits than their sets in elements; halves of a bitmap XORed are the one of half the size.
    """
    bits = 1 << max(6, int(2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Rows of 64-bit words, all folded to `size` bytes."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0) for x in bitmaps])


def _may_hold(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose column of 64-bit hashes may be among the wanted ones: a bit of FILTER_BITS for each, broadcast in words of 64.

    Its size is fixed. Where so many are wanted that most bits are set, it only leaves out fewer rows.
    """
    bits = wanted.select(_word(column).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    met = rows.withColumn("word", _word(column)).join(F.broadcast(bits), "word")
    return met.filter(F.expr(f"bits & shiftleft(1L, cast(pmod({column}, 64) as int)) != 0")).select(*rows.columns)


def _word(column: str) -> Column:
    return F.expr(f"pmod({column}, {FILTER_BITS}L) div 64")


def _sets(docs: DataFrame, key: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """row, set (hashes as bytes), bitmap (its parity()) of the wanted nodes, from a row of docs that has each."""
    wanted = materialise(wanted.select("name", "second", "row", F.col("key").alias("of"), F.col("body").alias("from")), "set-wanted")
    src = key_text(docs, key, text).withColumn("body", F.xxhash64("text"))
    src = _may_hold(src, "body", wanted.select(F.col("from").alias("body")))  # before texts are shuffled
    src = src.join(wanted, src["key"].eqNullSafe(F.col("of")) & (src["body"] == F.col("from"))).select("row", "name", "second", "text")

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            found = [shingles(t, k) for t in raw(b.column("text"))]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in found), dtype="<i8").reshape(-1, 2)
            same = pa.array((both[:, 0] == b.column("name").to_numpy()) & (both[:, 1] == b.column("second").to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([h.tobytes() for h in found], pa.binary()), pa.array(map(parity, found), pa.binary())], names=["row", "set", "bitmap"]).filter(same)

    sets = materialise(src.mapInArrow(calm(make), "row long, set binary, bitmap binary"), "set-sets")
    again = sets.groupBy("row").agg(F.count("*").alias("m")).filter("m > 1")  # rows of docs that are wholly equal
    return sets if again.isEmpty() else materialise(sets.dropDuplicates(["row"]), "set-sets")


def likely(outer: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join what all pairs of rows do that share a value, are in different components and that the bitmaps don't tell apart. outer: of outer_rows()."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, root, at = [], {}, None
        for p in parts:
            found, batch = [], []

            def top(row: int) -> int:
                while (up := root.setdefault(row, row)) != row:
                    root[row] = row = root.setdefault(up, up)
                return row

            def compare() -> None:
                if not held or not batch:
                    return
                size = min(len(x[-1]) for x in held + batch)
                a, b = folded([x[-1] for x in batch], size), folded([x[-1] for x in held], size)
                n, m = (np.array([x[2] for x in y]) for y in (batch, held))
                most = (n[:, None] + m[None, :]) * (100 - percent) // (100 + percent)
                apart = np.array([x[1] for x in batch])[:, None] != np.array([x[1] for x in held])[None, :]
                for i in np.flatnonzero(apart.any(axis=1)):
                    for j in np.flatnonzero(apart[i] & (np.bitwise_count(a[i] ^ b).sum(axis=1, dtype=np.int64) <= most[i])):
                        x, y = batch[i][0], held[j][0]
                        if (p := top(x)) != (q := top(y)):
                            root[max(p, q)] = min(p, q)
                            found.append((x, y))
                batch.clear()

            for value, block, copy, is_held, row, comp, n, data in zip(*(p.column(c).to_pylist() for c in ("value", "block", "outer", "held", "row", "comp", "n", "bitmap"))):
                if (value, block, copy) != at:
                    compare()
                    held, root, at = [], {}, (value, block, copy)
                (held if is_held else batch).append((row, comp, n, data))
            compare()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return deal_outer(outer, bitmaps).mapInArrow(calm(find), "a long, b long")


def similar_members(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join what all similar pairs of rows that share a value join. members: value, row, n, n_sets; sets: of _sets().

    First each row is compared in its most frequent value only, which brings large groups of near copies together.
    Then, in every value, the rows outside its largest component meet all others of the value by bitmaps of two bits an
    element, which tell apart most of those that differ too much. What is left are groups of rows; a row is in one of
    them, so its set travels once, and in each group the rows outside its largest component are compared with all.
    """
    most = members.groupBy("row", "n").agg(F.max_by("value", F.struct("n_sets", "value")).alias("value"))
    roots = set_groups(most.select("value", "row", "n"), sets, percent / 100)
    first = materialise(roots.select(F.col("row").alias("a"), F.col("root").alias("b")), "set-links")
    comps = members.join(first.select(F.col("a").alias("row"), F.col("b").alias("comp")), "row", "left").select("value", "row", "n", F.coalesce("comp", "row").alias("comp"))
    rest = outer_rows(comps)
    groups = connected_components(likely(rest, sets.select("row", "bitmap"), percent)).select(F.col("node").alias("row"), F.col("root").alias("value"))
    rest = outer_rows(rest.select("row", "n", "comp").distinct().join(groups, "row").select("value", "row", "n", "comp"))
    return first.union(materialise(outer_links(rest, sets.select("row", "set"), percent / 100), "set-links"))
