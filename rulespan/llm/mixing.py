"""Mixing of sources to target weights by Sainte-Lague apportionment.

Blocks of one word go to sources by the highest quotients target / (2 a + 1), a being the blocks that a source has so
far, until the house is full: `share` of all words, or as many as all sources have at `repeats` each. Sources may be many, so a divisor near
the result gives nearly all blocks by sums over one row a source, and only the quotients around it are ranked. A source's
blocks are apportioned to groups of its own shards, and a group's to its shards, in the same way by their sizes.
A block is one word because sources may have fewer words than any larger block, and the runs that are taken need no blocks. In a shard its documents, in seeded order, form one run of words that is
cut into runs of equal size; whole rounds of all of them come first, the rest of the quota is a seeded choice, and the
last one chosen is cut where the quota ends. So every shard, and every source however thin, meets its quota exactly.
Rows are told apart by what they hold and, where several are equal, by their number among those, never by where they lie.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import calm, count_words, materialise, raw, word_chunks

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
#: Words of the runs that are chosen in a shard.
BLOCK = 64
SHARD_WORDS, SHARD_ROWS = 250_000, 5_000
#: Shards of a source that one task apportions blocks to.
GROUP = 4096
#: Divisors that one pass over the sources tries, and quotients beside a row a source that are ranked in the end.
DIVISORS, RANKED = 128, 1000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients weight / (2 a + 1), ties to the earlier; none above its most.

    A divisor near the result gives nearly all seats at once; a heap of quotients gives or takes the rest.
    """
    seats = min(seats, sum(m for m, w in zip(most, weights) if w > 0))
    given = lambda d: [min(m, int(w / d + 0.5)) if w > 0 else 0 for w, m in zip(weights, most)]
    lo, hi = 0.0, 4 * max([1.0, *weights])
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if mid and sum(given(mid)) >= seats else (lo, mid)
    out = given(hi)  # no more than the seats
    free = [(-w / (2 * a + 1), i) for i, (w, a) in enumerate(zip(weights, out)) if w > 0 and a < most[i]]
    heapq.heapify(free)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(free)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(free, (-weights[i] / (2 * out[i] + 1), i))
    return out


def chosen_blocks(words: int, quota: int, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a shard's runs, and how often each is taken: quota words in all."""
    n = max(1, round(words / BLOCK)) if words else 0
    bounds = np.arange(n + 1, dtype=np.int64) * words // max(n, 1)
    times = np.full(n, quota // max(words, 1), dtype=np.int64)
    rest = quota % words if words else 0
    if rest:
        rank = np.array([xxhash.xxh64_intdigest(f"{seed}/{i}") for i in range(n)], dtype=np.uint64)
        order = np.argsort(rank, kind="stable")
        ends = np.cumsum((bounds[1:] - bounds[:-1])[order])
        whole = int(np.searchsorted(ends, rest, "right"))
        times[order[:whole]] += 1
        if part := rest - (int(ends[whole - 1]) if whole else 0):
            at = int(order[whole])
            bounds = np.insert(bounds, at + 1, bounds[at] + part)
            times = np.insert(times, at, times[at] + 1)
    return bounds, times


def taken_spans(start: int, size: int, bounds: np.ndarray, times: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each time that words are taken, the spans of a document's words; the document has words start to start + size of the run."""
    if not size:
        return []
    a = int(np.searchsorted(bounds, start, "right")) - 1
    b = int(np.searchsorted(bounds, start + size, "left"))
    out: list[list[tuple[int, int]]] = []
    for j in range(a, b):
        lo, hi = max(start, int(bounds[j])) - start, min(start + size, int(bounds[j + 1])) - start
        if hi <= lo:
            continue
        for r in range(int(times[j])):
            if len(out) <= r:
                out.append([])
            if out[r] and out[r][-1][1] == lo:
                out[r][-1] = (out[r][-1][0], hi)
            else:
                out[r].append((lo, hi))
    return out


def cut_spans(text: bytes, spans: Sequence[tuple[int, int]], size: int) -> bytes:
    """The words of the spans, as they stand in the text, a line for each span; the whole text where that is one span."""
    if list(spans) == [(0, size)]:
        return text
    wanted = {x for s in spans for x in (s[0], s[1] - 1)}
    last = max(wanted, default=-1)
    place: dict[int, tuple[int, int]] = {}
    n = at = 0
    for chunk in word_chunks(text):
        if n > last:
            break
        here = len(chunk.split())
        if any(n <= x < n + here for x in wanted):
            for i, m in enumerate(_WORD.finditer(chunk), n):
                if i in wanted:
                    place[i] = (at + m.start(), at + m.end())
        n += here
        at += len(chunk)
    return b"\n".join(text[place[a][0] : place[b - 1][1]] for a, b in spans)


def with_sizes(docs: DataFrame, key: str, text: str, source: str, carry: Sequence[str] = ()) -> DataFrame:
    """key, source, tag (source, never null), size, hash of each row, and the columns in carry as c0, c1, ..., written.

    Equal rows (key, source, size and text) have hashes of their own, so that they don't all fall into one shard.
    """
    src = docs.select(docs[key].cast("long").alias("key"), docs[source].cast("string").alias("source"), docs[text].cast("string").alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))
    src = src.withColumn("body", F.xxhash64("text"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in parts:
            sizes = [0 if t is None else count_words(t) for t in raw(b.column("text"))]
            cols = {c: b.column(c) for c in b.schema.names if c != "text"}
            here = {"size": pa.array(sizes, pa.int64()), "task": pa.array([task] * len(sizes), pa.int64()), "serial": pa.array(range(n, n + len(sizes)), pa.int64())}
            n += len(sizes)
            yield pa.RecordBatch.from_pydict(cols | here)

    fields = [f for f in src.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", size long, task long, serial long"
    tag = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    sized = src.mapInArrow(calm(count), schema).withColumn("tag", tag).withColumn("hash", F.xxhash64("key", "source", "size", "body")).drop("body")
    sized = materialise(sized, "mix-rows")
    again = materialise(repeats_numbered(sized), "mix-repeats")
    if again.isEmpty():
        return sized.drop("task", "serial")
    told = sized.join(again, ["task", "serial"], "left")
    return materialise(told.withColumn("hash", F.coalesce(F.xxhash64("hash", "again"), "hash")).drop("task", "serial", "again"), "mix-rows")


def repeats_numbered(sized: DataFrame) -> DataFrame:
    """task, serial, again: the number from 0 of each row among those of its hash, for hashes of several rows.

    Rows of a hash are interchangeable, so it doesn't matter which one has which number. They are counted by task, and
    numbered within their task, so no task sees all rows of a hash.
    """
    many = sized.groupBy("hash").agg(F.count("*").alias("m")).filter("m > 1").select("hash")
    rows = sized.select("hash", "task", "serial").join(many, "hash", "left_semi")
    per = rows.groupBy("hash", "task").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("hash").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("hash", "task", F.coalesce(before, F.lit(0)).alias("before"))
    local = rows.withColumn("n", F.row_number().over(Window.partitionBy("hash", "task").orderBy("serial")) - 1)
    return local.join(per, ["hash", "task"]).select("task", "serial", (F.col("before") + F.col("n")).alias("again"))


def apportioned(targets: DataFrame, house: int) -> DataFrame:
    """tag, quota: `house` seats by the highest quotients target / (2 a + 1), ties to the earlier tag; none above its cap.

    targets: tag, target, cap. Each pass sums over the sources what DIVISORS divisors would give, and goes on between the
    two around the house; what lies between at last, a row a source and RANKED at most, is ranked. Only sums reach the driver.
    """
    targets = targets.filter("target > 0")
    size = targets.agg(F.count("*").alias("n"), F.max("target").alias("top"), F.sum("cap").alias("most")).first()
    if not size["n"]:
        return targets.select("tag", F.col("cap").alias("quota"))
    house = min(house, int(size["most"]))
    seats = lambda d: F.least(F.col("cap"), F.floor(F.col("target") / d + 0.5)).cast("long")
    low, high = size["top"] * 1e-30, size["top"] * 4  # all caps, and no seat at all
    over, under = int(size["most"]), 0
    for _ in range(60):
        if over - house <= 0 or over - under <= size["n"] + RANKED:
            break
        step = (high / low) ** (1 / (DIVISORS + 1))
        tried = [low * step**i for i in range(1, DIVISORS + 1)]
        sums = targets.agg(*(F.sum(seats(F.lit(d))).alias(str(i)) for i, d in enumerate(tried))).first()
        enough = [i for i, got in enumerate(sums) if got >= house]
        at = enough[-1] if enough else -1
        if at >= 0:
            low, over = tried[at], int(sums[at])
        if at + 1 < len(tried):
            high, under = tried[at + 1], int(sums[at + 1])
        if high / low < 1 + 1e-15:
            break
    base = targets.withColumn("base", seats(F.lit(high)) if under or over > house else seats(F.lit(low)))
    if over <= house:
        return targets.select("tag", seats(F.lit(low)).alias("quota"))
    more = base.select("tag", "target", F.explode(F.sequence(F.col("base"), seats(F.lit(low)))).alias("a"), "cap").filter("a < cap")
    rank = F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("a") + 1)).desc(), "tag", "a"))
    given = more.withColumn("rank", rank).filter(F.col("rank") <= house - under).groupBy("tag").agg(F.count("*").alias("more"))
    return base.join(given, "tag", "left").select("tag", (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """tag, source_size, target, quota, shards of each source, from source, tag and size of the rows; quotas add up to the house.

    Weights repeat over sources by code point, null last. What exceeds repeats x size is shared anew by weight: in
    the order of repeats x size / weight, sources are full as long as the rest, shared among the others, exceeds theirs.
    The windows run over one row a source and hold one at a time.
    """
    per = sized.groupBy("tag", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ranked = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (nth % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), "tag")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy((F.col("cap") / F.col("w")).desc(), F.col("tag").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # weights are sums of few different numbers; sizes are whole: both sums are exact
    level = ranked.withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest_w", F.sum("w").over(rest))
    level = level.withColumn("free", F.col("rest") * F.col("w") / F.col("rest_w") <= F.col("cap"))
    first = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("at"), "tag", "rest", "rest_w"))).over(Window.partitionBy(F.lit(0)))
    found = level.withColumn("first", first)
    shared = F.col("first.rest") * F.col("w") / F.col("first.rest_w")
    is_free = F.col("first").isNotNull() & (F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("tag").alias("tag")) >= F.struct(F.col("first.at").alias("at"), F.col("first.tag").alias("tag")))
    target = F.when(is_free, shared).otherwise(F.col("cap"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n") / SHARD_ROWS)).cast("long")
    dims = materialise(found.withColumn("target", target).select("tag", "source_size", "target", F.floor("cap").cast("long").alias("cap"), shards.alias("shards")), "mix-targets")
    total = dims.agg(F.sum("source_size")).first()[0] or 0
    quotas = apportioned(dims.select("tag", "target", "cap"), int(share * total))
    return dims.join(quotas, "tag", "left").select("tag", "source_size", "target", F.coalesce("quota", F.lit(0).cast("long")).alias("quota"), "shards")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, carry: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, finish: tuple[Callable[[pa.Table], pa.Table], str] | None = None) -> DataFrame:
    """Per row of docs: key, source, size, source_size, target, taken, spans (word ranges by round), and carry's columns.

    Null text has no words and none is taken; null sources are one source, last in order; repeated rows are dealt
    each by itself; very long texts are counted part by part; carried columns are held under other names, so none
    clashes. An empty table gives no rows. Nothing of the input reaches the driver; tables of one row a source are
    joined, and broadcast only where Spark finds them small. A task holds a shard: about SHARD_WORDS words or SHARD_ROWS rows.
    finish: what makes other rows of a shard's result, and their schema; it runs in the same Python worker.
    """
    sized = with_sizes(docs, key, text, source, carry)
    dims = materialise(source_targets(sized, weights, share, repeats), "mix-sources")
    dealt = sized.join(dims.select("tag", "shards"), "tag").withColumn("shard", F.pmod("hash", "shards")).drop("shards")
    per = dealt.groupBy("tag", "shard").agg(F.sum("size").alias("words")).withColumn("part", F.floor(F.col("shard") / GROUP))
    per = materialise(per, "mix-shards")

    def apportion(t: pd.DataFrame) -> pd.DataFrame:
        """The quota of each unit of one source, from `blocks` of all its units."""
        t = t.sort_values("unit")
        words = [int(w) for w in t.words]
        t["quota"] = sainte_lague([float(w) for w in words], int(t.blocks.iloc[0]), [repeats * w for w in words])
        return t

    # blocks of a source go to groups of shards, those of a group to its shards: no task sees all shards
    fields = "tag string, part long, unit long, words long, blocks long, quota long"
    groups = per.groupBy("tag", F.col("part").alias("unit")).agg(F.sum("words").alias("words")).join(dims.select("tag", F.col("quota").alias("blocks")), "tag").select("tag", F.lit(0).cast("long").alias("part"), "unit", "words", "blocks")
    given = groups.groupBy("tag").applyInPandas(apportion, fields).select("tag", F.col("unit").alias("part"), F.col("quota").alias("blocks"))
    cut = per.join(given, ["tag", "part"]).select("tag", "part", F.col("shard").alias("unit"), "words", "blocks").groupBy("tag", "part").applyInPandas(apportion, fields)
    quotas = materialise(cut.select("tag", F.col("unit").alias("shard"), "words", "quota").join(dims.select("tag", "source_size", "target"), "tag"), "mix-quotas")

    kept = [f for f in sized.schema if f.name.startswith("c") and f.name[1:].isdigit()]

    def select(t: pa.Table, q: pa.Table) -> pa.Table:
        words, quota, source_size, target = (q[c][0].as_py() for c in ("words", "quota", "source_size", "target"))
        bounds, times = chosen_blocks(words, quota, f"{seed}/{q['shard'][0]}/{q['tag'][0]}")
        keys, sizes, hashes = (t[c].to_pylist() for c in ("key", "size", "hash"))
        rank = [xxhash.xxh64_intdigest(f"{seed}/{h}") for h in hashes]
        order = sorted(range(t.num_rows), key=lambda i: (rank[i], keys[i] is not None, keys[i] or 0, sizes[i]))
        spans, at = [], 0
        for i in order:
            spans.append([[{"start": a, "end": b} for a, b in r] for r in taken_spans(at, sizes[i], bounds, times)])
            at += sizes[i]
        t = t.take(pa.array(order, pa.int64()))
        made = {
            "source_size": pa.array([source_size] * len(order), pa.int64()),
            "target": pa.array([target] * len(order), pa.float64()),
            "taken": pa.array([sum(x["end"] - x["start"] for r in rs for x in r) for rs in spans], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))),
        }
        out = pa.table({n: made[n] if n in made else t[n] for n in names})
        return finish[0](out) if finish else out

    names = ["key", "source", "size", "source_size", "target", "taken", "spans", *(f.name for f in kept)]
    schema = "key long, source string, size long, source_size long, target double, taken long, spans array<array<struct<start:long,end:long>>>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    return dealt.groupBy("tag", "shard").cogroup(quotas.groupBy("tag", "shard")).applyInArrow(select, finish[1] if finish else schema)
