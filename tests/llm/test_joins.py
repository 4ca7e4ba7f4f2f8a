"""Set join, spelling variants and collocations against plain versions, on rows with every odd case."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from .conftest import make_docs
from .test_operators import lower, same


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def words_of(text, space):
    for c in space:
        text = text.replace(c, " ")
    return [w for w in lower(text or "").split(" ") if w]


def shingle_set(text, k=5):
    w = words_of(text or "", "\t\n\x0b\x0c\r")
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def plain_components(docs, percent=80):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[top(i)].append(docs[i][0])
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [(k, len(sets[i]), least[top(i)]) for i, (k, _) in enumerate(docs)]


def near_copies(rnd):
    """Texts of all sizes with copies at every distance around the threshold, a passage that many share, and chains."""
    vocab = [f"w{i}" for i in range(400)]
    out, passage = [], [rnd.choice(vocab) for _ in range(60)]
    for n in (1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 70, 120, 300):
        for _ in range(3):
            base = [rnd.choice(vocab) for _ in range(n)]
            out.append(base)
            for edits in (0, 1, 1, 2, 3, max(1, n // 60), max(1, n // 40), max(1, n // 25)):
                copy = list(base)
                for _ in range(edits):
                    i = rnd.randrange(len(copy) or 1)
                    copy[i : i + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 2) or [rnd.choice(vocab)]
                out.append(copy)
                base = rnd.choice([base, copy])
    out += [passage + [rnd.choice(vocab) for _ in range(rnd.randint(2, 40))] for _ in range(60)]
    return [(1000 + i, " ".join(w)) for i, w in enumerate(out)]


def test_shingle_join_against_all_pairs(spark, docs):
    from rulespan.llm.set_join import shingle_groups

    odd = [(r[0], r[1]) for r in make_docs()]
    same(rows_of(shingle_groups(docs), "key", "n", "component_id"), plain_components(odd))
    planted = near_copies(random.Random(5))
    want = plain_components(planted)
    assert len({c for *_, c in want}) < 0.8 * len(want)
    for parts in (1, 4):
        df = spark.createDataFrame(planted, "doc_id long, text string").repartition(parts)
        same(rows_of(shingle_groups(df), "key", "n", "component_id"), want)


def test_empty_tables(spark, empty):
    from rulespan.llm.collocations import collocations
    from rulespan.llm.set_join import shingle_groups
    from rulespan.llm.spelling import spelling_variants

    assert [f(empty).count() for f in (shingle_groups, spelling_variants, collocations)] == [0, 0, 0]


def test_signatures_of_linked_sets_meet():
    """Whatever the allocation: two sets within the threshold share a signature that both keep after leaving out."""
    from rulespan.llm.set_join import Sizes, signatures

    rnd, sizes = np.random.default_rng(3), Sizes(80)
    for deletes, spare in ((False, 0), (False, 2), (False, 9), (True, 0)):
        plans = dict.fromkeys(range(40), (deletes, spare))
        for _ in range(150):
            n = int(rnd.integers(4, 400))
            a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            most = sizes.differ(len(a), len(a))
            less, more = int(rnd.integers(0, most // 2 + 1)), int(rnd.integers(0, most // 2 + 1))
            b = np.unique(np.r_[rnd.permutation(a)[less:], rnd.integers(0, 1 << 63, more, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            made = [{s & 1: (v, w, s >> 1) for v, w, s in signatures(x, sizes, plans)} for x in (a, b)]
            counts = Counter(int(v) for x in made for vs, _, _ in x.values() for v in set(vs.tolist()))
            kept = [set() for _ in made]
            for k, x in zip(kept, made):
                for vs, _, left in x.values():
                    shared = sorted((v for v in set(vs.tolist()) if counts[v] > 1), key=lambda v: v)
                    k |= set(shared[left:])
            assert kept[0] & kept[1], (deletes, spare, len(a), len(b))


def test_bitmaps_differ_no_more_than_sets():
    from rulespan.llm.set_join import folded, parity

    rnd = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 500, int(rnd.integers(1, 300)), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x = [parity(a), parity(b)]
        m = folded(x, min(map(len, x)))
        assert np.bitwise_count(m[0] ^ m[1]).sum() <= len(np.setxor1d(a, b))


def plain_spelling(docs, every=199):
    n = Counter()
    for k, t in docs:
        run = ""
        for c in lower(t or "") + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
                if h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += len(run) >= 6
                run = ""
    words = {w: c for w, c in n.items() if c >= 5}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [o for o in words if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o.encode()), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_against_all_pairs(spark, docs):
    from rulespan.llm.spelling import spelling_variants

    names = ("word", "form", "root", "n", "n_near", "form_n")
    odd = [(r[0], r[1]) for r in make_docs()]
    same(rows_of(spelling_variants(docs), *names), plain_spelling(odd))
    rnd = random.Random(9)
    texts = []
    for _ in range(60):
        base = "".join(rnd.choice("abéañ") for _ in range(rnd.randint(6, 10)))
        for times in (700, 130, 26, 5):  # chains of forms
            texts += [base] * times
            i = rnd.randrange(len(base))
            base = rnd.choice([base[:i] + rnd.choice("abéñ") + base[i + 1 :], base[:i] + rnd.choice("abÿ") + base[i:], base[:i] + base[i + 1 :]])
    rnd.shuffle(texts)
    rows = [(i if i % 9 else None, " ".join(texts[i * 40 : i * 40 + 40]).upper() + rnd.choice([".", "1", "\n", "Ā"])) for i in range(len(texts) // 40 + 1)]
    for every in (199, 7):
        want = plain_spelling(rows, every)
        assert sum(f is not None and f != r for _, f, r, *_ in want) > 5
        same(rows_of(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), every=every), *names), want)


def plain_collocations(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang, text = lang or "und", lower(text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = words_of(piece, "\t")
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    phrases = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    found = defaultdict(list)
    for p, a in phrases.items():
        inside = any(q[0] == p[0] and len(q) > len(p) and b >= a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)) for q, b in phrases.items())
        if not inside:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            found[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return [(lang, i, ph.decode(), -a, left, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, ph, left, r) in enumerate(sorted(rows)[:top], 1)]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_collocations_against_plain_counts(spark, size):
    """Shards of 64 positions cut texts and phrases in their middle; counts must not change."""
    from rulespan.llm.collocations import collocations

    rnd = random.Random(11)
    odd = [(r[2], r[1]) for r in make_docs()]
    rows = [(rnd.choice(["en", "fr", None]), "".join(rnd.choice(["a", "b", "É", "the", "of x", "of x y"]) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", " "]) for _ in range(rnd.randint(0, 150)))) for _ in range(80)]
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for data, least, top in ((odd, 3, 50), (rows, 12, 40), (rows, 12, 2000)):
        df = spark.createDataFrame(data, "lang string, text string").repartition(2)
        want = plain_collocations(data, least, top)
        assert want
        same(rows_of(collocations(df, least=least, top=top, size=size), *names), want)


def test_a_shard_sends_a_row_a_part(spark):
    """Pairs and phrases travel packed: rows follow shards and parts, not what occurs in them; sums are as by plain counts."""
    from rulespan.llm import collocations as co

    rnd = random.Random(31)
    docs = [("en", " ".join(f"w{min(rnd.randrange(12), rnd.randrange(12))}" for _ in range(1500))) for _ in range(4)]
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    shards = co.shards(df, "text", "lang", 1500).toArrow()
    assert shards.num_rows >= 4
    parts, least, pairs, phrases = 3, 8, [], []
    lone = [shards.slice(i, 1) for i in range(shards.num_rows)]
    for s in lone:
        words = s.column("words")[0].as_py()[1:]
        hashes = [r[0] for r in spark.createDataFrame([("en", w) for w in words], "l string, w string").selectExpr("xxhash64(l, w)").collect()]
        known = pa.table({"word": range(1, len(words) + 1), "hash": hashes}, schema=pa.schema([("word", pa.int64()), ("hash", pa.int64())]))
        pairs.append(co.pair_counts(s, known, parts))
    assert all(0 < t.num_rows <= parts for t in pairs)
    sent = pa.concat_tables(pairs)
    met = pa.concat_tables(co.frequent_pairs(sent.filter(pc.equal(sent.column("part"), p)), least) for p in range(parts))
    for s in lone:
        phrases.append(co.phrase_counts(s, met.filter(pc.equal(met.column("shard"), s.column("shard")[0])), parts))
    assert all(t.num_rows <= parts for t in phrases)
    sent = pa.concat_tables(phrases)
    found = pa.concat_tables(co.summed_phrases(sent.filter(pc.equal(sent.column("part"), p)), least) for p in range(parts)).to_pylist()
    want = Counter(" ".join(w[i : i + k]) for _, t in docs for w in [t.split()] for k in range(2, 6) for i in range(len(w) - k + 1))
    want = {p: n for p, n in want.items() if n >= least}
    assert {r["phrase"]: r["a"] for r in found} == want and len(want) > 50
    assert all(r["lang"] == "en" and r["size"] == len(r["phrase"].split()) for r in found)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    from rulespan.llm import collocations, spelling
    from rulespan.llm.set_join import shingles

    rnd = random.Random(13)
    text = " ".join(rnd.choice(["alpha", "betabeta", "gamma.", "déltadelta"]) for _ in range(4000))
    whole = Counter(dict(spelling.runs(text.encode()))), collocations.tokens(text.encode()), shingles(text.encode(), 5).tolist()
    parts = list(_cut(text.encode()))
    assert len(parts) > 50 and b"".join(parts) == text.encode()
    runs = Counter()
    for p in parts:
        runs.update(dict(spelling.runs(p)))
    assert runs == whole[0] and [w for p in parts for w in collocations.tokens(p)] == whole[1]
    monkeypatch.setattr("rulespan.llm.set_join.word_chunks", _cut)
    assert shingles(text.encode(), 5).tolist() == whole[2]


def _cut(text):
    from rulespan.llm.common import word_chunks

    return word_chunks(text, 300)


def test_stars_take_no_step_and_plans_stay_small(spark, monkeypatch):
    """Links that are stars need no step; filters of many hashes are no literals, whose bytes each plan's texts would repeat."""
    from rulespan.llm import components, set_join

    written = []
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or df.localCheckpoint())
    found = lambda links: {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found([(1, 5), (5, 1), (7, 1), (9, 8), (3, 3), (None, 4)]) == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8} and len(written) == 1
    assert found([(i, i + 1) for i in range(20)] + [(40, 30), (40, 31)]) == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 30} and len(written) > 2
    assert found([]) == {}

    hashes = [0, -1, 63, 64, -(1 << 63), (1 << 63) - 1, 12345678901]
    wanted = spark.createDataFrame([(h,) for h in hashes], "body long")
    rows = spark.createDataFrame([(h, str(h)) for h in hashes + [1, 62, 65, -2, 99999]], "body long, text string")
    met = set_join._may_hold(rows, "body", wanted)
    assert sorted(r["body"] for r in met.collect()) == sorted(hashes) and met.columns == rows.columns
    assert len(met._jdf.queryExecution().toString()) < 50_000
