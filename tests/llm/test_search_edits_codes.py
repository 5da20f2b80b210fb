"""Ranked search, edit fingerprints and vector codes against brute force and edge cases."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from affinity.llm import codes, edits, queries, ranked

DATA = "/root/testdata/sf0.001"
LONG = "long words go on " * 8_000
EDGES = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (None, "a b c d e"), (6, "Ärger 中文 é \U0001f600"), (7, None), (1, "b c")]
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, 1, "x", 0.5, 3, 1) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, none int, h string, score double, rank int, segment int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- 11 ranked search ----------------------------------------------------------------------------


def brute_ranking(docs, items, k):
    """``(place of the item, score, doc_id)`` of the best documents of each item, best first."""
    counts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for place, (_, text) in enumerate(items):
        found = []
        for (i, c), size in zip(counts, sizes):
            m = 75 + 25 * size * n // total if total else 75
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall(lowered(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(place, -s, None if missing else i) for s, missing, i in sorted(found)[:k]]
    return out


def ranking(found, items):
    place = {}
    for at, (i, _) in enumerate(items):
        place.setdefault(i, at)
    return sorted(((place[r.item_id], r.rank, r.score, r.doc_id) for r in found.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("segment", [1 << 10, 1 << 14, 1 << 24])
def test_ranking_equals_brute_force(spark, segment):
    rng = random.Random(segment)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 300])))) for i in rng.sample(range(5000), 900)]
    docs += [(6000 + i, docs[7][1]) for i in range(40)]  # ties beyond the last rank
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(25)] + [(90, docs[7][1]), (91, "nobody has this"), (92, None), (93, "W0 w0, w1")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranking(ranked.search(ranked.index(table, segment), spark.createDataFrame(items, "item_id long, text string"), k=10), items)
    want = brute_ranking(docs, items, 10)
    assert [(p, s, i) for p, _, s, i in got] == want
    ranks = Counter(p for p, *_ in got)
    assert [r for _, r, _, _ in got] == [r for p in sorted(ranks) for r in range(1, ranks[p] + 1)]


def test_ranking_passes_over_blocks_below_the_threshold():
    """Blocks that meet only intervals below the threshold stay packed, and the result is that of all of them."""
    rng = np.random.default_rng(5)
    docs = [(i, b"common " * int(rng.integers(1, 4)) + (b"rare " * 6 if i in (4000, 4001) else b"") + b"other " * 20) for i in range(40_000)]
    totals = ranked.Totals(len(docs), sum(len(ranked.terms_of(t)) for _, t in docs))
    row = ranked.built(0, [i for i, _ in docs], [t for _, t in docs], totals).to_pylist()[0]
    segment, best = ranked.Segment(row), ranked.Best(2)
    place = {w: i for i, w in enumerate(segment.vocabulary)}
    segment.search([(place[b"common"], totals.weight(40_000)), (place[b"rare"], totals.weight(2))], best)
    assert best.ids.tolist() in ([4000, 4001], [4001, 4000])
    own = slice(*segment.begin[[place[b"common"], place[b"common"] + 1]])
    assert segment.open[own].sum() <= 2 < len(segment.open[own]) == math.ceil(40_000 / ranked.BLOCK)


def test_blocks_pack_and_unpack():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 128, 7, 8, 9, 128, 1, 3], np.int64)
    starts = np.cumsum(sizes) - sizes
    for top in (1, 2, 300, 1 << 30):
        values = rng.integers(0, top, sizes.sum())
        widths = ranked.bit_lengths(np.maximum.reduceat(values, starts))
        data, length, out = ranked.pack(values, starts, sizes, widths), ranked.packed_sizes(sizes, widths), np.full(len(values), -1)
        assert len(data) == length.sum()
        ranked.unpack(data, np.cumsum(length) - length, sizes, widths, out, starts)
        assert (out == values).all()


def test_ranking_edge_cases(spark, edges, none):
    items = [(1, "a B c"), (2, None), (3, ""), (None, "ärger Ärger words"), (5, LONG), (6, "中文")]
    table = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id int")
    got = ranking(ranked.search(ranked.index(edges), table), items)
    assert [(p, s, i) for p, _, s, i in got] == brute_ranking(EDGES, items, 20) and got
    # rows of one item id are items of their own
    twice = ranked.search(ranked.index(edges), table.limit(1).union(table.limit(1))).collect()
    assert sorted(r.rank for r in twice) == sorted(2 * list(range(1, len(twice) // 2 + 1)))
    assert ranked.search(ranked.index(none), table).count() == 0 == ranked.search(ranked.index(edges), table.limit(0)).count()


def test_items_come_in_portions(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS", 3)
    docs, items = [(i, f"a{i % 7} b{i % 3}") for i in range(50)], [(i, f"a{i} b1") for i in range(8)]
    table = ranked.index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = ranking(ranked.search(table, spark.createDataFrame(items, "item_id long, text string"), k=4), items)
    assert [(p, s, i) for p, _, s, i in got] == brute_ranking(docs, items, 4)


# --- 12 edit fingerprints ------------------------------------------------------------------------


def brute_edited(docs):
    out = []
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        out.append((i, len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + following[: len(text) // 2]).encode()).hexdigest()))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_op12_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text or "") for r in queries.table(spark, DATA, "documents").collect())
    got = sorted(queries.op12_edits(spark, DATA).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == brute_edited(docs)
    whole = edits.fingerprints([t for _, t in docs])
    for k, r in enumerate(got):
        text, following = docs[k][1], docs[(k + 1) % len(docs)][1]
        edited = edits.fingerprints([text[: len(text) - len(text) // 2] + following[: len(text) // 2]])[0]
        assert (r.fingerprint, r.edited_fingerprint) == (edits.shown(whole[k]), edits.shown(edited))
        assert r.near_edited == pytest.approx(float(edits.likeness(whole[k], edited))) and r.near_next == pytest.approx(float(edits.likeness(whole[k], whole[(k + 1) % len(docs)])))
    far = [r for k, r in enumerate(got) if docs[k][1] != docs[(k + 1) % len(docs)][1] and r.n_chars > 40]
    assert all(r.near_edited > r.near_next + 0.2 for r in far)


def test_fingerprints_do_not_depend_on_their_company():
    texts = ["", "a", "ab" * 50, LONG, "x" * edits.STRETCH, "x" * (edits.STRETCH + 1), LONG + "z"]
    together = edits.fingerprints(texts)
    for text, own in zip(texts, together):
        assert (edits.fingerprints([text])[0] == own).all()
    assert (edits.fingerprints(texts[::-1])[::-1] == together).all()
    assert edits.likeness(together[0], together[1]) < 0.1


def test_likeness_falls_with_edits():
    rng = random.Random(4)
    letters = "etaoinshrdlu bcfgm"
    for size, most in ((300, 4), (3_000, 12), (60_000, 40)):
        text = "".join(rng.choices(letters, k=size))
        means = []
        for n in (0, most // 4, most, 20 * most):
            found = []
            for _ in range(6):
                out = list(text)
                for _ in range(n):  # insertions, deletions and replacements
                    at = rng.randrange(len(out))
                    out[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(letters)]])
                found.append(float(edits.likeness(*edits.fingerprints([text, "".join(out)]))))
            means.append(np.mean(found))
        assert means[0] == 1 and means[1] > means[3] and means[2] > means[3] and means[1] > 0.6
    other = "".join(rng.choices(letters, k=3_000))
    assert edits.likeness(*edits.fingerprints([other, text[:3_000]])) < 0.25


def test_edit_edge_cases(spark, edges, none):
    got = edits.edited_pairs(edges.repartition(5)).collect()
    by_id = sorted(EDGES, key=lambda x: (x[0] is None, x[0] or 0))
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in by_id)
    copies = [r for r in got if r.doc_id == 1 and r.n_chars == 9]
    assert len(copies) == 2 and copies[0].fingerprint == copies[1].fingerprint and 1.0 in [r.near_next for r in copies]
    empty = {r.doc_id: r for r in got if r.n_chars == 0}
    assert set(empty) == {2, 3, 7} and len({r.fingerprint for r in empty.values()}) == 1 and empty[2].near_next == 1 == empty[2].near_edited
    last = next(r for r in got if r.doc_id is None)  # its next one is the first
    assert last.edited_sha256 in {hashlib.sha256(("a b c" + x[:4]).encode()).hexdigest() for x in ("a b c d e", "b c")}
    assert edits.edited_pairs(none).count() == 0
    one = edits.edited_pairs(edges.where("doc_id = 6")).collect()
    text = EDGES[7][1]
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 2] + text[: len(text) // 2]).encode()).hexdigest()


def test_many_ranges_and_copies_of_one_id(spark):
    docs = sorted([(i, f"text {i} " * (i % 9)) for i in range(0, 600, 2)] + [(301, f"same id {k}") for k in range(200)] + [(303, "copy")] * 200)
    got = edits.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(docs) and sum(r.near_next == 1.0 for r in got if r.doc_id == 303) == 199
    single = {r.doc_id: r.edited_sha256 for r in got if r.doc_id not in (301, 303)}
    want = {i: h for i, _, h in brute_edited(docs)}
    assert {i: h for i, h in single.items() if i != 300} == {i: want[i] for i in single if i != 300}  # the order of 301 decides what 300 meets


def test_edit_near_duplicates(spark, edges, none):
    rng = random.Random(9)
    letters = "abcdefghijklmnop "
    docs, group = [], {}
    for g in range(40):
        text = "".join(rng.choices(letters, k=2_000))
        for c in range(rng.choice([1, 2, 5])):
            own = text if c == 1 else text[: -rng.randrange(1, 60)] + "zz" if c else text
            docs.append((len(docs), own))
            group[len(docs) - 1] = g
    got = {r.doc_id: r.component_id for r in edits.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in group.items()}
    assert edits.near_duplicates(edges).count() == len(EDGES) and edits.near_duplicates(none).count() == 0


# --- 13 vector codes -----------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """Codes, errors and codebooks by comparing every part with every entry in every round."""
    kept = sorted((i, x) for i, x, _ in rows)
    whole = np.array([[math.floor(1024 * v) for v in x] for _, x in kept], dtype=object).reshape(len(kept), parts, -1)
    books = [[list(whole[k, p]) for k in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in whole[:, p]:
                own.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in whole]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found)}, digest


def compressed(spark, rows, **more):
    return codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), **more).collect()


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 0.004), (3, 100_000.0)])
def test_codes_equal_brute_force(spark, seed, scale):
    """Ties abound at the small scale, and products beyond exact doubles at the large one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.2) * scale
    rows = [(int(i), v.tolist(), int(i) % 3 or None) for i, v in zip(rng.permutation(1000), x)]
    want, digest = brute_codes(rows, 4, 16, 4)
    got = compressed(spark, rows, entries=16)
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    sums = Counter()
    for i, _, label in rows:
        sums[label] += want[i][1]
    label_of = {i: label for i, _, label in rows}
    assert all(r.label_error == sums[label_of[r.vec_id]] for r in got)


def test_bounds_save_comparisons(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(16, 8))[rng.integers(0, 16, 2000)] * 5 + rng.normal(size=(2000, 8)) * 0.05
    got = compressed(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], entries=16)
    # one comparison of each of four parts is due, twenty would be made without bounds
    assert sum(r.scans for r in got) < 12 * len(got)
    assert {r.vec_id: (r.code, r.error) for r in got} == brute_codes([(i, v.tolist(), 0) for i, v in enumerate(x)], 4, 16, 4)[0]


def test_roots_are_exact():
    n = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 60) - 1, 1 << 60, (1 << 60) + 1, ((1 << 31) - 1) ** 2, ((1 << 31) - 1) ** 2 - 1])
    assert codes.floor_root(n).tolist() == [math.isqrt(v) for v in n.tolist()]
    assert codes.ceil_root(n).tolist() == [math.isqrt(v - 1) + 1 if v else 0 for v in n.tolist()]


def test_code_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [1.0, None], 2), (5, [inf, 0.0], None), (6, [], None), (7, [0.5, -0.5, 3.0, 1.0, 2.0], None), (1, [1.0, 2.0], 1), (None, [-1.0, 2.0], 1), (8, [0.0], 7)]
    table = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int, salt int")
    got = codes.compress(table).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert all(r.error == 0 for r in got) and all(len(r.code) == 8 for r in got)
    same = [r.code for r in got if r.vec_id == 1]
    assert same[0] == same[1] == "00000000"  # ties go to the lower index
    assert codes.compress(table.limit(0)).count() == 0 and codes.compress(table.where("vec_id = 2").drop("label")).count() == 0
    for large in ([1e30], [1e6] * 40):
        with pytest.raises(Exception, match="do not fit"):
            codes.compress(spark.createDataFrame([(1, large, 1), (2, [0.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
