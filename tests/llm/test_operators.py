"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import math
import pathlib
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from affinity.llm import chat, common, decontamination, embeddings, html_text, licenses, lm, packing, quality, simhash, toxicity
from affinity.llm.queries import vocabulary
from affinity.operators.lineage import CLEANUP
from brute import Walker

LONG = "long words go on " * 20_000
EDGES = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (None, "a b c d e"), (6, "Ärger 中文 é \U0001f600"), (7, None)]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and very long texts, repeats, and further columns under clashing names."""
    rows = [(i, t, 1, "x", 0.5, None, 1) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, fp string, score double, component_id long, key_one int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def brute_components(n, linked):
    labels = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j) and labels[i] != labels[j]:
            a, b = sorted((labels[i], labels[j]))
            labels = [a if x == b else x for x in labels]
    return labels


# --- components ----------------------------------------------------------------------------------


def test_components_equal_brute_force(spark):
    random.seed(1)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(9, 9)]
    labels = list(range(400))
    for a, b in links:
        low, high = sorted((labels[a], labels[b]))
        labels = [low if x == high else x for x in labels]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: labels[x] for x in set(itertools.chain(*links))}


# --- 1 toxicity ----------------------------------------------------------------------------------


def test_segments_are_the_maximal_ones():
    def brute(scores):
        if not any(s > 0 for s in scores):
            return []
        n = len(scores)
        a, b = max(((i, j) for i in range(n) for j in range(i, n)), key=lambda x: (round(sum(scores[x[0] : x[1] + 1]), 9), -(x[1] - x[0]), -x[0]))
        left, right = brute(scores[:a]), brute(scores[b + 1 :])
        return left + [(a, b, sum(scores[a : b + 1]))] + [(x + b + 1, y + b + 1, s) for x, y, s in right]

    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-1.0, -1.0, 2.3, 0.7, -3.1]) for _ in range(rng.randrange(12))]
        own = [i for i, s in enumerate(scores) if s != -1.0]
        got = toxicity.segments(np.array(own, int), np.array([scores[i] for i in own]), -1.0)
        assert [(a, b, pytest.approx(s)) for a, b, s in got] == brute(scores)


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioukst") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["zgrobl", "zgroblix", "Vrunk!"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_and_holds_out(toxic_docs):
    labels = toxic_docs.select("doc_id", "toxic").union(toxic_docs.sparkSession.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.fit(toxic_docs, labels, ~common.held_out("doc_id", 4))
    got = toxicity.score(toxic_docs, model).join(toxic_docs.select("doc_id", "toxic"), "doc_id").where(common.held_out("doc_id", 4)).collect()
    assert got and all(r.predicted == r.toxic for r in got)
    kept = toxicity.keep_civil(toxic_docs, model)
    assert kept.columns == toxic_docs.columns and kept.where("toxic = 1").count() == 0 and kept.count() == 480


def test_segments_in_linear_time():
    import time

    took = []
    for n in (4000, 64_000):
        began = time.perf_counter()
        assert len(toxicity.segments(np.arange(n) * 50, np.full(n, 2.0), -0.5)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 60 * max(took[0], 0.005)


def test_keep_rows_of_any_kind(spark, edges, toxic_docs):
    model = toxicity.fit(toxic_docs, toxic_docs, F.lit(True))
    for kept in (toxicity.keep_civil(edges, model, threshold=2.0), toxicity.keep_civil(edges, toxicity.Model())):
        assert kept.columns == edges.columns and sorted(map(str, kept.collect())) == sorted(map(str, edges.collect()))
    assert toxicity.keep_civil(edges.limit(0), model).count() == 0
    # bytes that are no UTF-8
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF20FE62' AS string) AS text")
    assert toxicity.score(broken, model).count() == licenses.scan(broken).count() == simhash.near_duplicates(broken).count() == 1
    assert lm.score_documents(broken, F.lit(True)).first().n_tokens == 3 and packing.pack(broken, vocabulary("word_bpe_49k.json")).count() == 1


def test_toxicity_edges(edges, none, toxic_docs):
    model = toxicity.fit(toxic_docs, toxic_docs, F.lit(True))
    got = toxicity.score(edges, model)
    assert got.count() == len(EDGES) and got.where("score between 0 and 1").count() == len(EDGES)
    assert toxicity.score(none, model).count() == 0
    unfit = toxicity.fit(toxic_docs, toxic_docs.where("toxic = 0"), F.lit(True))
    assert toxicity.score(edges, unfit).agg(F.max("predicted")).first()[0] == 0


# --- 2 html --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; <b>bold</b>\n text", "plain & bold text"), ("<p", ""), ("<script>x('</p>')</script>", ""),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One,\n two.<br>three<p><b>Four<ul><li>a<li>b</ul></article><footer>f</footer>", "T\nOne, two. three\nFour\na\nb"),
        ("<article><p>x</p><aside>s</aside><form><p>q</form><section class='user-comments'><p>Nice, very nice. So nice!</p></section></article>", "x"),
        ("<div class=sidebar>s, s, s.</div><div><p>First one, long enough to be text.</p><p>Second.</p></div><div id=cookie-notice>We use cookies, yes.</div>", "First one, long enough to be text.\nSecond."),
        ("<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>Text &lt;here&gt; &#233;</main>", "Title\nText <here> é"),
        ("<article><p>cut off &amp; in a tag <a hre", "cut off & in a tag"), ("<article><p>a<!-- <p>no</p> --> b</p></article>", "a b"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_ratios_choose_within_all_articles():
    first, second = "First text, with some words.", "Second text, with more words, and a point."
    links = "<ul>" + "<li><a href=/>Read this other page</a>" * 3 + "</ul>"
    page = f"<article><h2><a href=/1>One</a></h2><p>{first}</p>{links}</article><article><h2>Two</h2><p>{second}</p><ol><li>a<li>b</ol></article>"
    assert html_text.main_text(page) == f"One\n{first}\nTwo\n{second}\na\nb"
    # a short plain line beside a very long one is text
    assert html_text.main_text(f"<article><p>{second * 200}</p><ol><li>a<li>b<li>c<li>d<li>e<li>f</ol></article>").endswith("a\nb\nc\nd\ne\nf")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout has-sidebar'><article><p>One, two.</p></article><div class=sidebar><p>s, s.</p></div></div>", "One, two."),
        ("<div class='no-sidebar'><p>One, two.</p></div><div class=ad>Buy.</div>", "One, two."),
        ("<div id=sidebar-right><article><p>One, two.</p></article></div>", "One, two."),
        ("<article><p>x</p><section id=discussion><p>d</p></section><section id=related-work><p>r</p></section><section id=legal><p>l</p></section></article>", "x\nd\nr\nl"),
        ("<article><p>x</p></article><div id=comments><article><p>Nice, very nice. So nice!</p></article></div>", "x"),
    ],
)
def test_marks_do_not_drop_the_article(page, text):
    assert html_text.main_text(page) == text


def test_path_ratios_equal_brute_force():
    rng = random.Random(16)
    for _ in range(50):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            words = " ".join(rng.choice(["ab", "cde,", "f.", "ghijk"]) for _ in range(rng.randrange(1, 12)))
            inner = f"<a href=/>{words}</a> x" if rng.random() < 0.3 else words
            parts.append(rng.choice(["<p>{}</p>", "<div><p>{}</p></div>", "<ul><li>{}</ul>", "<section><h2>{}</h2></section>", "<div>{}</div>"]).format(inner))
        page = html_text.read_page("<body>" + "".join(parts))
        paths, rows = [], []
        for b in page.blocks:
            tags, p = [], b.element
            while p >= 0:
                tags.append(page.tag[p])
                p = page.up[p]
            paths.append(tuple(tags))
            rows.append((len(b.text), sum(c in ".,;:!?" for c in b.text), min(b.links, len(b.text))))
        own = []
        for path in paths:
            n, chars, points, linked = (sum(x) for x in zip(*((1, *r) for r, q in zip(rows, paths) if q == path)))
            plain = chars / n * (1 + math.log1p(points / n))
            own.append((plain * (1 - linked / chars) ** 2, plain))
        want = []
        for i, (chars, _, linked) in enumerate(rows):
            near = [(math.exp(-((i - j) ** 2) / 2), own[j][0]) for j in range(max(0, i - 2), min(len(rows), i + 3))]
            want.append(max(sum(w * x for w, x in near) / sum(w for w, _ in near) * (1 - linked / chars), own[i][0]))
        ratio, plain = html_text.path_ratios(page, page.blocks)
        assert ratio.tolist() == pytest.approx(want) and plain.tolist() == pytest.approx([x for _, x in own])


def test_nesting_in_linear_time():
    import time

    took = []
    for n in (500, 8000):
        began = time.perf_counter()
        assert html_text.main_text("<article>" + "<div>a, b.<section class=ad>" * n + "<p>end</p></b>").startswith("a, b.")
        took.append(time.perf_counter() - began)
    assert took[1] < 60 * max(took[0], 0.005)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 0), (1, "u", "<p>a</p>", 0), (None, None, None, 1)], "page_id long, url string, html string, n_chars long")
    got = html_text.extract(pages)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


# --- 3 embeddings --------------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 16))
    tight = base[:1] + 0.1 * rng.standard_normal((200, 16))  # more than one window, inside a core
    loose = base[1:2] + 0.24 * rng.standard_normal((300, 16))  # links that are not all of a pair
    m = np.concatenate([base, tight, loose, 3 * base[5:8], base[9:10].repeat(40, axis=0)])
    rows = [(i, x.tolist(), "a") for i, x in enumerate(m)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] * 16), (5004, [math.nan] * 16), (5005, [math.inf] * 16), (5006, [1.0] * 3)]
    df = spark.createDataFrame(rows + [(i, x, "b") for i, x in odd] + rows[:2], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, window=64).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    labels = common.merge_labels(np.arange(len(m)), *np.nonzero(close))
    assert len(got) == len(m) + len(odd)
    assert all(got[i].n_links == close[i].sum() - 1 and got[i].component_id == labels[i] and got[i].kept == (labels[i] == i) for i in range(len(m)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_in_a_dense_region_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((2000, 64))
    cone = 2.6 * rng.standard_normal(64) + rng.standard_normal((1000, 64))  # a third of the rows, few of which link
    near = cone[:300] + 0.6 * rng.standard_normal((300, 64))  # partners just above the threshold
    m = np.concatenate([base, cone, near])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "STRIPE_ROWS", 500)  # several stripes
    monkeypatch.setattr(embeddings, "COUNT_ROWS", 16)  # several blocks of a component
    monkeypatch.setattr(embeddings, "AGAINST_ROWS", 8)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, window=32).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    labels = common.merge_labels(np.arange(len(m)), *np.nonzero(close))
    assert 200 < (labels != np.arange(len(m))).sum() < 600
    assert all((r.n_links, r.component_id) == (close[i].sum() - 1, labels[i]) for i, r in got.items())


# --- 4 simhash -----------------------------------------------------------------------------------


def test_fingerprint_is_the_majority_of_shingle_hashes():
    words = "The quick  brown\tfox Jumps over the quick brown fox".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).lower(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint("The quick  brown\tfox Jumps over the quick brown fox".encode()) == want
    assert simhash.fingerprint(b"One two") == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("leaves", [1, 4, 32])
def test_shards_find_every_link(leaves, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 40)  # shards have trees of their own
    rng = np.random.default_rng(leaves)
    v = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = v[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    dense = np.uint64(77) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    v = np.unique(np.concatenate([v, near, dense, [np.uint64(0)]]))
    index, shard, home = simhash.route(v, simhash.build_tree(v[::2], leaves, 2), 2)
    assert sorted(index[home]) == list(range(len(v)))
    labels = np.arange(len(v))
    for s in np.unique(shard):
        a, b = simhash.shard_links(v[index[shard == s]], home[shard == s], 2)
        labels = common.merge_labels(labels, np.searchsorted(v, a), np.searchsorted(v, b))
    assert (labels == common.merge_labels(np.arange(len(v)), *np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2))).all()


def test_simhash_edges(edges, none):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 6), (7, 2)]
    assert [r.component_id for r in got if r.doc_id is None] == [1]
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert simhash.keep_one(none).count() == 0


def test_keep_one_of_each_group_without_or_with_shared_ids(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (7, d), (7, d), (7, "e " + b), (7, None), (8, d), (8, "f")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {r.component_fp for r in got}
    fps = [simhash.fingerprint((r.text or "").encode()) for r in kept]
    of = {np.int64(r.fp).view(np.uint64).item(): r for r in got}
    assert len(kept) == len(want) and {of[f].component_fp for f in fps} == want
    assert all(r.doc_id == of[f].component_id for r, f in zip(kept, fps))


# --- 5 licenses ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "base", "labels", "places"),
    [
        (None, "", "", (0, None, None)), ("no notice", "", "", (0, None, None)), ("Cc-BY, all RIGHTS\nreserved; cc by!", "cc-by,reserved", "cc-by,reserved", (3, 0, 5)),
        ("Licensd under teh Apache Licnse, Version 2.0", "", "apache-2.0", (0, None, None)), ("Released under the MIT License.", "", "mit", (0, None, None)),
        ("the GNU General Public License, v3. xcc by", "gpl", "gpl", (1, 2, 2)), ("licensed under CC BY-NC 4.0", "cc-by", "cc-by,cc-by-nc", (1, 2, 2)), ("accc bystander", "", "", (0, None, None)),
    ],
)
def test_license_texts(text, base, labels, places):
    got = licenses.scan_text(text and text.encode(), licenses.scanner())
    assert (got["base_labels"], got["labels"]) == (base, labels)
    assert (got["n_base"], got["first_word"], got["last_word"]) == places


def test_pigeonhole_misses_no_edit():
    scan, rng = licenses.scanner(), random.Random(6)
    for text, label, k in licenses.NOTICES:
        for _ in range(5):
            letters = list(text)
            for at in rng.sample([i for i, c in enumerate(letters) if c != " " and 0 < i < len(letters) - 1], k):
                letters[at] = "q"
            found = licenses.scan_text(f"some words {''.join(letters)} more words".encode(), scan)
            assert label in found["labels"].split(","), (text, "".join(letters))


def within(a, b, k):
    """Whether the edit distance of two texts is ``k`` at most: rows of the usual table, as far as k from its diagonal."""
    if abs(len(a) - len(b)) > k:
        return False
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i, x in enumerate(a, 1):
        row = {j: min(row.get(j - 1, 99) + (j == 0 or x != b[j - 1]), row.get(j, 99) + 1, 99) for j in range(max(0, i - k), min(len(b), i + k) + 1)}
        for j in sorted(row)[1:]:
            row[j] = min(row[j], row.get(j - 1, 99) + 1)
    return row.get(len(b), 99) <= k


def test_notices_equal_edit_distance():
    """Insertions, deletions and replacements anywhere, both ends and borders of words included."""
    scan, rng = licenses.scanner(), random.Random(8)
    letters = "abcdeilnrstuy  "
    for _ in range(1_000):  # none was lost of 10,000
        text, _, k = rng.choice(licenses.NOTICES)
        own = list(text)
        for _ in range(rng.randrange(k + 3)):
            at = rng.choice([0, len(own), rng.randrange(len(own) + 1), rng.randrange(len(own) + 1)])
            own[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(letters)], [rng.choice(letters)]])
        words = f"{rng.choice(['', 'a c', 'some', 'x '])}{''.join(own)}{rng.choice(['', ' all', 'e', ' of it'])}".split()
        got = licenses.scan_text(" ".join(words).encode(), scan)
        spans = {(label, " ".join(words[a : b + 1])) for label, a, b, _ in got["spans"]}
        for notice, label, most in licenses.NOTICES:
            whole = [x for a in range(len(words)) for b in range(a + 1, len(words) + 1) for x in [" ".join(words[a:b])] if within(x, notice, most)]
            assert not whole or label in got["labels"].split(","), (label, words)
        assert all(any(within(x, n, m) for n, lab, m in licenses.NOTICES if lab == label) for label, x in spans), words


def test_every_copy_of_a_notice_is_a_span():
    got = licenses.scan_text(b"all rigts reserved all rights reserved, all rigts reserved x", licenses.scanner())
    assert [(a, b) for label, a, b, _ in got["spans"] if label == "reserved"] == [(0, 2), (3, 5), (6, 8)]


def test_license_rows(edges, none):
    got = {r.doc_id: r for r in licenses.scan(edges).collect()}
    assert licenses.scan(edges).count() == len(EDGES) and got[5].n_words == 80_000 and got[2].n_words == 0 and got[6].n_words == 4
    assert licenses.scan(none).count() == 0


# --- 6 chat --------------------------------------------------------------------------------------


def test_escape_round_trip():
    rng = random.Random(7)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "</", "s>", "a", "\n", "é", "|>"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
        formatted, spans = chat.write_conversation([("user", text), ("assistant", text + "x"), (text, "")])
        assert chat.read_conversation(formatted) == [("user", text), ("assistant", text + "x"), (text, "")]
        assert chat.read_loss(formatted, spans) == text + "x"


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.9), ("u", 5, 99, None, None, None), ("c", 6, 7, "user", "loop", 1.0), ("c", 7, 6, "user", "loop", 1.0), ("c", 8, 7, "user", "off a loop", 1.0), (None, 1, None, "user", "null tree", 0.0)]
    rows += [("deep", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(75)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    best = {r.tree: r for r in chat.conversations(nodes).collect()}
    assert set(best) == {"t", "u", None, "deep"}
    assert chat.read_conversation(best["t"].formatted) == [("user", "hi"), ("assistant", "good"), ("user", "more")]
    assert chat.read_conversation(best["u"].formatted) == [("", "")]
    assert [t for _, t in chat.read_conversation(best["deep"].formatted)] == [str(i) for i in range(75)]
    both = chat.conversations(nodes, per_tree=2).where("tree = 't'").orderBy("rank").collect()
    assert [(r.rank, r.leaf, r.n_turns) for r in both] == [(1, 4, 3), (2, 2, 2)]
    assert chat.conversations(nodes.limit(0)).count() == 0


def test_chain_digests(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 1, "assistant", "b</s>"), (2, None, None, None), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.conversations(chat.chain(df, F.col("conv_id"), ["turn", "role", "text"]))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\n" + 2 * "assistant\nb</s>\n") and got[1].loss_sha256 == sha(2 * "b</s>") and got[1].loss_chars == 10
    assert (got[2].n_turns, got[2].turns_sha256) == (1, sha("\n\n")) and got[None].loss_chars == 1


def test_repeated_messages_change_nothing(spark):
    """Each message twice, and some with other texts or parents under the same id, in a chain of forty."""
    schema = "tree string, node long, parent long, role string, text string, score double"
    rows = [("t", i, i - 1 if i else None, "user", str(i), 0.5) for i in range(40)]
    more = [*rows, *rows, ("t", 7, 6, "user", "9", 0.5), ("t", 7, 3, "zzz", "other", 9.0), (None, 1, None, "user", "no tree", 1.0), ("\0null", 1, None, "user", "a tree", 1.0), ("", 1, None, "user", "empty", 1.0), ("t", None, 3, "user", "no id", 99.0)]
    got = {r.tree: r for r in chat.conversations(spark.createDataFrame(more, schema)).collect()}
    assert set(got) == {"t", None, "\0null", ""} and got["t"].n_turns in (37, 40)
    # of message 7, the row with the smaller parent counts
    assert [t for _, t in chat.read_conversation(got["t"].formatted)] == [*"0123", "other", *map(str, range(8, 40))]
    assert [chat.read_conversation(got[k].formatted)[0][1] for k in (None, "\0null", "")] == ["no tree", "a tree", "empty"]


def test_a_broom_is_ranked_without_its_paths(spark):
    """Leaves by the thousand on a long trunk: rows grow with messages and rounds, not with leaves by depth."""
    trunk, leaves = 200, 3000
    rows = [("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(trunk)] + [("t", trunk + i, trunk - 1, "assistant", f"leaf {i}", float(i == 1234)) for i in range(leaves)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    rounds = chat.climbs(nodes.select("tree", "node", "parent", "score"))
    assert len(rounds) <= 9 and all(r.count() == trunk + leaves for r in rounds[:2])
    [got] = chat.conversations(nodes).collect()
    assert got.leaf == trunk + 1234 and [t for _, t in chat.read_conversation(got.formatted)] == [*map(str, range(trunk)), "leaf 1234"]


# --- 7 packing -----------------------------------------------------------------------------------


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole, words, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(8)
    texts = [t for _, t in EDGES if t and len(t) < 99] + ["it's WE'LL don't '' 12 1½ <|endoftext|>x", "A\x1cB\u0085C D\x00 ΟΔΟΣ İ ŉ ǆ ª ﬀ é"]
    texts += ["".join(rng.choice("abÉèñŁ '.!?1\t\n*_-µ×ß<|>中́") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_take_whole_texts():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    assert packing.by_words(vocabulary("word_bpe_49k.json")) and not packing.by_words(path)
    text = "Two  words\n and é"
    assert np.frombuffer(packing.TextIds(path).ids(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    # bytes that are no UTF-8
    assert packing.TextIds(path).ids(b"a\xff b") and packing.WordIds(vocabulary("word_bpe_49k.json")).ids(b"a\xff b")


def decreasing(sizes, capacity):
    """How many sequences best-fit decreasing takes, one piece after the other."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - s)
    return len(gaps)


def placed_pieces(out, counts, capacity):
    """The sequences that placements fill; each piece once, gapless, within the capacity."""
    filled, ranks = {}, {}
    for length, rank, n, sequence, per, offset in out:
        for i in range(n):
            filled.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
            ranks.setdefault(length, []).append(rank + i)
    assert {k: sorted(x) for k, x in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(s for _, s in own)][:-1] and sum(s for _, s in own) <= capacity
    return len(filled)


def test_tail_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.choice([10, 50])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 80))]
        counts = {s: sizes.count(s) for s in sizes}
        out = packing.best_fit([], [(s, 0, n) for s, n in counts.items()], 0, capacity)
        assert placed_pieces(out, counts, capacity) == decreasing(sizes, capacity)


def test_sweep_takes_the_smallest_gaps_longest_first():
    rng = random.Random(10)
    for _ in range(200):
        gaps = [rng.randint(1, 30) for _ in range(rng.randrange(12))]
        lengths = rng.sample(range(1, 31), rng.randrange(10))
        placed, filled, unused, left = packing.sweep([(g, i, 1) for i, g in enumerate(gaps)], [(s, 0, 1) for s in lengths], 30)
        free, want = dict(enumerate(gaps)), {}
        for s in sorted(lengths, reverse=True):
            if fit := min((g for g in free.values() if g >= s), default=None):
                want[s] = fit
                del free[next(i for i, g in free.items() if g == fit)]
        assert {x[0]: 30 - x[5] for x in placed} == want and sorted(x[0] for x in unused) == sorted(free.values())
        assert sorted(x[0] for x in left) == sorted(set(lengths) - set(want)) and sorted(x[0] for x in filled) == sorted(g - s for s, g in want.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_come_near_best_fit_decreasing(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "TAIL", 20)
    rng = random.Random(seed)
    capacity = 256
    sizes = [min(capacity, 1 + int(rng.expovariate(1 / 60))) for _ in range(3000)]
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.placements(spark.createDataFrame(list(counts.items()), "length long, n long"), capacity)
    out = list(zip(*(plan[c].tolist() for c in ("length", "rank", "n", "sequence", "per", "offset"))))
    assert placed_pieces(out, counts, capacity) <= 1.01 * decreasing(sizes, capacity) + 1


def test_pack_rows(edges, none):
    path = vocabulary("word_bpe_49k.json")
    got = packing.pack(edges, path, capacity=64).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {i for i, _ in EDGES} and [(r.length, r.ids_crc32) for r in by_doc[2]] == [(1, zlib.crc32((1).to_bytes(4, "little")))]
    assert len(by_doc[1]) == 2 and all(r.length == 64 for r in by_doc[5][:-1] if r.piece < len(by_doc[5]) - 1)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(x)] == [0, *itertools.accumulate(n for _, n in sorted(x))][:-1] for x in filled.values())
    assert len(filled) == math.ceil(sum(r.length for r in got) / 64)
    assert packing.pack(none, path).count() == 0


# --- 8 decontamination ---------------------------------------------------------------------------


def test_common_subsequence_equals_brute_force():
    rng = random.Random(10)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_subsequence(a, b) == table[-1, -1]


def test_decontamination_finds_copies_and_paraphrases(spark, none):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeioukstrn") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([14, 25, 45, 90]))) for i in range(20)] + [(20, None), (21, " ")]
    docs, want = [], set()
    for d in range(120):
        body = text(rng.randint(5, 300))
        if d % 3 == 0:
            i = d // 3 % 20
            item = items[i][1].split()
            if d % 2:  # one word in six replaced
                item = [rng.choice(vocab) if k % 6 == 2 else w for k, w in enumerate(item)]
            body = f"{body} {' '.join(item).upper()}, {text(30)}"
            want.add((d, i))
        docs.append((d, body, 1))
    df = spark.createDataFrame([*docs, (500, None, 1), (501, "", 1), docs[0]], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert got == want
    kept = decontamination.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({d for d, *_ in docs} - {d for d, _ in want} | {500, 501})
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0 and decontamination.keep_clean(none, bench).count() == 0


def test_candidates_equal_all_passages_compared(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 5)  # several latent spaces
    rng = random.Random(14)
    vocab = ["".join(rng.choice("aeioukstrn") for _ in range(rng.randint(2, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocab, range(300, 0, -1), k=n))
    items = [decontamination.Item(i, decontamination.words_of(text(rng.choice([14, 25, 45])).encode())) for i in range(12)]
    docs = [text(rng.randint(1, 200)) for _ in range(60)]
    for i, item in enumerate(items):  # a part of the item's words
        docs[i] += " " + " ".join(w.decode() if rng.random() < 0.75 else rng.choice(vocab) for w in item.words)
    index = decontamination.build_index(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items, rank=10)
    for cosine in (0.3, 0.5, 0.7):
        want = set()
        for d, x in enumerate(docs):
            words = decontamination.words_of(x.encode())
            ids = index.ids(words)
            for space in index.spaces:
                for k, item in enumerate(space.items):
                    weights = next(g[3][:, g[1].index(k)] for g in space.groups if k in g[1])
                    length = decontamination.passage_length(len(item.words))
                    for s in decontamination.starts(len(words), length).tolist():
                        own, weight = index.vector(ids[s : s + length])
                        close = weight @ weights[space.row[own]] / np.sqrt((index.idf[ids[s : s + length]] ** 2).sum())
                        span = words[max(0, s - length // 2) : min(len(words), s + length) + length // 2]
                        enough = max(0.6 * len(item.words), min(len(item.words), 8)) <= decontamination.common_subsequence(item.words, span)
                        if close >= cosine and enough and decontamination.common_subsequence(item.answer, span) >= 0.5 * len(item.answer):
                            want.add((d, item.item_id))
        found = decontamination.search([x.encode() for x in docs], index, cosine, 0.6)
        assert {(d, x[0].item_id) for d, own in enumerate(found) for x in own} == want and (want or cosine > 0.5)


def test_latent_space_finds_what_words_alone_miss(spark, monkeypatch):
    rng = random.Random(15)
    common = [f"common{i}" for i in range(30)]
    pairs = [(f"first{i}", f"second{i}") for i in range(60)]  # words that come together
    docs = []
    for _ in range(200):
        own = rng.sample(pairs, 5)
        docs.append(" ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rng.choice(own)) for _ in range(64)))
    items, changed = [], []
    for _ in range(8):
        own = rng.sample(pairs, 7)
        first = [rng.choice(common) for _ in range(13)]
        at = sorted(rng.sample(range(14), 7))
        mixed = [list(first), list(first)]
        for place, pair in zip(at, own):
            for side in (0, 1):
                mixed[side].insert(place, pair[side])
        items.append(" ".join(mixed[0]))
        changed.append(" ".join(mixed[1]))
    df = spark.createDataFrame([*enumerate(docs), *enumerate(changed, 1000)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    want = {(1000 + i, i) for i in range(8)}
    monkeypatch.setattr(decontamination, "RANK", 60)
    monkeypatch.setattr(decontamination, "ITEM_WEIGHT", 1.0)
    assert want <= (got := set(found())) and len(got) <= 10
    monkeypatch.setattr(decontamination, "singular_basis", lambda passages, own, column, rank: np.eye(int(column.max()) + 1, dtype=np.float32))
    assert not want & found()


# --- 9 quality -----------------------------------------------------------------------------------


def test_quality_co_training(spark, edges, none):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioukst") for _ in range(5))
    rows = []
    for i in range(500):
        good = i % 4 > 0
        words = [word() for _ in range(60)]
        rows.append((i, "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, 60, 12)) if good else " | ".join(w.upper() + "!!" for w in words), "en", f"s{i % 7}", 300, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    labels = df.where("doc_id < 200").select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    model = quality.fit(df, labels)
    held = quality.score(df, model).join(df.select("doc_id", "quality"), "doc_id").where("doc_id >= 200").collect()
    assert sum(r.kept == bool(r.quality) for r in held) >= 0.99 * len(held)
    assert sorted(r.quality for r in quality.keep_good(df, model).select("quality").distinct().collect()) == [1]
    assert quality.score(edges, model).count() == len(EDGES) and quality.score(none, model).count() == 0
    unfit = quality.fit(df, labels.where("quality = 1"))
    assert quality.score(edges, unfit).agg(F.min("score")).first()[0] == 1.0


def test_co_training_beats_no_rounds_where_both_views_tell():
    wrong = np.zeros(2, int)
    for seed in range(8):
        rng = np.random.default_rng(seed)
        y = (rng.random(3000) < 0.7).astype(int)
        content, page = rng.standard_normal((3000, 40)), rng.standard_normal((3000, 30))
        content[:, :10] += np.where(y, 0.7, -0.7)[:, None]
        page[:, :8] += np.where(y, 0.8, -0.8)[:, None]
        label = np.where(np.arange(3000) < 90, y, -1)
        for k, rounds in enumerate((0, 5)):
            p = quality.co_train(content, page, label, rounds).probability(content[90:], page[90:])
            wrong[k] += ((p >= 0.5) != (y[90:] > 0)).sum()
    assert wrong[1] < wrong[0]


def test_co_training_does_no_harm_where_a_view_tells_nothing():
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.8).astype(int)
    content, page = rng.standard_normal((3000, 20)) + 1.5 * y[:, None], rng.standard_normal((3000, 30))
    label = np.where(np.arange(3000) < 150, y, -1)
    wrong = [((quality.co_train(content, page, label, rounds).probability(content[150:], page[150:]) >= 0.5) != (y[150:] > 0)).sum() for rounds in (0, 5)]
    assert wrong[1] <= wrong[0] + 3


def test_views_are_separate():
    assert (quality.page_features("en", "s", 3) != quality.page_features("en", None, 3)).any() and quality.page_features(None, None, None).sum() == 0
    assert len(quality.content_features(None)) == len(quality.content_features(LONG.encode()))


def test_keep_good_without_or_with_other_metadata(spark, edges):
    model = quality.co_train(*(np.random.default_rng(5).standard_normal((60, len(x))) for x in (quality.content_features(b""), quality.page_features(None, None, None))), np.arange(60) % 2)
    kept = quality.keep_good(edges, model, threshold=0.0)
    assert kept.columns == edges.columns and sorted(map(str, kept.collect())) == sorted(map(str, edges.collect()))
    odd = spark.createDataFrame([(1, "a", "x", 7), (2, None, "y", None)], "doc_id int, text string, SOURCE string, n_chars int")
    want = {r.doc_id for r in quality.score(odd, model).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(odd, model).collect()} == want and quality.keep_good(odd.limit(0), model).count() == 0


# --- 10 language model ---------------------------------------------------------------------------


def test_scores_equal_a_walk_state_by_state(spark, none, edges, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1000)  # several buckets
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab[: 5 + i % 55]) for _ in range(rng.randrange(40))) for i in range(200)] + [None, "", "Unseen WORDS here"]
    texts += [texts[0]] * 3 + [" ".join(vocab * 30)]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, block string, trained long")
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    model = Walker(train)
    got = lm.score_documents(df, ~common.held_out("doc_id", 7), block_bytes=2000).collect()
    assert len(got) == len(texts)
    n, v = model.weights.tokens, model.weights.types
    for r in got:
        tokens = [*(texts[r.doc_id] or "").lower().encode().split(), b""]
        known = [model.count.get((w,), 0) for w in tokens]
        assert r.score == pytest.approx(model.score(texts[r.doc_id] or "")) and (r.n_tokens, r.train_tokens) == (len(tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in known)) and r.n_known == sum(c > 0 for c in known)
    assert lm.score_documents(none, F.lit(True)).count() == 0
    assert lm.score_documents(edges, F.lit(True)).count() == len(EDGES)
    alone = lm.score_documents(edges, F.lit(False)).select("train_tokens", "base_score").distinct().collect()
    assert [tuple(r) for r in alone] == [(0, 0.0)]


def test_listing_leaves_no_shuffle_files(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p.name for d in dirs for p in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}

    before = files()
    df = spark.createDataFrame([(i, f"a b c{i}") for i in range(50)], "doc_id long, text string")
    out = lm.score_documents(df, F.lit(True))
    end = time.time() + 5
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and out.count() == 50
    assert spark.conf.get(CLEANUP) == "false"


def test_states_sum_to_one():
    model = Walker(["a b a c", "b b", "c a", "a b a b"])
    words = [w for (w,) in (g for g in model.count if len(g) == 1)]
    for state in [(), (b"never",), *[(w,) for w in words], *[g for g in model.count if len(g) == 2 and g[1]]]:
        assert sum(model.probability(w, state) for w in [*words, b"?"]) == pytest.approx(1)


@pytest.mark.parametrize(("n", "bits"), [(0, 10), (1, 40), (5, 3), (1000, 47), (20000, 64), (3000, 12)])
def test_keys_travel_whole(n, bits):
    keys = np.sort(np.random.default_rng(n).integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
    assert (lm.unpack(lm.pack(keys, bits), n, bits) == keys).all()
