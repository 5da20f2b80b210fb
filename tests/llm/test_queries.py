"""The queries over whole tables, by SQL where there is some, else by brute force; and the pipeline."""

import math
import os
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from affinity.llm import common, licenses, queries, simhash

from brute import Walker

DATA = "/root/testdata/sf0.001"
#: With enough toxic documents to learn from.
WIDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in queries.table(spark, DATA, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_op1_scores_held_out_documents(spark):
    got = queries.op1_toxicity(spark, DATA).join(queries.table(spark, DATA, "labels"), "doc_id").collect()
    clean = [r for r in got if r.toxic == 0]
    assert clean and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in got)


def test_op2_reads_the_articles(spark):
    got = queries.op2_html(spark, DATA).collect()
    assert len(got) == queries.table(spark, DATA, "pages").count() and all(r.n_chars == len(r.text) > 0 for r in got)


def test_op4_equals_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, DATA).collect()}
    ids = sorted(docs)
    fp = np.array([simhash.fingerprint(docs[i].encode()) for i in ids], np.uint64)
    labels = common.merge_labels(np.arange(len(ids)), *np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{int(f):016x}", ids[k]) for i, f, k in zip(ids, fp, labels)}


def test_op5_counts_words(spark, docs):
    import re

    got = {r.doc_id: r for r in queries.op5_licenses(spark, DATA).collect()}
    for i, text in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = [k for p in ("cc by", "general public license", "all rights reserved") for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        base = {label for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}
        # fewest edits of each notice over all runs of about as many words, by the regex library without seeds or windows
        fuzzy = {}
        for notice, label, most in licenses.NOTICES if len(words) < 150 else []:
            found = []
            pattern = regex.compile(f"(?:{notice}){{e<={most}}}", regex.BESTMATCH)
            n = len(notice.split())
            for k in range(len(words)):
                for size in range(max(1, n - 3), n + 4):
                    run = " ".join(words[k : k + size])
                    if k + size <= len(words) and abs(len(run) - len(notice)) <= most and len(set(run) & set(notice)) > 6 and (m := pattern.fullmatch(run)):
                        found.append(sum(m.fuzzy_counts))
            if found:
                fuzzy[notice, label] = min(found)
        if len(words) < 150:
            assert got[i].base_labels == ",".join(sorted(base)) and got[i].labels == ",".join(sorted(base | {label for _, label in fuzzy}))
            assert got[i].score == pytest.approx(max([float(bool(base)), *(1 - e / len(n) for (n, _), e in fuzzy.items())]))


def test_op7_packs_every_token(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = queries.op7_packing(spark, DATA).collect()
    want = {}
    for i, text in docs.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len({r.sequence_id for r in got}) <= 1.01 * math.ceil(sum(r.length for r in got) / 4096) + 1


def test_op8_finds_verbatim_items(spark, docs):
    items = {r.item_id: r.text for r in queries.table(spark, DATA, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, DATA).collect()}
    assert {(d, i) for d, text in docs.items() for i, item in items.items() if item in text} <= got


def test_op9_agrees_with_labels(spark):
    got = queries.op9_quality(spark, DATA).join(queries.table(spark, DATA, "labels"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.9 * len(got)


def test_op10_equals_a_walk_state_by_state(spark, docs):
    model = Walker([t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    n, v = model.weights.tokens, model.weights.types
    got = {r.doc_id: r for r in queries.op10_lm(spark, DATA).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        known = [model.count.get((w,), 0) for w in [*text.encode().lower().split(), b""]]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(known), sum(c > 0 for c in known), n)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in known)) and r.score == pytest.approx(model.score(text))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    docs = queries.table(spark, WIDER, "documents")
    labels = queries.table(spark, WIDER, "labels")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, WIDER)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        left.append(docs.count())
        if name == "toxicity":
            assert docs.join(labels.where("toxic = 0"), "doc_id").count() >= 0.95 * before.join(labels.where("toxic = 0"), "doc_id").count()
        if name == "near_duplicates":
            assert docs.select(F.countDistinct("text")).first()[0] == left[-1]
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert left[0] > left[1] >= left[2] >= left[3]
    again = corpus_pipeline.run(spark, WIDER)
    assert again.count() == left[4] and sorted(again.columns) == sorted(docs.columns)
