"""Repeated strings and near duplicates against plain versions."""

from __future__ import annotations

import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import made
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.backoff import lm_scores
from tidewater.llm.bpe import digests
from tidewater.llm.common import connected_components, materialize
from tidewater.llm.embedding_dedup import embedding_links, op3_embedding_dedup
from tidewater.llm.packing import pack, pieces
from tidewater.llm.pii import pii_spans, redact
from tidewater.llm.quality import quality_filter
from tidewater.llm.simhash import op9_simhash_dedup, simhash_components, simhash_dedup
from tidewater.llm.substring_dedup import Index, WaveletTree, op2_substring_dedup, substring_dedup, substring_filter
from tidewater.llm.suffix_dedup import collection_index, op1_suffix_dedup, suffix_dedup

OP1 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
OP2 = ("doc_id", "n_words", "n_removed", "kept_sha256")


def taken(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def whole(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def test_suffix_dedup(docs, rows):
    assert taken(suffix_dedup(docs), *OP1) == sorted(brute.op1(rows), key=repr)


def test_substring_dedup(docs, rows):
    assert taken(substring_dedup(docs), *OP2) == sorted(brute.op2(rows), key=repr)


def test_repeated_rows_and_null_ids(frame):
    rows = made(9)[:40]
    rows += [rows[k] for k in (3, 3, 7)] + [(None, t) for _, t in rows[10:14]] + [(rows[20][0], rows[21][1])]
    assert taken(suffix_dedup(frame(rows)), *OP1) == sorted(brute.op1(rows), key=repr)
    assert taken(substring_dedup(frame(rows)), *OP2) == sorted(brute.op2(rows), key=repr)
    assert simhash_components(frame(rows)).count() == len(rows)
    assert simhash_dedup(frame(rows)).groupBy("doc_id").count().filter("count > 1").count() == 0


def passages(ids: list) -> list[tuple]:
    """One text for each id; all share a passage of 60 words, behind words of their own."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shared = " ".join(word() for _ in range(60))
    return [(d, " ".join([*(word() for _ in range(20)), shared, *(word() for _ in range(5 + k))])) for k, d in enumerate(ids)]


@pytest.mark.parametrize("ids", [[2**63 - 1, None, None], [None, None, None], [-(2**63), 5, 2**63 - 1, 2**63 - 2]])
def test_ends_of_the_ids_and_none(frame, ids):
    """A passage stays once, in the first document; rows without an id come last and are documents each."""
    rows = passages(ids)
    for found, names, plain in ((suffix_dedup(frame(rows)), OP1, brute.op1(rows)), (substring_dedup(frame(rows)), OP2, brute.op2(rows))):
        found = taken(found, *names)
        assert found == sorted(plain, key=repr)
        assert sum(r[2] == 0 for r in found) == 1
        assert sorted((r[0] for r in found), key=repr) == sorted(ids, key=repr)


def test_substring_filter_without_ids(frame):
    kept = [r.text.split() for r in substring_filter(frame(passages([None, None, 7, None]))).collect()]
    assert sorted(map(len, kept)) == [20 + 5, 20 + 6, 20 + 8, 20 + 60 + 7]


def test_pipeline_without_ids(spark, frame, tmp_path):
    """run() over documents of which most have no id, with columns named as the operators' own."""
    import corpus_pipeline

    rows = passages([None, None, 7, None])
    frame([*rows, (None, None), (None, ""), (9, "few words")]).write.parquet(f"{tmp_path}/documents.parquet")
    left = [(d, t if d else " ".join([*t.split()[:20], *t.split()[80:]])) for d, t in rows]
    coded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([t for _, t in left], add_special_tokens=False)
    want = [(d, 0, 0, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())) for (d, _), e in zip(left, coded, strict=True)]
    assert taken(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)


def test_pipeline_of_nothing(spark, frame, tmp_path):
    import corpus_pipeline

    frame([(1, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_passage_in_very_many_contexts(frame):
    """A class of more segments than one index takes."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    fixed = " ".join(word() for _ in range(10))
    rows = [(k, " ".join([*(word() for _ in range(7)), fixed, *(word() for _ in range(7))])) for k in range(7000)]
    rows += [(7000 + k, rows[k][1][20:150]) for k in range(300)]
    assert taken(suffix_dedup(frame(rows)), *OP1) == sorted(brute.op1(rows), key=repr)
    assert taken(substring_dedup(frame(rows)), *OP2) == sorted(brute.op2(rows), key=repr)


def test_a_minimizer_that_comes_again_in_one_document_only(frame):
    """The last words of a passage are repeated behind it; a second document holds the passage without that."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    rows = []
    for k in range(60):
        passage = words(15)
        again, plain = [*words(9), *passage, *passage[-5:], *words(9)], [*words(9), *passage, *words(9)]
        rows += [(2 * k, " ".join((again, plain)[k % 2])), (2 * k + 1, " ".join((plain, again)[k % 2]))]
    assert taken(suffix_dedup(frame(rows)), *OP1) == sorted(brute.op1(rows), key=repr)
    assert taken(substring_dedup(frame(rows)), *OP2) == sorted(brute.op2(rows), key=repr)


def test_different_texts_whose_hashes_begin_alike(frame):
    """Each pair has one minimizer, and hashes whose upper 32 bits are equal."""
    start = "lpoipp pbhjeg kmjckn difoah ogcmpp oflpjo jchjel gpdkbc ihhhni fpofdd cijkop "
    rows = [(1, start + "gconmi bhoobl"), (2, start + "ddafin dkjfga")]
    assert taken(substring_dedup(frame(rows)), *OP2) == sorted(brute.op2(rows), key=repr)
    rows = [(1, start + "ijbkknjmecjphldjpibnfjc"), (2, start + "ijbbllengnbndfpipannafk")]
    assert taken(suffix_dedup(frame(rows)), *OP1) == sorted(brute.op1(rows), key=repr)


def test_string_queries(spark, small):
    rows = whole(spark, small)
    assert taken(op1_suffix_dedup(spark, small), *OP1) == sorted(brute.op1(rows), key=repr)
    assert taken(op2_substring_dedup(spark, small), *OP2) == sorted(brute.op2(rows), key=repr)


def test_substring_filter_keeps_columns_and_clean_documents(frame, rows):
    found = {r.doc_id: r for r in substring_filter(frame(rows)).collect()}
    assert found[9].__fields__ == frame(rows[:1]).columns
    for (d, t), gone in zip(rows, brute.op2_gone(rows), strict=True):
        if gone and all(gone):
            assert d not in found
        elif not any(gone):
            assert found[d].text == t
        else:
            assert brute.words(found[d].text) == [w for w, g in zip(brute.words(t), gone, strict=True) if not g]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", max_size=30).map(str.encode), max_size=8))
def test_collection_index(strings):
    name, place, common = collection_index(strings, 12)
    want = sorted((s[p:], k, p) for k, s in enumerate(strings) for p in range(len(s)))
    assert list(zip(name.tolist(), place.tolist(), strict=True)) == [(k, p) for _, k, p in want]
    for k in range(1, len(want)):
        a, b = want[k - 1][0], want[k][0]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == min(same, 12)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=200))
def test_wavelet_rank(values):
    v = np.array(values)
    to = np.arange(len(v) + 1)
    for x in {0, 40, *values[:3]}:
        got = WaveletTree(v, 41).rank(np.full(len(to), x), to, np.zeros(len(to), np.int64))[0]
        assert got.tolist() == [values[:k].count(x) for k in range(len(v) + 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(5, 7), min_size=3, max_size=20)), min_size=1, max_size=6))
def test_full_text_index(rows):
    doc = np.array([d for d, _ in rows])
    index = Index([np.array(t) for _, t in rows], doc, 3)
    held = {}
    for d, t in rows:
        for p in range(len(t) - 2):
            held.setdefault(tuple(t[p : p + 3]), []).append(d)
    want = {(k, p) for k, (d, t) in enumerate(rows) for p in range(len(t) - 2) if min(held[tuple(t[p : p + 3])]) < d}
    assert {(k, p + j) for k, p, n in zip(*(x.tolist() for x in index.intervals(doc, 3)), strict=True) for j in range(n)} == want
    held = {(d, tuple(t[p : p + n])) for d, t in rows for n in (1, 2, 3) for p in range(len(t) - n + 1)}
    longest = [max((n for n in (1, 2, 3) if n <= e + 1 and any((x, tuple(t[e + 1 - n : e + 1])) in held for x in range(d))), default=0) for d, t in rows for e in range(len(t))]
    assert index.statistics(doc, 3).tolist() == longest


def test_simhash(frame, rows, spark, small):
    got = simhash_components(frame(rows)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    want = brute.op9(rows)
    assert {r[0]: (r[1], r[2]) for r in got} == want
    kept = simhash_dedup(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({p for _, p in want.values()})
    assert kept.columns == frame(rows[:1]).columns
    got = op9_simhash_dedup(spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute.op9(whole(spark, small))


def test_simhash_broadcasts_nothing(frame, rows, monkeypatch):
    """No table of fingerprints, links or components goes whole through the driver, however small Spark takes it for."""
    plans = []

    def seen(df, name, clean=False):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name, clean)

    monkeypatch.setattr("tidewater.llm.common.materialize", seen)
    monkeypatch.setattr("tidewater.llm.simhash.materialize", seen)
    plans.append(simhash_components(frame(rows))._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(100, 100), (200, 150), (150, 175), (300, 175), (0, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {150: 150, 175: 150, 200: 150, 300: 150}


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    v = [(k, (centre[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])).astype(np.float32).tolist(), k % 3) for k in range(400)]
    v += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, v[0][1], None), (405, v[0][1], 0), (406, v[0][1][:8], 0), (407, [], 0), (408, [float("inf"), *v[0][1][1:]], 0), (409, [2 * x for x in v[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in v], "vec_id long, embedding array<float>, label int, id string, n string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df).collect()}
    assert got == brute.op3(v)


def test_vectors_of_one_id(spark):
    """Rows that share an id, or have none, are vectors of their own; doubles are compared as doubles."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (5, [1.0, 0.01], 0), (6, [0.01, 1.0], 0), (7, [0.0, 1.0], 0), (None, [0.5, -0.5], 0), (None, [0.5, -0.5], 0), (8, [-1.0, 0.0], 0)]
    far = math.sqrt(1 / 0.93**2 - 1)
    rows += [(10, [1.0, 0.0], 1), (11, [1.0, far * (1 - 1e-12)], 1), (12, [1.0, 0.0], 2), (13, [1.0, far * (1 + 1e-12)], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_links(df).collect()), key=str)
    want = [(1, 1, 1), (1, 2, 1), (5, 1, 1), (6, 2, 1), (7, 2, 1), (None, 1, None), (None, 1, None), (8, 0, 8), (10, 1, 10), (11, 1, 10), (12, 0, 12), (13, 0, 13)]
    assert got == sorted(want, key=str)


def test_embedding_query(spark, small):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = op3_embedding_dedup(spark, small).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute.op3(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup, simhash_components, simhash_dedup, substring_filter])
def test_empty_tables(frame, operator):
    assert operator(frame([(1, "a")]).limit(0)).count() == 0


def test_empty_vectors(spark):
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


#: Every name that an operator gives to a column of its own.
OWN = "doc tid _id _tid bad_doc_id bad_tid bad_lang bad_source _runs _doc _had _spans kept_id part fp grp of l s text_ _text at key h pos rank"


@pytest.mark.parametrize("stage", [quality_filter, simhash_dedup, substring_filter, redact, lambda d: d.sparkSession.createDataFrame(pack(pieces(d)).collect()), lm_scores, digests, pii_spans, suffix_dedup, substring_dedup])
def test_clashing_names(spark, stage):
    """Columns may have any name besides; filters keep them and their values."""
    names, clean = OWN.split(), " ".join(f"word{k}x" for k in range(40))
    rows = [(k, f"{clean} {k}", "en", "s", *names) for k in range(4)] + [(None, None, None, None, *names), (9, "", "en", "s", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = stage(df)
    assert out.count() > 0
    if stage in (quality_filter, simhash_dedup, substring_filter, redact):
        assert out.columns == df.columns
        assert all(r[n] == n for r in out.collect() for n in names)


def test_no_checkpoint_folder(spark, monkeypatch):
    """Where the session has no spark.checkpoint.dir, tables go to a folder of the module's own."""
    from tidewater.llm import common

    known = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: None if key == "spark.checkpoint.dir" else known(key, *a))
    assert common.checkpoint_root(spark) == common.checkpoint_root(spark)
    assert common.materialize(spark.range(3), "few").count() == 3
