"""Quality, scores, tokens, personal data, packing, toxicity and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import packing
from tidewater.llm.backoff import lm_scores, op6_stupid_backoff
from tidewater.llm.bpe import decode, digests, encode, op7_byte_bpe, vocabulary
from tidewater.llm.packing import Bin, crossover, evolve, mutate, op4_best_fit_packing, pack, pieces
from tidewater.llm.pii import base_spans, candidates, classifier, op8_pii, pii_spans, redact, reliabilities
from tidewater.llm.quality import op5_quality_rules, quality_filter, quality_verdicts
from tidewater.llm.simhash import simhash_dedup
from tidewater.llm.toxicity import DIM, INPUTS, Network, Words, op10_toxicity, toxicity, windows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OP5 = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@pytest.fixture(scope="session")
def whole(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(RANKS).rank, special_tokens={})


def taken(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def test_quality_rules(docs, rows, spark, small, whole):
    kept = brute.op5_kept([(t, "en", "s") for _, t in rows])
    assert taken(quality_verdicts(docs), *OP5) == sorted(((d, *brute.op5_base(t), k) for (d, t), k in zip(rows, kept, strict=True)), key=repr)
    kept = brute.op5_kept([r[1:] for r in whole])
    assert taken(op5_quality_rules(spark, small), *OP5) == sorted(((r[0], *brute.op5_base(r[1]), k) for r, k in zip(whole, kept, strict=True)), key=repr)


def test_quality_rules_adapt(spark):
    """A source full of bars keeps its documents; one such document elsewhere goes."""
    line = " ".join(f"word{k}" for k in range(40))
    text = lambda s, k: f"{line} item{k}" + ("".join(f" | c{j}" for j in range(40)) if s == "tables" else "")
    rows = [(k, text(s, k), "en", s) for k, s in enumerate(["tables"] * 120 + ["prose"] * 120)] + [(900, text("tables", 7), "en", "prose"), (901, text("tables", 8), None, None)]
    kept = {r.doc_id for r in quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept >= set(range(240)) and 900 not in kept


def test_rows_without_an_id_are_judged_apart(frame):
    """Clean rows stay beside failing ones of the same id or of none; unlike rows without id aren't duplicates."""
    rng = random.Random(4)
    clean = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    rows = [(None, clean()) for _ in range(20)] + [(7, clean()), (7, "too short"), (None, "short")]
    good = sorted(r for r in map(str, rows) if "short" not in r)
    assert sorted(str((r.doc_id, r.text)) for r in quality_filter(frame(rows)).collect()) == good
    assert sorted(str((r.doc_id, r.text)) for r in simhash_dedup(frame(rows[:21] + rows[:3])).collect()) == good


@pytest.mark.parametrize("order", [1, 3, 5])
def test_backoff_scores(docs, rows, order):
    got, want = {r.doc_id: r.score for r in lm_scores(docs, order).collect()}, brute.op6(rows, order)
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(s, abs=1e-9) for d, s in want.items())


def test_backoff_query(spark, small, whole):
    got, want = {r.doc_id: r.score for r in op6_stupid_backoff(spark, small).collect()}, brute.op6([r[:2] for r in whole])
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(s, abs=1e-9) for d, s in want.items())


def test_backoff_scores_of_rows_without_ids(frame):
    """Rows are documents each: null ids, shared ids and equal rows."""
    texts = ["a b c d", "a b c d", "b c d e a", "x y", None, "", "a b c d"]
    want = brute.op6(list(enumerate(texts)))
    for ids in ([None] * 7, [7] * 7, [1, 1, None, None, 2, 2, 3]):
        got = sorted(((r.doc_id, r.n_words, r.score) for r in lm_scores(frame(list(zip(ids, texts, strict=True)))).collect()), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in sorted(((d, len(brute.words(t)), want[k]) for k, (d, t) in enumerate(zip(ids, texts, strict=True))), key=str)]
        assert sorted(g[2] for g in got if g[2] is not None) == pytest.approx(sorted(x for x in want.values() if x is not None))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=300) | st.text("ab1 -='", max_size=600), max_size=4))
def test_reduction_is_the_encoding(plain, texts):
    got = vocabulary(RANKS).encode_pieces([t.encode() for t in texts])
    assert got == [plain._encode_single_piece(t.encode()) if t else [] for t in texts]


def test_bytes_and_tokens(docs, rows, spark, small, whole, plain):
    for df, texts in ((digests(docs), dict(rows)), (op7_byte_bpe(spark, small), {r[0]: r[1] for r in whole})):
        for r in df.collect():
            ids = plain.encode_ordinary(texts[r.doc_id] or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded).decode() for r in decode(encode(docs)).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_base_spans_of_hard_texts():
    parts = ["a.b@c-d.e.f@g.h", "x@y", "@a.b", "1.2.3.4.5", "0001.255.256.1", "300.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49.30.123456789012345", "+1+2 345 6789 10", "99999999999 9", "١٢٣.1.1.1", "4111111111111111@x.de", "+" + "1" * 20]
    rng = np.random.default_rng(3)
    texts = parts + ["".join(rng.choice(list("1234567890.@+- ()ab"), 80)) for _ in range(2000)] + [" ".join(rng.choice(parts, 12)) for _ in range(50)] + ["1." * 5000, "a" * 20000, "1 " * 8000]
    for t in texts:
        assert base_spans(t) == brute.op8_base(t)


def accepted(texts: list[str | None]) -> set[int]:
    n = Counter(c[3] for t in texts for c in candidates(t or "", base_spans(t or "")))
    codes = np.array(sorted(n), np.int64)
    if not len(codes):
        return set()
    weight = np.array([n[c] for c in sorted(n)], float)
    score = classifier(codes, weight, reliabilities(codes, weight))
    return set(codes[score > 0.5].tolist())


def spans(t: str, good: set[int]) -> list[tuple]:
    base = base_spans(t)
    return sorted([*base, *(c[:3] for c in candidates(t, base) if c[3] in good)])


KINDS = ("email", "ip", "card", "phone", "secret", "number")


def test_personal_data(spark, small, whole):
    good = accepted([r[1] for r in whole])
    written = lambda s: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s)
    texts = {r[0]: r[1] or "" for r in whole}
    for r in op8_pii(spark, small).collect():
        base = brute.op8_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert r.spans == written(spans(texts[r.doc_id], good))


def redacted(t: str | None, good: set[int]) -> str | None:
    if t is None:
        return None
    out, end = "", 0
    for a, k, b in spans(t, good):
        if a >= end:
            out += t[end:a] + f"[{KINDS[k].upper()}]"
        end = max(end, b)
    return out + t[end:]


def test_redaction(frame):
    rows = [(0, None), (1, ""), (2, "mail a@b.co or +1 555 123 4567, clean"), (3, "clean"), (3, "clean"), (None, "card 4111 1111 1111 1111 ip 10.0.0.1")]
    assert taken(redact(frame(rows)), "doc_id", "text") == sorted(((d, redacted(t, accepted([x[1] for x in rows]))) for d, t in rows), key=repr)
    assert pii_spans(frame(rows)).count() == len(rows)


def test_secrets_of_other_forms(frame):
    """Keys with one digit, and digits behind many letters: the votes' sum is 0 for the former."""
    rng = random.Random(2)
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    digits, small = "0123456789", "abcdefghijklmnop"
    rows = []
    for k in range(40):
        lines = [f'x token = "{some(digits + "abcdef", 40)}" y', f"the password=correcthorse{some(digits, 4)} z", f"key: AKIA{some(small, 8).upper()}7{some(small, 7).upper()} ok"]
        lines += [f"in {some(small, 5)} {some(digits, 11)} we", f"years {some(digits, 4)}-{some(digits, 4)} of", f"see {some(small, 3)}{some(small, 4).upper()}x and", f"model {some(small, 5)}{some(digits, 2)} of", "a plain sentence"]
        rows.append((k, "\n".join(lines)))
    for r in redact(frame(rows)).collect():
        before, after = rows[r.doc_id][1].split("\n"), r.text.split("\n")
        assert after[:3] == ['x token = "[SECRET]" y', "the password=[SECRET] z", "key: [SECRET] ok"]
        assert after[3:] == before[3:]


def check_packing(found: list, tokens: dict[int, list[list[int]]], slack: float) -> None:
    """Gapless sequences of at most 1024 tokens that hold each document's ids, few of them."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    for d, some in tokens.items():
        want = []
        for ids in some:
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
            want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(docs[d], key=repr) == sorted(want, key=repr)
    assert docs.keys() == tokens.keys()
    total = sum(r.length for r in found)
    assert len(bins) <= -(-total // 1024) * (1 + slack) + 1


@pytest.fixture(scope="session")
def coded():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing(frame, rows, spark, small, whole, coded):
    some = [*rows, (80, "a <|endoftext|> b"), (81, "twice"), (81, "twice"), (None, "no id")]
    tokens = defaultdict(list)
    for (d, _), ids in zip(some, coded([t for _, t in some]), strict=True):
        tokens[d].append(ids)
    check_packing(pack(pieces(frame(some))).collect(), tokens, 0.03)
    tokens = {r[0]: [ids] for r, ids in zip(whole, coded([r[1] for r in whole]), strict=True)}
    check_packing(op4_best_fit_packing(spark, small).collect(), tokens, 0.02)


def triplets(n: int, rng: random.Random) -> list[int]:
    """Sizes that fill n bins of three items each."""
    out = []
    for _ in range(n):
        a = rng.randint(257, 460)
        b = rng.randint(256, 1024 - 256 - a)
        out += [a, b, 1024 - a - b]
    return out


def test_crossover_keeps_every_item_once():
    rng = random.Random(4)
    sizes = [rng.randint(1, 600) for _ in range(200)]
    a = [[i] for i in range(200)]
    b = crossover(a, [[i] for i in reversed(range(200))], sizes, rng)
    c = crossover(b, a, sizes, rng)
    for bins in (b, c, mutate(c, sizes, rng), evolve(sizes, [a], 3)):
        assert sorted(i for x in bins for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 1024 for x in bins)


def test_a_bin_wants_what_fills_it_better():
    """The bit set by which the exchange passes over bins holds exactly the sizes that gain in one of them."""
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randint(1, 300) for _ in range(rng.randint(1, 12))]
        room = rng.randint(0, 200)
        out = [*sizes, *(a + b for k, a in enumerate(sizes) for b in sizes[k + 1 :])]
        assert Bin(range(len(sizes)), room).wanted(sizes) == sum(1 << n for n in range(1025) if any(x < n <= x + room for x in out))


def test_best_fit_builds_each_bin_once(monkeypatch):
    """Not once for each item that it takes, which was a good part of the search's time."""
    made = []
    monkeypatch.setattr(packing, "Bin", lambda items, room: made.append(room) or Bin(items, room))
    rng = random.Random(8)
    bins = packing.descending([rng.randint(1, 400) for _ in range(500)])
    assert len(made) == len(bins) < 200


def best_fit_decreasing(sizes: list[int]) -> int:
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= s), key=rooms.__getitem__, default=None)
        if k is None:
            rooms.append(1024 - s)
        else:
            rooms[k] -= s
    return len(rooms)


@pytest.mark.parametrize("n", [20, 60])
def test_evolution_beats_best_fit(n):
    sizes = triplets(n, random.Random(n))
    assert len(evolve(sizes, [], 5)) < best_fit_decreasing(sizes)


@pytest.mark.parametrize("seed", [53, 116, 147])
def test_search_goes_on_one_from_the_least(seed):
    """One sequence over the least number, where best fit ends, is no reason to stop."""
    rng = random.Random(seed)
    sizes = [rng.randint(1, 700) for _ in range(40)]
    assert best_fit_decreasing(sizes) == -(-sum(sizes) // 1024) + 1
    assert all(len(evolve(sizes, [], k)) == -(-sum(sizes) // 1024) for k in range(4))


def test_packing_beats_best_fit(spark, small, whole, coded):
    """Not more sequences than a plain best-fit decreasing packer over all pieces at once."""
    lengths = [n for ids in coded([r[1] for r in whole]) for n in ([len(ids)] if len(ids) <= 1024 else [*[len(ids) % 1024] * (len(ids) % 1024 > 0), *[1024] * (len(ids) // 1024)])]
    assert op4_best_fit_packing(spark, small).select("sequence_id").distinct().count() <= best_fit_decreasing(lengths)


def test_large_ids_beside_null_ids(frame):
    rows = [(2**53 + 1, "a"), (None, "b"), (None, None), (2**62 + 1, "c")]
    assert sorted((r.doc_id for r in pack(pieces(frame(rows))).collect()), key=str) == sorted((d for d, _ in rows), key=str)


@pytest.mark.parametrize("operator", [quality_verdicts, quality_filter, lm_scores, digests, pii_spans, redact, lambda d: pack(pieces(d))])
def test_empty_tables(frame, operator):
    assert operator(frame([(1, "a")]).limit(0)).count() == 0


def test_gradients():
    net, rng = Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = np.concatenate([np.zeros((1, INPUTS)), rng.normal(size=(40, INPUTS))])
    at, label, cost = rng.integers(0, 41, (5, 24)), np.array([0, 1, 1, 0, 1.0]), np.array([1, 0.5, 1, 1, 1.0])
    loss = lambda: float((cost * np.logaddexp(0, -(2 * label - 1) * net.logits(rows, at))).sum() / cost.sum())
    for k, g in net.gradients(rows, at, label, cost).items():
        of = rows if k == "x" else net.p[k]
        i = np.unravel_index(np.abs(g[1:] if k == "x" else g).argmax(), g.shape)
        i = (i[0] + 1, *i[1:]) if k == "x" else i
        old = of[i]
        of[i] = old + 1e-3
        up = loss()
        of[i] = old - 1e-3
        down = loss()
        of[i] = old
        assert (up - down) / 2e-3 == pytest.approx(float(g[i]), rel=0.03, abs=1e-4)


def test_inputs_of_some_words():
    rng = np.random.default_rng(1)
    tables = [rng.normal(size=(1 << 16, DIM)).astype(np.float32) for _ in range(2)]
    words = Words([b"a", b"Shout!", b"", "Ähnlich".encode(), b"stupid", b"x?"])
    which = np.array([4, 1, 1, 3])
    np.testing.assert_allclose(words.some(which).embedded(*tables), words.embedded(*tables)[which], rtol=1e-6)
    assert words.letters[1].tolist() == [0.5, 0, 0, 1] and Words([b"LOUD"]).letters[0, 2] == 1


def test_windows_cover_all_words():
    for n in range(200):
        assert {w for s in windows(n) for w in range(s, s + 24) if w < n} == set(range(n))


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"  # sf0.01 has only some 50 toxic documents to learn from
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.toxic is not None}
    got = op10_toxicity(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    pairs = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hit, false, missed = (sum(p == x for p in pairs) for x in ((1, 1), (1, 0), (0, 1)))
    assert hit and 2 * hit / (2 * hit + false + missed) >= 0.85, (hit, false, missed)


def test_toxicity_without_labels(frame, spark):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity(frame([(1, "a"), (2, None)]), none).collect()} == {0.0}


def test_toxicity_of_texts_without_words(frame, spark):
    """Labelled texts of a class that have no words teach nothing."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert {r.score for r in toxicity(frame([(k, "" if k % 2 else "plain words here") for k in range(40)]), labels).collect()} == {0.0}
    assert toxicity(frame([(1, "a")]).limit(0), labels).count() == 0


def test_pipeline(spark, small, coded):
    import corpus_pipeline

    df = spark.read.parquet(f"{small}/documents.parquet")
    docs = sorted(map(tuple, df.select("doc_id", "text", "lang", "source").collect()))
    docs = [r for r, k in zip(docs, brute.op5_kept([r[1:] for r in docs]), strict=True) if k]
    part = brute.op9([r[:2] for r in docs])
    docs = [r[:2] for r in docs if part[r[0]][1] == r[0]]
    docs = [(d, t, g) for (d, t), g in zip(docs, brute.op2_gone(docs), strict=True) if not (g and all(g))]
    run, steps = df, {}
    for name, stage in corpus_pipeline.STAGES:
        run = steps[name] = stage(spark, run, small).cache()
        if name != "packing":
            assert run.columns == df.columns
    assert sorted(r.doc_id for r in steps["near_duplicates"].collect()) >= [d for d, _, _ in docs]
    cut = {r.doc_id: r.text for r in steps["repeated_passages"].collect()}
    assert {d: brute.words(t) for d, t in cut.items()} == {d: [w for w, x in zip(brute.words(t), g, strict=True) if not x] for d, t, g in docs}
    good = accepted(list(cut.values()))
    clean = {d: redacted(t, good) for d, t in cut.items()}
    assert {r.doc_id: r.text for r in steps["personal_data"].collect()} == clean
    tokens = {d: [ids] for d, ids in zip(clean, coded(list(clean.values())), strict=True)}
    check_packing(corpus_pipeline.run(spark, small).collect(), tokens, 0.02)
