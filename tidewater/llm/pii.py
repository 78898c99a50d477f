"""Operator 8, personal data by weak supervision.

The base kinds (email, ip, card, phone) are found by fixed patterns. Beyond them, strings of 7
characters and more are candidates if they have a digit or capitals among small letters, or if a word of the gazetteer
or an assignment precedes them. Labelers vote on them (+1 personal, -1 not, 0 no vote): patterns, a gazetteer of words
before them, and their context. Expectation-maximisation over the counts of vote patterns of all documents estimates how reliable each
labeler is when a candidate is personal and when not; its posteriors train a logistic span classifier over the
candidates' features. Both work on the table of distinct (votes, features) patterns, which has a fixed number of
possible rows. Candidates that the classifier accepts, whatever the sum of their votes, become spans of the kinds secret
and number; base spans stay.

A candidate has 7 characters of letters, digits, _ and - at least; its context is the CONTEXT = 40 characters before it.
Very long texts are searched whole. Ties: a score of exactly one half isn't accepted; spans of equal start are in the
order of the kinds. Nulls: a null text is empty and has no spans. Empty tables give no rows (the classifier then accepts nothing).
Repeated rows are each searched. Spans are in code points, the end exclusive. redact() keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, map_batches, materialize, read_table, texts

KINDS = ("email", "ip", "card", "phone", "secret", "number")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, so possessive repeats find the same matches without backtracking.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{7,}+")
BEFORE = re.compile(r"([^\W\d_]+)[\s\"'=:#(]*$")
#: Words before a candidate that speak for personal data and against it.
FOR_WORDS = frozenset("token password passwort passwd key secret ssn tel telefon phone call passport account konto cuenta compte iban".split())
#: What ends where a string begins that is a candidate whatever its characters.
LEAD = re.compile(rf"(?i)(?<![^\W\d_])(?:{'|'.join(sorted(FOR_WORDS))})[\s\"'=:#(]+|[=:]\s*[\"']?")
AGAINST_WORDS = frozenset("version section article page chapter license isbn doi year volume figure table".split())
#: Characters before a candidate that labelers see.
CONTEXT = 40
LABELERS = 6
FEATURES = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern; found from each @, as the part before it can't hold one."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def vote(word: str, before: str) -> tuple[int, ...]:
    """The labelers' votes on a candidate, by itself and the text before it."""
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    m = BEFORE.search(before)
    last = m[1].lower() if m else ""
    return (
        1 if re.fullmatch(r"[0-9a-fA-F]{32,}", word) else 0,  # pattern: long hexadecimal string
        1 if len(word) >= 16 and digits >= 4 and letters >= 4 else -1 if digits < 7 else 0,  # pattern: mixed string
        1 if last in FOR_WORDS else -1 if last in AGAINST_WORDS else 0,  # gazetteer
        1 if re.search(r"[=:]\s*[\"']?$", before) else 0,  # context: assigned
        1 if re.search(r"[\"']$", before) else -1 if letters == 0 and digits != len(word) else 0,  # context: quoted, or a range of numbers
        -1 if letters and digits * 4 < letters else 1 if digits >= 16 and letters else 0,  # mostly letters, or many digits among letters
    )


def features(word: str, before: str) -> tuple[int, ...]:
    """0 or 1 each."""
    digits = sum(c.isdigit() for c in word)
    return (len(word) >= 16, len(word) >= 32, digits >= 8, 0 < digits < len(word), "-" in word or "_" in word, bool(re.search(r"[=:\"']\s*$", before)))


def pattern(votes: tuple[int, ...], has: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    for f in has:
        code = 2 * code + int(f)
    return code


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The votes and features of patterns."""
    has = (codes[:, None] >> np.arange(FEATURES)[::-1]) & 1
    votes = (codes[:, None] >> FEATURES) // 3 ** np.arange(LABELERS)[::-1] % 3 - 1
    return votes, has


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, pattern) of strings beside the base spans that labelers vote on."""
    out, k, reach, led = [], 0, 0, {m.end() for m in LEAD.finditer(text)}
    for m in CANDIDATE.finditer(text):
        word = m[0]
        a, b = m.span()
        plain = word.islower() or word.isupper() or word.istitle() or not word.strip("_-")
        digits = 0 if plain and word.isalpha() else sum(c.isdigit() for c in word)
        if plain and not digits and a not in led:
            continue
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach > a:  # a base span that begins before this one's end ends behind its start
            continue
        before = text[max(0, a - CONTEXT) : a]
        out.append((a, 4 if digits < len(re.sub(r"[-_]", "", word)) else 5, b, pattern(vote(word, before), features(word, before))))
    return out


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("pattern", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(SPAN)), ("extra", pa.list_(SPAN)), ("base_sha256", pa.string())])
SPAN_SQL = "array<struct<start:long,kind:int,end:long,pattern:long>>"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = lambda s: dict(zip(("start", "kind", "end", "pattern"), s, strict=False))
    for b in batches:
        rows = []
        for t in texts(b["text"]):
            base = base_spans(t)
            rows.append(([name((*s, -1)) for s in base], [name(s) for s in candidates(t, base)], hashlib.sha256(written(base).encode()).hexdigest()))
        yield batch(FOUND, b["doc_id"], *(list(zip(*rows, strict=True)) or [[]] * 3))


def reliabilities(codes: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The posterior of each pattern, by expectation-maximisation: classes personal or not, labelers independent given
    the class, with their own rates of each vote in each class."""
    votes, _ = unpack(codes)
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))  # begins with the majority
    for _ in range(rounds):
        prior = (n * p).sum() / n.sum()
        log = np.log([max(1 - prior, 1e-9), max(prior, 1e-9)])[None, :].repeat(len(codes), 0)
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(LABELERS):
                rate = np.array([w[votes[:, j] == v].sum() + 0.5 for v in (-1, 0, 1)])
                log[:, c] += np.log(rate / rate.sum())[votes[:, j] + 1]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def classifier(codes: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Scores of the patterns by a logistic classifier over features and votes, fitted to the posteriors p."""
    votes, has = unpack(codes)
    x = np.column_stack([np.ones(len(codes)), has, votes > 0, votes < 0]).astype(float)
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):  # Newton's steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (share * (p - q)) - 1e-3 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def accepted(found: DataFrame) -> list[int]:
    """The patterns that the classifier accepts as personal data, from the candidates of all documents."""
    rows = found.select(F.explode("extra.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # at most 3^6 * 2^6 rows
    if not rows:
        return []
    codes, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    p = reliabilities(codes, n.astype(float))
    return codes[classifier(codes, n.astype(float), p) > 0.5].tolist()


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end, pattern>> in order (kind numbers as in KINDS), base_sha256."""
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(map_batches(of, _find, f"doc_id long, base {SPAN_SQL}, extra {SPAN_SQL}, base_sha256 string"), "spans")
    good = F.lit(accepted(found)).cast("array<long>")
    return found.select("doc_id", F.array_sort(F.concat("base", F.filter("extra", lambda s: F.array_contains(good, s["pattern"])))).alias("spans"), "base_sha256")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """A text with its spans (start, kind number, end), in order, replaced by their kinds."""
    end, parts = 0, []
    for a, kind, b in spans:
        if a >= end:
            parts += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join(parts) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; all columns stay, whatever their names. Of
    overlapping spans the first gives the name and all are removed. Null texts stay null."""
    found = materialize(map_batches(docs.select(F.lit(0).cast("long").alias("doc_id"), "text"), _find, f"doc_id long, base {SPAN_SQL}, extra {SPAN_SQL}, base_sha256 string").select("extra"), "candidates")
    good = set(accepted(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b["text"].to_pylist():
                base = base_spans(t or "")
                out.append(t and redacted(t, sorted([*base, *(c[:3] for c in candidates(t, base) if c[3] in good)])))
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    return map_batches(docs, run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), "base_sha256", text.alias("spans"))
