"""Fill-in-middle, archives and importance resampling against plain versions and their SQL."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import os
import re
import uuid
import zlib
from collections import Counter

import duckdb
import pytest

from tidewater.llm.common import new_folder
from tidewater.llm.fill_in_middle import fill_in_middle, op11_fill_in_middle, restored
from tidewater.llm.importance import bucket_counts, op13_importance_resampling, resampled
from tidewater.llm.queries import ORACLES
from tidewater.llm.warc import Bytes, arc_index, arc_record, arc_records, arc_to_warc, archived_pages, digest, iso_date, op12_warc, page_record, read_warc, split_http, warc_records, write_arc

ODD = [(900, "<P"), (901, "a<S> b"), (902, "x" * 30_000), (903, "<\n<S\n<M \x00 𝄞é"), (None, "no id at all"), (None, None), (7, "shared id"), (7, "shared id"), (904, "-" * 5000 + " ü" * 5000)]


def taken(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def by_sql(small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con.execute(ORACLES[name])


@pytest.mark.parametrize(("name", "query"), [("op11_fill_in_middle", op11_fill_in_middle), ("op12_warc", op12_warc), ("op13_importance_resampling", op13_importance_resampling)])
def test_queries_against_sql(spark, small, name, query):
    want = by_sql(small, name)
    names = [c[0] for c in want.description]
    got = query(spark, small)
    assert sorted(got.columns) == sorted(names)
    assert taken(got, *names) == sorted(want.fetchall(), key=repr)


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(spark, frame, rows):
    rows = rows + ODD
    got = taken(restored(fill_in_middle(frame(rows))), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert got == sorted((plain_fim(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame(rows).limit(0)).count() == 0


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_importance(rows, target, orders=(1, 1), buckets=10_000, percent=10, least=20):
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]
    counts = lambda t: Counter(zlib.crc32(g.encode()) % buckets for g in grams(plain_words(t)))
    docs = [(d, len(plain_words(t)), counts(t)) for d, t in rows]
    s, t = sum((c for _, _, c in docs), Counter()), sum(map(counts, target), Counter())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for d, words, c in docs:
        n = c.total()
        weight = sum(gain(b) * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("orders", "percent"), [((1, 1), 10), ((1, 3), 40), ((2, 2), 100)])
def test_importance(spark, frame, rows, orders, percent):
    rows = rows + ODD + [(None, rows[20][1]), (1000, "A b " * 50_000)]
    aim = [rows[10][1], None, "ÄÖ straße 2024 " * 40]
    got = resampled(frame(rows), spark.createDataFrame([(t,) for t in aim], "text string"), orders=orders, percent=percent)
    assert taken(got, "doc_id", "n_features", "weight", "score", "rank") == plain_importance(rows, aim, orders, percent=percent)


def test_importance_of_nothing(spark, frame, rows):
    none = spark.createDataFrame([], "text string")
    assert resampled(frame(rows).limit(0), none).count() == 0
    got = resampled(frame(rows), none, percent=50)
    assert taken(got, "doc_id", "n_features", "weight", "score", "rank") == plain_importance(rows, [], percent=50)
    counts = bucket_counts(frame([(1, "b a b"), (2, None)]), buckets=7).collect()
    assert sorted((r.doc_id, r.n_words, sum(r.counts)) for r in counts) == [(1, 3, 3), (2, 0, 0)]


PAGES = [(5, "http://a.example/x y", "<p>same</p>"), (3, "http://b.example/", "<p>same</p>"), (None, None, "<p>same</p>"), (9, "u", None), (10, "u", ""), (11, "http://c.example/é", "ü\r\n\r\n\x00end\n\n"), (12, "v", "z" * 300_000), (3, "http://b.example/", "<p>same</p>"), (None, "w", "alone"), (None, "w", "alone")]


def plain_pages(rows, least=0):
    out, answered = [], set()
    first = {}
    for d, _, h in rows:
        first.setdefault(h or "", []).append(d)
    for d, _, h in rows:
        raw, ids = (h or "").encode(), [x for x in first[h or ""] if x is not None]
        low = min(ids, default=None)
        again = len(raw) >= least and (d != low or (h or "") in answered)
        if d == low:
            answered.add(h or "")
        out.append((d, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "most"), [(0, 1 << 20), (12, 100)])
def test_pages_through_archives(spark, least, most):
    pages = spark.createDataFrame([(d, u, h, "at", "x") for d, u, h in PAGES], "page_id long, url string, html string, path string, same string").repartition(3)
    files = write_arc(pages, new_folder(spark, "t-arc"), most=most)
    records = read_warc(arc_to_warc(files, new_folder(spark, "t-warc"), least, most))
    got = taken(archived_pages(records), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == plain_pages(PAGES, least)
    assert records.filter("type in ('response', 'revisit')").select("record_id").distinct().count() == len(PAGES)
    assert {r.version for r in arc_index(files).collect()} == {1, 2}
    assert {r.url for r in records.collect()} >= {"http://a.example/x%20y", "about:blank", "http://c.example/é"}


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = write_arc(none, new_folder(spark, "t-arc"))
    assert files.count() == 0 and archived_pages(read_warc(arc_to_warc(files, new_folder(spark, "t-warc")))).count() == 0


def arc(*records: tuple[bytes, bytes]) -> bytes:
    """Header lines, the declared length behind each, and blocks."""
    return b"\n".join(line + b" %d\n" % len(block) + block for line, block in records) + b"\n\n"


ARC1 = arc(
    (b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain", b"1 0 Somebody\nURL IP-address Archive-date Content-type Archive-length\n\n"),
    (b"http://a.example/one two.html 192.0.2.7 19961104142103 text/html", b"HTTP/1.0 200 Document follows\nContent-type: text/html\n\nhello\n"),
    (b"dns:a.example 192.0.2.9 19961104 text/dns", b"1 2 3\n\n4\n"),
)
ARC2 = arc(
    (b"filedesc://new.arc 127.0.0.1 19970923142103 text/plain 200 - - 0 new.arc", b"2 0 Somebody\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n       \n"),
    (b"http://a.example/ 192.0.2.7 19961104142103 text/html 302 fac069150613fe55599cc7fa88aa089d http://b.example/ 209 new.arc", b"HTTP/1.0 302 Moved\r\n\r\n\r\n"),
)


@pytest.mark.parametrize("zipped", [False, True])
def test_old_archives(spark, tmp_path, zipped):
    """Both versions, plain and as members, with spaces in addresses, bare line feeds, short dates and a record without HTTP."""
    got = []
    for name, raw in (("one", ARC1), ("two", ARC2)):
        for r in arc_records(io.BytesIO(raw)):
            got.append((r.version, r.url, r.ip, r.status, split_http(r.block)[1] if r.block.startswith(b"HTTP") else r.block))
            again = arc_record(raw[r.at : r.end], r.at, r.version)
            assert again[2:] == r[2:] and again.at == r.at
        parts = [raw[r.at : r.end] + b"\n" for r in arc_records(io.BytesIO(raw))]
        (tmp_path / name).write_bytes(b"".join(map(gzip.compress, parts)) if zipped else raw)
    assert [g[:4] for g in got] == [(1, "filedesc://old.arc", "0.0.0.0", None), (1, "http://a.example/one two.html", "192.0.2.7", None), (1, "dns:a.example", "192.0.2.9", None), (2, "filedesc://new.arc", "127.0.0.1", 200), (2, "http://a.example/", "192.0.2.7", 302)]
    assert [g[4] for g in got[1:3]] == [b"hello\n", b"1 2 3\n\n4\n"]
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("one", "two")], "path string")
    out = arc_to_warc(files, f"file://{tmp_path}/warc")
    records = {(r.type, r.url, r.date): r for r in read_warc(out).collect()}
    answer = records["response", "http://a.example/one two.html", "1996-11-04T14:21:03Z"]
    assert (answer.payload_bytes, answer.digest) == (6, digest(b"hello\n"))
    assert records["resource", "dns:a.example", "1996-11-04T00:00:00Z"].digest == digest(b"1 2 3\n\n4\n")
    assert len(records) == 5 + (out.count() > 0)  # version blocks become warcinfo; each file has one of its own
    for r in out.collect():
        raw = gzip.open(r.path.removeprefix("file://")).read()
        assert raw.count(b"WARC/1.1\r\n") == r.records + 1 and raw.endswith(b"\r\n\r\n")
        ids = [h["warc-record-id"] for h, _ in warc_records(io.BytesIO(raw))]
        assert len(set(ids)) == len(ids) and all(uuid.UUID(i[10:-1]) for i in ids)


def test_broken_archives():
    with pytest.raises(ValueError, match="declares"):
        list(arc_records(io.BytesIO(ARC1[:-5])))
    with pytest.raises(ValueError, match="no version block"):
        list(arc_records(io.BytesIO(ARC1[140:])))
    with pytest.raises(ValueError, match="ends inside"):
        list(arc_records(io.BytesIO(gzip.compress(ARC1)[:-30])))
    with pytest.raises(ValueError, match="date"):
        iso_date("199611-4")
    bad = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha1:AAAA\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc_records(io.BytesIO(bad)))
    data = Bytes(io.BytesIO(page_record(1, "u", "t", 1)))
    assert data.begin() and data.line().startswith(b"u 0.0.0.0 ")
