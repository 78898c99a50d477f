"""Plain versions of the training-data operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

LAST = 2**63 - 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def of(doc: int | None, text: str | None) -> tuple:
    """Where a document stands: those without an id behind all others, by a hash of their text."""
    return (1, xxhash.xxh64_intdigest((text or "").encode(), seed=42) & LAST) if doc is None else (0, doc)


def runs(marks: list[bool]) -> int:
    return sum(m and not (k and marks[k - 1]) for k, m in enumerate(marks))


def op1(rows: list[tuple], width: int = 100) -> list[tuple]:
    """rows (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    first: dict[bytes, tuple] = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            k, at = b[p : p + width], (of(d, t), p)
            first[k] = min(first.get(k, at), at)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if (of(d, t), p) > first[b[p : p + width]]:
                gone[p : p + width] = [True] * width
        out.append((d, len(b), sum(gone), runs(gone), sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def op2_gone(rows: list[tuple], width: int = 13) -> list[list[bool]]:
    first: dict[tuple, tuple] = {}
    for d, t in rows:
        w = words(t)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, of(d, t)), of(d, t))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if of(d, t) > first[tuple(w[p : p + width])]:
                gone[p : p + width] = [True] * width
        out.append(gone)
    return out


def op2(rows: list[tuple]) -> list[tuple]:
    """doc_id, n_words, n_removed, kept_sha256."""
    return [(d, len(g), sum(g), sha(b" ".join(w for w, x in zip(words(t), g, strict=True) if not x))) for (d, t), g in zip(rows, op2_gone(rows), strict=True)]


def components(nodes: list, linked) -> dict:
    """The smallest node reachable from each, over the pairs for which linked(a, b)."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {n: top(n) for n in nodes}


def op3(rows: list[tuple], cosine: float = 0.93) -> dict:
    """rows (vec_id, vector, label) of distinct ids: vec_id -> (n_links, component_id)."""
    fine = lambda v, l: l is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)  # noqa: E731, E741
    by = {i: (v, l) for i, v, l in rows}

    def linked(a, b):
        (v, l), (w, m) = by[a], by[b]
        if not fine(v, l) or not fine(w, m) or l != m or len(v) != len(w):
            return False
        return sum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in w)) >= cosine

    ids = sorted(by)
    part = components(ids, linked)
    return {i: (sum(i != j and linked(i, j) for j in ids), part[i]) for i in ids}


def op5_base(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, t = words(text), text or ""
    windows = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
    hit = [False] * len(w)
    for p in range(len(w) - 7):
        if windows[tuple(w[p : p + 8])] > 1:
            hit[p : p + 8] = [True] * 8
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit), n < 20 or 100 * sum(hit) > 30 * n


def op5_kept(rows: list[tuple], gamma=1.05, width=6.0, least=100) -> list[bool]:
    """rows (text, lang, source): the verdicts, with quantiles from lists of rounded values instead of merged counts."""
    spread = {"symbol": 0.01, "upper": 0.03, "bar": 0.03, "length": 1.0, "lines": 0.1, "repeat": 0.05, "stutter": 0.05}
    metrics, failed, pool = [], [], defaultdict(lambda: defaultdict(list))
    share = lambda a, b: a / b if b else 0.0
    for t, lang, source in rows:
        n, chars, symbols, dup, rep, bad = op5_base(t)
        w, x = words(t), t or ""
        lines = sum(bool(words(x)) for x in x.split("\n"))
        upper = sum("A" <= c <= "Z" for c in x)
        m = {"symbol": share(symbols, chars), "upper": share(upper, chars), "bar": share(x.count("|"), n), "length": share(chars, n), "lines": share(dup, lines), "repeat": share(rep, n), "stutter": share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n)}
        metrics.append(m)
        failed.append(bad)
        if not bad:
            for k, v in m.items():
                v = 2 * gamma ** math.ceil(math.log(v) / math.log(gamma)) / (1 + gamma) if v > 0 else 0.0
                for key in ((lang, source), (lang,), ()):
                    pool[key][k].append(v)
    out = []
    for (_, lang, source), m, bad in zip(rows, metrics, failed, strict=True):
        key = next((k for k in ((lang, source), (lang,)) if len(pool[k]["bar"]) >= least), ())
        ok = not bad
        for k, v in m.items():
            values = sorted(pool[key][k])
            if ok and values:
                q1, q3 = (values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
                ok = v <= q3 + width * max(q3 - q1, spread[k])
        out.append(ok)
    return out


def op6(rows: list[tuple], order: int = 3, backoff: float = 0.4) -> dict:
    """rows (doc_id, text) of distinct ids: doc_id -> score, each document against the counts of all others."""
    grams = lambda w: Counter(tuple(w[p : p + n]) for n in range(1, order + 1) for p in range(len(w) - n + 1))
    low = {d: [x.lower() for x in words(t)] for d, t in rows}
    total, size = sum((grams(w) for w in low.values()), Counter()), sum(map(len, low.values()))
    out = {}
    for d, w in low.items():
        own, rest = grams(w), size - len(w)
        count = lambda g: total[g] - own[g]  # noqa: B023, E731

        def worth(h, x):
            if h and count((*h, x)) > 0:  # noqa: B023
                return count((*h, x)) / count(h)  # noqa: B023
            if h:
                return backoff * worth(h[1:], x)
            return count((x,)) / rest if count((x,)) > 0 else backoff / (rest + 1)  # noqa: B023

        logs = [math.log10(worth(tuple(w[max(0, p - order + 1) : p]), x)) for p, x in enumerate(w)]
        out[d] = sum(logs) / len(logs) if logs else None
    return out


def luhn(s: str) -> bool:
    twice = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(s))]
    return sum(d // 10 + d % 10 for d in twice) % 10 == 0


def op8_base(text: str | None) -> list[tuple]:
    """(start, kind number, end) in order."""
    t, digits = text or "", lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def op9_print(text: str | None) -> int:
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[p : p + 3]), 42) for p in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def op9(rows: list[tuple]) -> dict:
    """rows (doc_id, text) of distinct ids: doc_id -> (fingerprint, component_id)."""
    prints = {d: op9_print(t) for d, t in rows}
    part = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    return {d: (f"{p:016x}", part[d]) for d, p in prints.items()}
