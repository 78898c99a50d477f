"""Operator 10, toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

The network reads characters and words: a word's input is a learned embedding of the word, the mean of learned embeddings
of its character n-grams (both by hash), what word and n-grams are worth by themselves (smoothed log-odds of toxic
documents), and what its letters look like (length, foreign letters, shouted, marks behind it). Two gated recurrent
layers, one each way, read windows of WIDTH words that start every STRIDE words, attention pools the states of a window,
and a logistic unit scores it; embeddings are trained with the network. A document's score is that of its highest window;
all windows of whole texts count.

Training: at most DOCS labelled documents of each class, those of smallest hash of their id, and of each the WINDOWS
windows whose words weigh most. The log-odds that a training document sees are counted on the other half of the
sample (cross-fitting), so that the network learns what log-odds of unseen documents look like, and embeddings are left
out at random (DROPPED), so that it doesn't rest on words that it has seen. Tasks extract counts and windows; only the
count tables (of fixed size) and the bounded sample of windows reach the driver: at most 2 * DOCS * WINDOWS windows of
WIDTH words, some 5 MB, whatever the input. Every step is seeded. Labels, language, source and id are never inputs of a
score.

Nulls: a null text is empty; a text without words scores 0. Rows of labels with null ids or labels are not used. With
no training documents of both classes that have words all scores are 0. Empty tables give no rows; repeated rows have
equal scores. Ties: of windows that score alike any is the highest; a score of exactly 0.5 counts as toxic. Very long
texts are scored SCORED windows at a time. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import batch, map_batches, materialize, read_table, texts

DOCS = 2000
WINDOWS = 5
WIDTH, STRIDE = 24, 12
HIDDEN = 8
BUCKETS = 1 << 16
GRAMS = (3, 4, 5, 6)
#: Numbers of an embedding; those of a word, in order: log-odds, letters, embeddings of the word and of its n-grams.
DIM = 6
ODDS, LETTERS = 4, 4
INPUTS = ODDS + LETTERS + 2 * DIM
#: Share of words whose embeddings are left out in a training step.
DROPPED = 0.5
STEPS = 500
#: Words kept with their inputs in a task's memory, and windows scored at once.
WORDS_KEPT = 100_000
SCORED = 8192
#: Words with the marks behind them.
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+[!?*]*")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode())


def plain(word: bytes) -> bytes:
    """A word without marks, in lower case."""
    word = word.rstrip(b"!?*")
    return word.lower() if word.isascii() else word.decode(errors="replace").lower().encode()


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of the words, each framed by < and >; sorted by word."""
    framed = b"".join(b"<%s>" % w for w in words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    name = np.repeat(np.arange(len(words)), size)
    codes = np.frombuffer(framed, np.uint8).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    at, h, names, buckets = np.arange(len(codes)), codes + np.uint64(1), [], []
    for n in range(2, max(GRAMS) + 1):
        if len(h) <= 1:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            ok = at[: len(h)] + n <= end[: len(h)]
            names.append(name[: len(h)][ok])
            buckets.append((((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    if not names:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names, buckets = np.concatenate(names), np.concatenate(buckets)
    order = np.argsort(names, kind="stable")
    return names[order], buckets[order]


class Words:
    """Distinct words as the network meets them: buckets of the words, (word number, bucket) of their n-grams sorted by
    word, and what their letters look like."""

    def __init__(self, words: list[bytes]) -> None:
        low = [plain(w) for w in words]
        self.n = len(words)
        self.bucket = np.fromiter(map(word_bucket, low), np.int64, self.n)
        self.name, self.grams = gram_buckets(low)
        self.starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(self.name)), bool), self.name[1:] != self.name[:-1]]))
        self.of = self.name[self.starts]
        self.count = np.diff(np.append(self.starts, len(self.name)))
        self.letters = np.zeros((self.n, LETTERS), np.float32)
        if self.n:
            self.letters[:, 0] = np.fromiter(map(len, low), np.float32, self.n) / 10
            self.letters[:, 1] = [not w.isascii() for w in low]
            self.letters[:, 2] = [len(w) > 1 and w.isupper() for w in words]
            self.letters[:, 3] = [w[-1:] in b"!?*" for w in words]

    def fixed(self, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
        """Each word's log-odds, the largest, mean and least of its n-grams, and its letters."""
        out = np.zeros((self.n, ODDS + LETTERS), np.float32)
        out[:, 0] = word_odds[self.bucket]
        odds = gram_odds[self.grams]
        if len(self.starts):
            out[self.of, 1] = np.maximum.reduceat(odds, self.starts)
            out[self.of, 2] = np.add.reduceat(odds, self.starts) / self.count
            out[self.of, 3] = np.minimum.reduceat(odds, self.starts)
        out[:, ODDS:] = self.letters
        return out

    def embedded(self, word_table: np.ndarray, gram_table: np.ndarray) -> np.ndarray:
        """The embedding of each word, and the mean of its n-grams'."""
        out = np.zeros((self.n, 2 * DIM), np.float32)
        out[:, :DIM] = word_table[self.bucket]
        if len(self.starts):
            out[self.of, DIM:] = np.add.reduceat(gram_table[self.grams], self.starts, axis=0) / self.count[:, None]
        return out

    def some(self, which: np.ndarray) -> Words:
        """These words (numbers in order)."""
        out = Words([])
        out.n, out.bucket, out.letters = len(which), self.bucket[which], self.letters[which]
        first, count = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        first[self.of], count[self.of] = self.starts, self.count
        have = np.flatnonzero(count[which])
        out.of, out.count = have, count[which][have]
        out.starts = np.cumsum(out.count) - out.count
        out.name = np.repeat(have, out.count)
        out.grams = self.grams[np.repeat(first[which][have] - out.starts, out.count) + np.arange(len(out.name))]
        return out


def inputs(words: list[bytes], word_odds: np.ndarray, gram_odds: np.ndarray, word_table: np.ndarray, gram_table: np.ndarray) -> np.ndarray:
    """The inputs of each word."""
    w = Words(words)
    return np.concatenate([w.fixed(word_odds, gram_odds), w.embedded(word_table, gram_table)], axis=1)


def windows(n: int) -> np.ndarray:
    """Where the windows over n words start; the last one ends with the last word."""
    if n <= WIDTH:
        return np.zeros(1 if n else 0, np.int64)
    starts = np.arange(0, n - WIDTH + 1, STRIDE)
    return starts if starts[-1] == n - WIDTH else np.append(starts, n - WIDTH)


class Vocabulary:
    """Numbers of words met so far and their inputs; number 0 is padding."""

    def __init__(self, *tables: np.ndarray) -> None:
        self.tables, self.number, self.rows = tables, {}, np.zeros((1, INPUTS), np.float32)

    def numbers(self, some: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > WORDS_KEPT:
            self.number, self.rows = {}, self.rows[:1]
        new = list({w for s in some for w in s if w not in self.number})
        self.number |= zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True)
        self.rows = np.concatenate([self.rows, inputs(new, *self.tables)])
        return [np.fromiter(map(self.number.__getitem__, s), np.int64, len(s)) for s in some]


def framed(numbers: np.ndarray) -> np.ndarray:
    """All windows of a text's word numbers, padded with 0."""
    at = windows(len(numbers))[:, None] + np.arange(WIDTH)
    return np.append(numbers, 0)[np.minimum(at, len(numbers))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indexes, and the sum of the values of each."""
    order = np.argsort(index, kind="stable")
    k = index[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(values[order], starts, axis=0) if len(k) else values


class Network:
    """Parameters: for each way w (input weights), u (recurrent weights), b; attention a, c; output o, d. Tables: the
    embeddings of words and of n-grams."""

    def __init__(self, seed: int = 7) -> None:
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {f"{k}{way}": v for way in "fb" for k, v in (("w", draw(INPUTS, 3 * h)), ("u", draw(h, 3 * h)), ("b", np.zeros(3 * h, np.float32)))}
        self.p |= {"a": draw(2 * h, h), "c": draw(h, 1)[:, 0], "o": draw(2 * h, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.tables = [rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) for _ in range(2)]

    def _way(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States (time, windows, HIDDEN) from projected inputs x (time, windows, 3 HIDDEN)."""
        u, h, n = self.p["u" + way], HIDDEN, x.shape[1]
        state, out, kept = np.zeros((n, h), np.float32), np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            pre = state @ u
            rz = 1 / (1 + np.exp(-(x[t, :, : 2 * h] + pre[:, : 2 * h])))
            r, z = rz[:, :h], rz[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + r * pre[:, 2 * h :])
            after = np.where(mask[t][:, None], z * state + (1 - z) * new, state)
            if keep:
                kept.append((t, state, r, z, new, pre[:, 2 * h :]))
            state = out[t] = after
        return out, kept

    def logits(self, rows: np.ndarray, at: np.ndarray, keep: bool = False):
        """Of windows at (windows, WIDTH) into the input rows."""
        times, mask = at.T, (at.T != 0)
        both, kept = [], {}
        for way in "fb":
            projected = rows @ self.p["w" + way] + self.p["b" + way]
            states, kept[way] = self._way(way, projected[times], mask, keep)
            both.append(states)
        s = np.concatenate(both, axis=2)
        e = np.tanh(s @ self.p["a"])
        score = np.where(mask, e @ self.p["c"], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * s).sum(axis=0)
        out = pooled @ self.p["o"] + self.p["d"]
        return (out, (times, mask, kept, s, e, weight, pooled)) if keep else out

    def gradients(self, rows: np.ndarray, at: np.ndarray, label: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss, by propagation back through time; x is that of the input rows."""
        h, g = HIDDEN, {}
        out, (times, mask, kept, s, e, weight, pooled) = self.logits(rows, at, keep=True)
        d_out = (sigmoid(out) - label) * cost / cost.sum()
        g["o"], g["d"] = pooled.T @ d_out, d_out.sum(keepdims=True)
        d_pooled = d_out[:, None] * self.p["o"]
        d_weight = (s * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["c"] = np.tensordot(d_score, e, 2)
        d_e = d_score[:, :, None] * self.p["c"] * (1 - e * e)
        g["a"] = np.tensordot(s, d_e, ([0, 1], [0, 1]))
        d_s = weight[:, :, None] * d_pooled + d_e @ self.p["a"].T
        g["x"] = np.zeros(rows.shape, d_s.dtype)
        for k, way in enumerate("fb"):
            u, d_u, d_x = self.p["u" + way], np.zeros_like(self.p["u" + way]), np.zeros((*times.shape, 3 * h), np.float32)
            carry = np.zeros((at.shape[0], h), np.float32)
            for t, state, r, z, new, pre_n in reversed(kept[way]):
                d = carry + d_s[t, :, k * h : (k + 1) * h]
                on = mask[t][:, None]
                d_n, d_z = d * (1 - z) * (1 - new * new) * on, d * (state - new) * z * (1 - z) * on
                d_r = d_n * pre_n * r * (1 - r)
                d_pre = np.concatenate([d_r, d_z, d_n * r], axis=1)
                d_x[t] = np.concatenate([d_r, d_z, d_n], axis=1)
                d_u += state.T @ d_pre
                carry = np.where(on, d * z, d) + d_pre @ u.T
            x = rows[times]
            which, sums = summed(times.ravel(), (d_x @ self.p["w" + way].T).reshape(times.size, -1))
            g["x"][which] += sums
            g["u" + way], g["w" + way], g["b" + way] = d_u, np.tensordot(x, d_x, ([0, 1], [0, 1])), d_x.sum(axis=(0, 1))
        return g

    def fit(self, words: Words, fixed: np.ndarray, of: np.ndarray, at: np.ndarray, label: np.ndarray, cost: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam over shuffled batches of 256 windows, those of both classes alike often. at: windows of input rows, 0
        where there is none; row r has the inputs fixed[r] and the embeddings of word of[r]."""
        rng, m, v = np.random.default_rng(seed), {n: 0.0 for n in self.p}, {n: 0.0 for n in self.p}
        seen = [np.full(t.shape, 1e-6, np.float32) for t in self.tables]
        by = [np.flatnonzero((label == c) & (cost > 0)) for c in (0, 1)]
        for k in range(1, steps + 1):
            b = np.concatenate([rng.choice(x, 128) for x in by])
            used, local = np.unique(np.append(0, at[b]), return_inverse=True)
            local = local[1:].reshape(len(b), WIDTH)
            own = words.some(of[used[1:]])
            kept = (rng.random(own.n) >= DROPPED)[:, None] / np.float32(1 - DROPPED)
            rows = np.zeros((len(used), INPUTS), np.float32)
            rows[:, : ODDS + LETTERS] = fixed[used]
            rows[1:, ODDS + LETTERS :] = own.embedded(*self.tables) * kept
            grads = self.gradients(rows, local, label[b], cost[b])
            d = grads.pop("x")[1:, ODDS + LETTERS :] * kept
            rate = 1 - 0.9 * k / steps
            for n, g in grads.items():
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.99 * v[n] + 0.01 * g * g
                self.p[n] = (self.p[n] - 0.03 * rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
            parts = ((own.bucket, d[:, :DIM]), (own.grams, np.repeat(d[own.of, DIM:] / own.count[:, None], own.count, axis=0)))
            for table, sums, (bucket, g) in zip(self.tables, seen, parts, strict=True):
                which, total = summed(bucket, g)
                sums[which] += total * total
                table[which] -= 0.02 * rate * total / np.sqrt(sums[which])


def log_odds(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """From document counts (2, BUCKETS) and documents (2) of clean and toxic ones; rare buckets stay near 0."""
    share = (counts + 0.5) / (docs[:, None] + 1)
    return (np.clip(np.log(share[1] / share[0]), -4, 4) * np.minimum(1, counts.sum(axis=0) / 8) / 2).astype(np.float32)


COUNTED = pa.schema([("half", pa.int32()), ("toxic", pa.int32()), ("docs", pa.int64()), ("words", pa.binary()), ("grams", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = {(half, toxic): [0, np.zeros(BUCKETS, "<i4"), np.zeros(BUCKETS, "<i4")] for half in (0, 1) for toxic in (0, 1)}
    for b in batches:
        for half, toxic, text in zip(b["half"].to_pylist(), b["toxic"].to_pylist(), texts(b["text"]), strict=True):
            found, own = sums[half, toxic], list({plain(w) for w in words_of(text)})
            found[0] += 1
            found[1][np.unique(np.array([word_bucket(w) for w in own], np.int64))] += 1
            found[2][np.unique(gram_buckets(own)[1])] += 1
    yield batch(COUNTED, *zip(*((h, t, n, w.tobytes(), g.tobytes()) for (h, t), (n, w, g) in sums.items()), strict=True))


PICKED = pa.schema([("doc_id", pa.int64()), ("half", pa.int32()), ("toxic", pa.int32()), ("words", pa.binary())])


def sample(docs: DataFrame, labels: DataFrame, most: int = DOCS) -> DataFrame:
    """doc_id, toxic, half, text of at most most labelled documents of each class that are not held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.lit("sample"), "doc_id").alias("at")).distinct()
    pick = usable.filter("toxic = 1").orderBy("at", "doc_id").limit(most).unionByName(usable.filter("toxic = 0").orderBy("at", "doc_id").limit(most))
    chosen = pick.select(F.col("doc_id").alias("of"), "toxic", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).drop("of")  # at most 2 * most rows


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model: tables of log-odds and embeddings, network, middle. None without documents of both classes."""
    chosen = materialize(sample(docs, labels), "labelled").repartition(8, "doc_id")
    counts, n = np.zeros((2, 2, 2, BUCKETS)), np.zeros((2, 2))
    for r in map_batches(chosen.select("half", "toxic", "text"), _count, "half int, toxic int, docs long, words binary, grams binary").toLocalIterator():  # four rows of fixed size a task, of 8 tasks
        n[r.half, r.toxic] += r.docs
        for k, x in enumerate((r.words, r.grams)):
            counts[r.half, r.toxic, k] += np.frombuffer(x, "<i4")
    if not n.sum(axis=0).all():
        return None
    tables = lambda halves: tuple(log_odds(counts[halves, :, k].sum(axis=0), n[halves].sum(axis=0)) for k in (0, 1))
    other = [tables([1]), tables([0])]  # what each half sees

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, half, toxic, text in zip(b["doc_id"].to_pylist(), b["half"].to_pylist(), b["toxic"].to_pylist(), texts(b["text"]), strict=True):
                words = words_of(text)
                if not words:
                    continue
                x = Words(words).fixed(*other[half])
                at = windows(len(words))[:, None] + np.arange(WIDTH)
                weight = np.append(np.maximum(x[:, 0], 0) + np.maximum(x[:, 1], 0), 0)[np.minimum(at, len(words))]
                for k in np.argsort(-weight.max(axis=1) - 0.05 * weight.sum(axis=1), kind="stable")[:WINDOWS]:
                    rows.append((doc, half, toxic, b" ".join(words[at[k][0] : at[k][-1] + 1])))
            yield batch(PICKED, *(list(zip(*rows, strict=True)) or [[]] * 4))

    found = map_batches(chosen.select("doc_id", "half", "toxic", "text"), pick, "doc_id long, half int, toxic int, words binary").orderBy("doc_id", "words").collect()  # at most 2 * DOCS * WINDOWS windows
    doc, label = np.array([r.doc_id for r in found]), np.array([r.toxic for r in found], np.float32)
    if len(np.unique(label)) < 2:  # the labelled texts of a class have no words
        return None
    texts_ = [bytes(r.words).split(b" ") for r in found]
    number: dict[bytes, int] = {}
    for t in texts_:
        for w in t:
            number.setdefault(w, len(number))
    words = Words(list(number))
    # two rows for each word, one as either half sees it; row 0 is padding
    fixed = np.zeros((2 * words.n + 1, ODDS + LETTERS), np.float32)
    for half in (0, 1):
        fixed[1 + half :: 2] = words.fixed(*other[half])
    of = (np.arange(2 * words.n + 1) - 1) // 2
    at = np.zeros((len(found), WIDTH), np.int64)
    for k, (r, t) in enumerate(zip(found, texts_, strict=True)):
        at[k, : len(t)] = [2 * number[w] + 1 + r.half for w in t]
    _, first, own = np.unique(doc, return_index=True, return_inverse=True)
    truth = label[first]
    # a clean document's windows are all clean; of a toxic one those count that the network itself finds highest
    cost = np.ones(len(at), np.float32)
    net = Network()
    for k in range(2):
        net.fit(words, fixed, of, at, label, cost, steps=STEPS if k else STEPS // 2, seed=11 + k)
        rows = np.zeros((len(fixed), INPUTS), np.float32)
        rows[:, : ODDS + LETTERS] = fixed
        rows[1:, ODDS + LETTERS :] = np.repeat(words.embedded(*net.tables), 2, axis=0)
        out = net.logits(rows, at)
        top = np.full(len(first), -np.inf)
        np.maximum.at(top, own, out)
        cost = np.where(label == 1, out >= top[own] - 1.0, True).astype(np.float32)
    return {"tables": (*tables([0, 1]), *net.tables), "net": net, "middle": calibrate(top, truth)}


def calibrate(top: np.ndarray, truth: np.ndarray) -> float:
    """The cut of the highest window's logit with the best F1 on the training documents; it becomes the score 0.5."""
    order = np.argsort(-top, kind="stable")
    hit, false = np.cumsum(truth[order]), np.cumsum(1 - truth[order])
    # several cuts may do equally well: take the middle between the first and the last
    f1 = 2 * hit / (hit + false + truth.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low = top[order][min(best[-1] + 1, len(order) - 1)]
    return float((top[order][best[0]] + low) / 2)


SCORED_ROWS = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every document, from all its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(*model["tables"]) if model else None
        for b in batches:
            best = np.full(b.num_rows, -np.inf)
            if model:
                numbers = words.numbers([words_of(t) for t in texts(b["text"])])
                sizes = [len(windows(len(x))) for x in numbers]
                of, at = np.repeat(np.arange(b.num_rows), sizes), [framed(x) for x in numbers if len(x)]
                at = np.concatenate(at) if at else np.empty((0, WIDTH), np.int64)
                for s in range(0, len(at), SCORED):
                    used, local = np.unique(at[s : s + SCORED], return_inverse=True)
                    local = local.reshape(-1, WIDTH)
                    if used[0] != 0:  # row 0 stays the padding
                        used, local = np.append(0, used), local + 1
                    np.maximum.at(best, of[s : s + SCORED], model["net"].logits(words.rows[used], local))
                best = np.where(np.isfinite(best), sigmoid(best - model["middle"]), 0.0)
            yield batch(SCORED_ROWS, b["doc_id"], best if model else np.zeros(b.num_rows))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = scores(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
