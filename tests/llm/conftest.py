from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, tid string, grp string, size string, bucket string"


def made(seed: int = 5) -> list[tuple]:
    """(doc_id, text): passages that many share, copies, near copies, periodic and very long texts, nulls, other scripts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["ÄÖ", "straße", "日本語", "naïve", "I'm", "2024"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [sentence(rng.randint(14, 60)) for _ in range(6)]
    out: list[tuple] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "ab " * 400), (6, "x" * 700), (7, "ab " * 390 + "end"), (8, "no\xa0break spaces \x1c here")]
    for k in range(9, 60):
        parts = [sentence(rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        out.append((k, rng.choice([" ", "\n", "  "]).join(parts)))
    out += [(60 + k, out[20][1]) for k in range(5)] + [(65 + k, out[30][1] + f" tail{k}") for k in range(5)]
    out.append((70, sentence(20_000)))
    out += [(71, out[-1][1][5000:9000]), (72, sentence(30) + " " + shared[0] + " " + shared[0])]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return made()


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(rows: list[tuple]):
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "d", "t", "g", "z", "b") for d, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def docs(frame, rows):
    return frame(rows).cache()


def taken(df, *names) -> list[tuple]:
    return sorted(map(tuple, df.select(*names).collect()), key=repr)
