"""Periodic runs against a search that looks at every period of every text."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import periodic_runs

FOLDER = "/root/testdata/sf0.001"


def brute(words, least=6, exponent=4):
    """(start, length, period): stretches of equal words q apart, that no smaller period explains."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                if not any(s <= i and s + size >= i + length for s, size, p in found if q % p == 0):
                    found.append((i, length, q))
            i = j + 1
    return sorted((s, size, p) for s, size, p in found)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def odd_texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(150):
        words = []
        while r.random() < 0.9 and len(words) < 150:
            unit = [r.choice("abcXÄ€") for _ in range(r.randint(1, 9))]
            times = r.choice([1, 2, 3, 4, 5, 9])
            words += unit * times + unit[: r.randrange(len(unit))]
            if r.random() < 0.2:
                words += words[-r.randint(1, 40) :] * r.randint(1, 4)
        out.append(r.choice([" ", "\n", "\t ", "\x0b\x0c\r"]).join(words))
    return out + ["", " ", "\n", "a", "a a a a a", "a a a a a a", "A a " * 4, "x\x1cy x\x1cy x y ", "  " * 8, "a\x00b " * 6]


def test_runs_equal_brute_force(monkeypatch):
    for seed in range(6):
        monkeypatch.setattr(periodic_runs, "GROUP_WORDS", [1, 100, 1 << 17][seed % 3])
        import pyarrow as pa

        texts = [*odd_texts(seed), None]
        got, at = [], 0
        for group in periodic_runs._groups(pa.array(texts, pa.string())):
            ids, borders = periodic_runs._numbered(group)
            start, length, period = (x.tolist() for x in periodic_runs.find_runs(ids, borders))
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                got.append([(s - a, n, p) for s, n, p in zip(start, length, period, strict=True) if a <= s < b])
        assert at + len(got) == len(texts)
        for text, runs in zip(texts, got, strict=True):
            assert sorted(runs) == brute((text or "").encode().split()), text


def test_digests_on_odd_rows(spark, frame):
    texts = [*odd_texts(11), None, "same words " * 9, "same words " * 9]
    rows = [(i if i % 17 else None, t, "x", i) for i, t in enumerate(texts)] + [(3, texts[3], "x", 0)] * 2
    rows += [(i, " ".join(f"w{j}" for j in range(i % 97)), "y", 1) for i in range(10_000, 10_150)]
    docs = frame(rows, "doc_id long, text string, runs string, n_runs long")
    got = [tuple(r) for r in periodic_runs.digests(docs).collect()]
    assert sorted(got, key=str) == sorted((digest(r[0], r[1]) for r in rows), key=str)
    empty = periodic_runs.digests(docs.where("false"))
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "n_runs", "start"]


def test_long_text(spark, frame):
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 5000, 30_000)]
    text = " ".join([*words, *["one"] * 40_000, *["a", "b", "c"] * 20_000, *words * 4])
    row = frame([(1, text)], "id long, text string").select(periodic_runs.periodic(F.col("text")).alias("r")).select("r.*").first()
    assert [tuple(r) for r in row["runs"]] == [(30_000, 40_000, 1), (70_000, 60_000, 3), (130_000, 120_000, 30_000)]
    assert row["collapsed"].split() == [*words, "one", "a", "b", "c", *words]


@pytest.mark.parametrize("exponent", [4, 5, 7])
def test_other_exponents(exponent):
    for text in odd_texts(3):
        words = text.split(" ")
        ids, borders = periodic_runs._numbered([[w.encode() for w in words]])
        found = periodic_runs.find_runs(ids, borders, 2, exponent)
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == brute(words, 2, exponent)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted(tuple(r) for r in periodic_runs.digests(docs).collect())
    short = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 8000]
    by_id = {r[0]: r for r in got}
    assert len(by_id) == docs.count()
    for doc_id, text in short:
        assert by_id[doc_id] == digest(doc_id, text)
