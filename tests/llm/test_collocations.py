"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from trendloom.llm import collocations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, percent, top):
    counts, out = {}, []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang or "und", Counter())[words[i : i + n]] += 1
    for lang, f in counts.items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= percent * a and inside(q) for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def texts(seed, size=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Ä", "é", "€uro", "new", "york", "NEW", "York", "\x1cx", "a\x00b"]
    rows = []
    for _ in range(size):
        parts = []
        while r.random() < 0.93:
            parts += r.choice([["new", "york", "city"], ["New", "York"], [r.choice(words)], ["of", "the"], ["in", "spite", "of", "the"]])
        text = "".join(w + r.choice([" "] * 9 + [", ", "\t", " \t ", ".", "\n", "\x0b", "?!", " "]) for w in parts)
        rows.append((text, r.choice(["en", "de", None, "und"])))
    return rows + [("", "en"), (None, "en"), (None, None), ("...", "fr"), ("once", "fr"), ("New york " * 3000, "es"), ("  ", "")]


@pytest.mark.parametrize(("least", "longest", "percent", "burst", "keys"), [(10, 3, 50, 8192, 400_000), (3, 4, 40, 2, 40), (2, 2, 50, 1, 1)])
def test_equal_to_plain_counting(spark, frame, monkeypatch, least, longest, percent, burst, keys):
    monkeypatch.setattr(collocations, "KEYS", keys)
    monkeypatch.setattr(collocations, "BURST", burst)
    rows = texts(least)
    docs = frame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, w1 string, n int").repartition(3)
    got = collocations.top_phrases(docs, 50, least, longest, percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, longest, percent, 50)
    assert collocations.top_phrases(docs.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.sql(f"SELECT {big}L a, {big + 7}L l, {big + 1}L r").select(collocations._score(*map(collocations.F.col, "alr")).alias("s")).first()
    assert row["s"] == 1_000_000 * big * big // ((big + 7) * (big + 1))


@pytest.mark.parametrize(("burst", "keys", "words"), [(1, 5, 6), (3, 1000, 6), (100, 50, 300)])
def test_trie_counts_and_spills_sorted_runs(burst, keys, words):
    """Ids that differ in their first or in their last byte only, so that containers burst at every depth."""
    r, trie, want, got = random.Random(burst), collocations.HatTrie(3, burst, keys), Counter(), Counter()
    ids = [r.choice([i, (i % 256) << 56, r.getrandbits(64)]) for i in range(1, words)]

    def take(run):
        rows = [tuple(x) for x in run[0].T.tolist()]
        assert rows == sorted(rows) and len(set(rows)) == len(rows) and len({x[0] >> 60 for x in rows}) == 1
        got.update(dict(zip(rows, run[1].tolist(), strict=True)))

    for _ in range(60):
        batch = Counter(tuple(r.choice(ids) for _ in range(3)) for _ in range(30))
        want += batch
        rows = sorted(batch)
        trie.add(np.array(rows, np.uint64).T, np.array([batch[x] for x in rows]))
        for run in [*trie.spill(), *(trie.spill(all_of_it=True) if r.random() < 0.05 else [])]:
            take(run)
        assert trie.held <= max(keys, 30)
    for run in trie.spill(all_of_it=True):
        take(run)
    assert got == want and not trie.root and not trie.held


def test_full_bitmap_changes_nothing(spark, frame, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 4)
    rows = texts(5)
    docs = frame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.top_phrases(docs, least=4).collect()) == brute(rows, 4, 3, 50, 2000)
