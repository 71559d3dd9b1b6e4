"""Shingle joins and benchmark passages against brute force."""

import hashlib
import itertools
import random
import re

import pytest

from trendloom.llm import decontaminate, jaccard_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w.translate(FOLD) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return sorted(out, key=str)


def corpus(seed):
    """Copies, chains of near copies around the threshold, a passage that many share, odd rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    passage, rows = text(30), []
    for n in (8, 20, 45, 60, 120):
        for _ in range(4):
            rows.append(text(n) + (passage if r.random() < 0.7 else []))
    for start in list(rows):
        now = list(start)
        for _ in range(r.randint(0, 6)):
            now = list(now)
            for _ in range(r.randint(1, 3)):
                now[r.randrange(len(now))] = r.choice(words)
            rows.append(now)
            rows += [now] * r.randint(0, 2)
    texts = [(" " if r.random() < 0.9 else "\n\t").join(w.upper() if r.random() < 0.1 else w for w in x) for x in rows]
    texts += [None, None, "", " \n", "a", "A", "a b c d", "a  b c\td", "a b c d e", "word " * 30_000, "É é", "é É"]
    ids = r.sample(range(10_000), len(texts))
    out = list(zip(ids, texts, strict=True))
    return out + [out[3], out[3], (None, texts[5]), (None, "only here"), (ids[7], texts[9])]


@pytest.mark.parametrize(("seed", "small", "tile"), [(1, 16, 256), (2, 2, 256), (3, 2, 4)])
def test_components_equal_brute_force(frame, monkeypatch, seed, small, tile):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join.tile_pairs, "__defaults__", (tile,))
    rows = corpus(seed)
    docs = frame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as token")
    got = jaccard_join.near_duplicates(docs).drop("text_key", "component").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_no_documents(frame):
    assert jaccard_join.near_duplicates(frame([], "doc_id long, text string")).count() == 0


def hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(FOLD))
    windows = {}
    for item_id, text in items:
        w = cut(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        w, hit, found = cut(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= {x for x in windows[tuple(w[i : i + n])] if x is not None}
        if not found:
            hit = set()
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def passages(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "don't", "a.b"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([3, 9, 10, 11, 25, 40]))) for i in range(20)] + [(50, None), (51, ""), (52, "..."), (1, text(12)), (53, "x x x x x x x x x x x")]
    rows = []
    for i in range(60):
        w = text(r.randint(0, 60)).split()
        for _ in range(r.randint(0, 2)):
            piece = (r.choice(items)[1] or "").split()
            piece = piece[: r.choice([4, 9, 10, 12, 40])]
            at = r.randrange(len(w) + 1)
            w[at:at] = [p.upper() if r.random() < 0.2 else p for p in piece]
        rows.append((i, r.choice([" ", "\n", ", "]).join(w)))
    return rows + [(100, None), (101, ""), (102, "..."), (103, "x " * 20_000), rows[4], rows[4], (None, rows[5][1])], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hits_equal_brute_force(frame, seed):
    rows, items = passages(seed)
    docs = frame(rows, "doc_id long, text string").selectExpr("*", "'x' as text_key", "2 as n_hit")
    found = decontaminate.contamination(docs, frame(items, "item_id long, text string")).drop("text_key")
    assert sorted(map(tuple, found.collect()), key=str) == hits(rows, items)


def test_empty_sides(frame):
    docs, none = frame([(1, "a b c")], "doc_id long, text string"), frame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).first().n_hit == 0
    assert decontaminate.contamination(docs.where("false"), frame([(1, "a b")], "item_id long, text string")).count() == 0
