"""The toxicity model: what it learns, and that it learns from the right rows."""

import random
import zlib

import numpy as np
import pytest

from trendloom.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_unseen_misspellings_share_vectors():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [([r.choice(words) for _ in range(30)], i % 2) for i in range(400)]
    model = toxicity.train(((" ".join([*w, "scoundrel"] if y else w), y) for w, y in rows), dimensions=4, buckets=1 << 14)
    share = lambda w: model.word(w)[1] / model.word(w)[0]
    usual = np.mean([share(w) for w in words])
    assert share("scoundrel") > share("scoundrell") > usual and share("sc0undrel") > usual


def test_no_labels_or_one():
    assert toxicity.train([]).bias == 0.0
    assert toxicity.train([("a", 1), ("b", 1)]).bias > 3
    assert toxicity.train([("", 1), (None, 0)]).bias == 0.0


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.toxicity(docs.join(labels, "doc_id", "left_semi"), labels).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()


def test_held_out_rows(scored):
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    held = scored[scored.held_out]
    assert ((held.score >= 0) & (held.score <= 1)).all() and (held.predicted == (held.score >= 0.5)).all()
    rank = held.score.rank()
    toxic = held.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.88 and (held.predicted == held.toxic).mean() > 0.91


def test_odd_rows(frame):
    docs = frame([(7, "one text"), (7, "another text"), (1, None), (2, ""), (3, "..."), (None, "idiot"), (4, "fine day"), (4, "fine day"), (5, "x" * 200_000), (6, "w " * 50_000)], "doc_id long, text string")
    labels = frame([(1, 1, 1), (2, 1, 0), (4, None, None), (None, 1, 1), (99, 1, 0), (2, 1, 0), (7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs.selectExpr("*", "1 as toxic", "'x' as score"), labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [True]
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert toxicity.toxicity(docs.where("false"), labels.where("false")).count() == 0


def plain_train(rows, seed, epochs, dimensions, buckets):
    """The same fit in loops over single numbers; the gradients come from finite differences of the loss."""
    random = np.random.default_rng(seed)
    texts = []
    for text, label in rows:
        words = toxicity.words_of(text or "")
        if words:
            texts.append(({w: words.count(w) for w in dict.fromkeys(words)}, label, len(words)))
    frequency = {}
    for counts, _, n in texts:
        for w, c in counts.items():
            frequency[w] = frequency.get(w, 0.0) + c / n / len(texts)
    weight_of = {w: toxicity.SMOOTH / (toxicity.SMOOTH + f) for w, f in frequency.items()}
    e = random.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions))
    layer, bias = random.normal(0, 0.1, (dimensions, 2)), np.zeros(2)
    seen_e, seen_l, seen_b = np.full(buckets, 1e-8), np.full(layer.shape, 1e-8), np.full(2, 1e-8)

    def loss(chosen):
        total = 0.0
        for i in chosen:
            counts, label, _ = texts[i]
            whole = sum(c * weight_of[w] for w, c in counts.items())
            hidden = sum(c * weight_of[w] / whole * e[toxicity.subwords(w, buckets)].mean(0) for w, c in counts.items())
            logits = hidden @ layer + bias
            total += np.log(np.exp(logits).sum()) - logits[label]
        return total / len(chosen)

    def gradient(values, chosen, at):
        out = np.zeros_like(values)
        for i in at:
            old = values[i]
            values[i] = old + 1e-5
            up = loss(chosen)
            values[i] = old - 1e-5
            out[i] = (up - loss(chosen)) / 2e-5
            values[i] = old
        return out

    for _ in range(epochs):
        order = random.permutation(len(texts))
        for a in range(0, len(order), toxicity.BATCH):
            chosen = order[a : a + toxicity.BATCH]
            touched = sorted({int(b) for i in chosen for w in texts[i][0] for b in toxicity.subwords(w, buckets)})
            of_e = gradient(e, chosen, [(b, d) for b in touched for d in range(dimensions)])
            of_l, of_b = gradient(layer, chosen, list(np.ndindex(layer.shape))), gradient(bias, chosen, [(0,), (1,)])
            seen_l += of_l**2
            seen_b += of_b**2
            layer -= toxicity.RATE * of_l / np.sqrt(seen_l)
            bias -= toxicity.RATE * of_b / np.sqrt(seen_b)
            for b in touched:
                seen_e[b] += (of_e[b] ** 2).mean()
                e[b] -= toxicity.RATE * of_e[b] / np.sqrt(seen_e[b])
    return e @ (layer[:, 1] - layer[:, 0]), weight_of, bias[1] - bias[0]


def test_training_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "BATCH", 5)
    rows = [("good day", 0), ("bad bad fool", 1), ("day", 0), ("", 1), ("fool", 1), (None, 0), ("nice day, good", 0), ("a fool", 1)]
    model = toxicity.train(rows, seed=4, epochs=2, dimensions=2, buckets=64)
    shares, weights, bias = plain_train(rows, 4, 2, 2, 64)
    assert np.allclose(model.shares, shares, atol=2e-3) and abs(model.bias - bias) < 2e-3
    for word in ("good", "fool", "foool", "unseen"):
        weight, product = model.word(word)
        assert weight == pytest.approx(weights.get(word, 1.0), rel=1e-4)
        assert product == pytest.approx(weight * shares[toxicity.subwords(word, 64)].mean(), abs=5e-3)
