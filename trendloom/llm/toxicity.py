"""Toxicity scores: averaged subword embeddings under a linear softmax, trained together."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
DIMENSIONS = 8
SAMPLE = 8_000  # labelled rows that the model is fitted on; at most a third of them toxic
EPOCHS = 6
BATCH = 32
RATE = 1.0
SMOOTH = 1e-3  # a word as frequent as this counts half
GRAMS = (3, 4, 5, 6)
FOLDS = 5  # fold 0 is never learned from
SEED = 23
WORDS = 500_000  # scored words held at a time
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"


def words_of(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


def subwords(word: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a word and of its runs of three to six characters, its ends marked."""
    marked = f"<{word}>"
    parts = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return np.array([zlib.crc32(p.encode()) for p in parts], np.int64) % buckets


@dataclass
class Model:
    """What scoring needs of the trained model: each bucket's share in the logit of label 1, frequent words' weights, the bias.

    A text's logit is the weighted mean over its words of the mean over their subwords, since averaging and the linear layer
    commute. Words that the sample has not seen weigh 1.
    """

    shares: np.ndarray
    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> tuple[float, float]:
        """Weight, and weight times share in the logit."""
        weight = self.weights.get(word, 1.0)
        return weight, weight * float(self.shares[subwords(word, len(self.shares))].mean())


def _summed(values: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by place."""
    return np.stack([np.bincount(place, column, size) for column in values.T], axis=1).astype(np.float32)


def train(rows: Iterable[tuple[str, int]], seed: int = SEED, epochs: int = EPOCHS, dimensions: int = DIMENSIONS, buckets: int = BUCKETS) -> Model:
    """Embeddings and softmax layer fitted together by stochastic gradients (AdaGrad).

    A text is the mean of its words, frequent ones weighing less, and a word the mean of its subwords. Without rows of both
    labels all scores are the share of label 1, or a half if there are no rows.
    """
    random = np.random.default_rng(seed)
    known: dict[str, int] = {}
    parts: list[np.ndarray] = []
    bags, labels = [], []
    for text, label in rows:
        ids: dict[int, int] = {}
        for w in words_of(text or ""):
            i = known.get(w)
            if i is None:
                i = known[w] = len(parts)
                parts.append(subwords(w, buckets).astype(np.int32))
            ids[i] = ids.get(i, 0) + 1
        if ids:
            bags.append((np.array(list(ids), np.int64), np.array(list(ids.values()), np.float32)))
            labels.append(int(label))
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(buckets, np.float32), {}, float(np.log(share / (1 - share))))
    # the same share of every text, so that long texts do not decide what is frequent
    frequency = np.zeros(len(parts))
    for ids, n in bags:
        frequency[ids] += n / n.sum() / len(bags)
    weight_of = (SMOOTH / (SMOOTH + frequency)).astype(np.float32)
    texts = [(ids, n * weight_of[ids] / (n * weight_of[ids]).sum()) for ids, n in bags]
    counts_of = np.array([len(g) for g in parts])
    flat_of, first_of = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts_of)[:-1]])

    embeddings = random.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    layer, bias = random.normal(0, 0.1, (dimensions, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_e, seen_l, seen_b = np.full(buckets, 1e-8, np.float32), np.full(layer.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids = np.concatenate([texts[i][0] for i in chosen])
            weight = np.concatenate([texts[i][1] for i in chosen])
            sizes = np.array([len(texts[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            used, where = np.unique(ids, return_inverse=True)
            counts = counts_of[used]
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            flat = flat_of[np.arange(counts.sum()) + np.repeat(first_of[used] - first, counts)]
            touched, place = np.unique(flat, return_inverse=True)
            vectors = np.add.reduceat(embeddings[flat], first, axis=0) / counts[:, None]
            hidden = np.add.reduceat(vectors[where] * weight[:, None], starts, axis=0)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            p /= len(chosen)
            to_hidden, to_layer, to_bias = p @ layer.T, hidden.T @ p, p.sum(axis=0)
            to_words = _summed(np.repeat(to_hidden, sizes, axis=0) * weight[:, None], where, len(used)) / counts[:, None]
            sums = _summed(np.repeat(to_words, counts, axis=0), place, len(touched))
            seen_l += to_layer**2
            seen_b += to_bias**2
            layer -= RATE * to_layer / np.sqrt(seen_l)
            bias -= RATE * to_bias / np.sqrt(seen_b)
            seen_e[touched] += (sums**2).mean(axis=1)
            embeddings[touched] -= RATE * sums / np.sqrt(seen_e[touched])[:, None]
    weights = {w: float(weight_of[i]) for w, i in known.items() if weight_of[i] < 0.99}
    return Model(embeddings @ (layer[:, 1] - layer[:, 0]), weights, float(bias[1] - bias[0]))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, seed: int = SEED) -> Model:
    """A model of ``toxic``, learned from at most ``size`` labelled documents outside fold 0.

    Which ones is drawn by hash, a third at most with label 1; the bias is then moved to the share that label has in all of
    ``labels``. A doc_id labelled both ways counts as toxic, one that several rows bear gives its smallest text. These texts go
    to one task, which sends the model to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    one = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    total, toxic = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    drawn = one.withColumn("_draw", F.xxhash64("doc_id", F.lit(seed)))
    chosen = [drawn.where(F.col("toxic") == k).orderBy("_draw", "doc_id").limit(n).select("doc_id", "toxic") for k, n in ((1, size // 3), (0, size - size // 3))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # two numbers a row, at most ``size`` rows
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0, 0]

        def rows() -> Iterator[tuple[str, int]]:
            for batch in batches:
                for row in batch.to_pylist():
                    seen[row["toxic"]] += 1
                    yield row["text"], row["toxic"]

        model = train(rows(), seed)
        words = list(model.weights)
        yield pa.RecordBatch.from_pydict({
            "shares": [model.shares.astype("<f4").tobytes()], "words": [words], "weights": [[model.weights[w] for w in words]],
            "bias": [model.bias], "good": [seen[0]], "toxic": [seen[1]],
        })

    one_task = texts.repartition(1).sortWithinPartitions("doc_id").select("text", F.col("toxic").cast("int"))
    row = one_task.mapInArrow(learn, "shares binary, words array<string>, weights array<double>, bias double, good long, toxic long").first()
    if row is None:
        return train([])
    model = Model(np.frombuffer(bytes(row.shares), "<f4"), dict(zip(row.words, row.weights, strict=True)), row.bias)
    if row.good and row.toxic and 0 < toxic < total:
        model.bias += float(np.log(toxic / (total - toxic)) - np.log(row.toxic / row.good))
    return model


@lru_cache(maxsize=1)
def _held_words(model: str) -> dict[str, tuple[float, float]]:
    """Scored words of a model, kept by a Python worker from task to task."""
    return {}


def score(text: Column, model: Model) -> Column:
    """Probability of label 1; a text without words has that of the bias."""
    name = hashlib.sha256(model.shares.tobytes() + str(model.bias).encode()).hexdigest()

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        held, out = _held_words(name), []
        for text in texts.to_pylist():
            total = weight = 0.0
            if len(held) > WORDS:
                held.clear()
            for word in words_of(text or ""):
                known = held.get(word)
                if known is None:
                    known = held[word] = model.word(word)
                weight += known[0]
                total += known[1]
            logit = model.bias + (total / weight if weight else 0.0)
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))
        return pa.array(out, pa.float64())

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    The model is fitted on ``labels`` (doc_id, toxic) outside fold 0; held_out says whether a row is in fold 0. score is the
    probability of label 1, predicted 1 from 0.5 on. Null, empty and wordless texts have the score of the bias alone. Rows with
    a null doc_id are in fold 0. Equal texts have equal scores. Without labels all scores are a half. An empty table gives an
    empty one; other columns are not read.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
