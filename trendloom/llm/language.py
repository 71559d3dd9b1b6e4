"""Language of texts: scripts narrow the candidates, words are scored by character n-grams, Viterbi labels spans.

Training is a count on Spark: every task counts the hashed character n-grams of its words by language, and the tables are
added up. A word scores the mean log probability of its n-grams, times their number up to ``WORD_GRAMS``, for every language
that its script allows. The best labelling of the words of a text, where every change of language costs ``SWITCH``, gives the
spans; it is found exactly for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import _mixed, _powers, drop_from

NONE = "und"
ORDERS = (1, 2, 3, 4)  # characters in an n-gram; a word has a mark at both ends
WORD_GRAMS = 8.0  # a word weighs as one of at most so many n-grams: they overlap, so they are no independent witnesses
SWITCH = 12.0  # what a change of language costs, in log probability
TEMPER = 4.0  # log odds of a span are divided by this before they become a score
SHARE = 0.005  # of its letters that a language must have in a script to be a candidate for it
LEAST_BUCKETS, MOST_CELLS = 1 << 14, 1 << 21  # buckets times languages: the weights take at most 8 MB
CHARS_A_BUCKET = 512
STEP = 1 << 20  # characters worked through at a time
BLOCK = 64  # words that one step of the labelling takes in

# First and last code point of the blocks of the scripts told apart; other letters are of script 0.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Latin", 0x250, 0x2AF), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Syriac", 0x700, 0x74F), ("Arabic", 0x750, 0x77F), ("Thaana", 0x780, 0x7BF),
    ("Nko", 0x7C0, 0x7FF), ("Arabic", 0x8A0, 0x8FF), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F),
    ("Gujarati", 0xA80, 0xAFF), ("Oriya", 0xB00, 0xB7F), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF),
    ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF), ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Tibetan", 0xF00, 0xFFF),
    ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x139F),
    ("Cherokee", 0x13A0, 0x13FF), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF), ("Cyrillic", 0x1C80, 0x1C8F),
    ("Georgian", 0x1C90, 0x1CBF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Georgian", 0x2D00, 0x2D2F),
    ("Cyrillic", 0x2DE0, 0x2DFF), ("Han", 0x2E80, 0x2FDF), ("Han", 0x3005, 0x3007), ("Kana", 0x3040, 0x30FF), ("Hangul", 0x3130, 0x318F),
    ("Kana", 0x31F0, 0x31FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Cyrillic", 0xA640, 0xA69F), ("Hangul", 0xA960, 0xA97F),
    ("Hangul", 0xAC00, 0xD7FF), ("Han", 0xF900, 0xFAFF), ("Latin", 0xFB00, 0xFB06), ("Hebrew", 0xFB1D, 0xFB4F), ("Arabic", 0xFB50, 0xFDFF),
    ("Arabic", 0xFE70, 0xFEFF), ("Latin", 0xFF21, 0xFF5A), ("Kana", 0xFF66, 0xFF9F), ("Han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]

SPANS = "array<struct<start: bigint, end: bigint, lang: string, score: double>>"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for letters and 2 for marks that may stand in a word; the script."""
    import regex

    kind, every = np.zeros(0x110000, np.uint8), "".join(map(chr, range(0x110000)))
    for value, letters in enumerate((r"\p{L}+", r"\p{M}+"), 1):
        for found in regex.finditer(letters, every):
            kind[slice(*found.span())] = value
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return kind, script


@dataclass
class Words:
    """Words of some texts laid end to end: letters and marks of one script, each beginning with a letter."""

    start: np.ndarray  # place of the first character
    length: np.ndarray  # characters
    letters: np.ndarray
    script: np.ndarray
    borders: np.ndarray  # first word of each text, and the end

    def parts(self, size: int = 1 << 18) -> Iterator[Words]:
        for a in range(0, len(self.start), size):
            yield Words(*(x[a : a + size] for x in (self.start, self.length, self.letters, self.script)), self.borders)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), borders


def find_words(points: np.ndarray, borders: np.ndarray) -> Words:
    kind, script = _letters()
    kinds, scripts = kind[points], script[points]
    inside = kinds > 0
    marks = np.flatnonzero(kinds == 2)
    if len(marks):  # a mark takes the script of the letter before it
        own = np.flatnonzero(kinds == 1)
        before = np.searchsorted(own, marks) - 1
        scripts[marks[before >= 0]] = scripts[own[before[before >= 0]]]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (scripts[1:] != scripts[:-1])
    starts = borders[:-1][borders[:-1] < len(points)]
    first[starts] = inside[starts]
    begin = np.flatnonzero(first)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, np.zeros(len(borders), np.int64))
    span = np.add.reduceat(inside.astype(np.int64), begin)
    letters = np.add.reduceat((kinds == 1).astype(np.int64), begin)
    real = letters > 0
    begin, span, letters = begin[real], span[real], letters[real]
    return Words(begin, span, letters, scripts[begin].astype(np.int64), np.searchsorted(begin, borders))


def _different(points: np.ndarray, words: Words) -> tuple[Words, np.ndarray, np.ndarray]:
    """Each word once, with its number of occurrences; and for every word its place among these. Told apart by 64-bit hashes."""
    ends = np.cumsum(words.length)
    place = np.arange(ends[-1]) - np.repeat(ends - words.length, words.length)
    chars = points[np.repeat(words.start, words.length) + place].astype(np.uint64) + np.uint64(1)
    hashes = _mixed(np.add.reduceat(_mixed(chars) * _powers(int(words.length.max()))[place], ends - words.length))
    _, first, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    once = Words(*(x[first] for x in (words.start, words.length, words.letters, words.script)), words.borders)
    return once, which, times


def _grams(points: np.ndarray, words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and the word of each. A word is read with a mark before and after it."""
    size = words.length + 2
    ends = np.cumsum(size)
    base = ends - size
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(of)) - base[of]
    inner = (place > 0) & (place <= words.length[of])
    chars = np.full(len(of), 1, np.uint64)
    chars[inner] = points[words.start[of[inner]] + place[inner] - 1]
    chars = _mixed(chars * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    out, owner, value = [], [], np.zeros(len(of), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value = _mixed(value[: len(of) - n + 1] + chars[n - 1 :] + np.uint64(n)) if len(of) >= n else value[:0]
        whole = place[: len(value)] + n <= size[of[: len(value)]]
        if n == 1:
            whole = whole & inner[: len(value)]
        if n in ORDERS:
            out.append((value[whole] % np.uint64(buckets)).astype(np.int64))
            owner.append(of[: len(value)][whole])
    return np.concatenate(out), np.concatenate(owner)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, texts) of about STEP characters together; a longer text is alone."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        if held and size + len(text or "") > STEP:
            yield first, held
            held, size, first = [], 0, i
        held.append(text or "")
        size += len(text or "")
    if held:
        yield first, held


def _lower(text: str) -> str:
    """Lower case, character by character where that keeps the length, so that places stay places of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Model:
    langs: list[str]  # by name
    weights: np.ndarray  # bucket x language: log probability
    allowed: np.ndarray  # script x language
    prior: np.ndarray  # log share of the rows

    def word_scores(self, points: np.ndarray, words: Words) -> np.ndarray:
        """word x language; languages that the script of a word rules out get -inf, unless it rules out all."""
        out, a = np.zeros((len(words.start), len(self.langs)), np.float64), 0
        for part in words.parts():
            once, which, _ = _different(points, part)
            grams, owner = _grams(points, once, len(self.weights))
            count, weights = np.bincount(owner, minlength=len(once.start)), self.weights[grams]
            scores = np.empty((len(count), len(self.langs)))
            for i in range(len(self.langs)):
                total = np.bincount(owner, weights[:, i], minlength=len(count))
                scores[:, i] = total / np.maximum(count, 1) * np.minimum(count, WORD_GRAMS)
            allowed = self.allowed[once.script]
            scores[~allowed] = -np.inf
            scores[~allowed.any(1)] = 0.0  # a script of no language says nothing
            out[a : a + len(which)] = scores[which]
            a += len(which)
        return out


def _training_rows(docs: DataFrame, learn: Column) -> DataFrame:
    return docs.where(F.coalesce(learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def fit(docs: DataFrame, learn: Column) -> Model:
    """A model from the ``text`` and ``lang`` of all rows for which ``learn`` is true.

    Languages are the distinct names; their number times the number of buckets is bounded by ``MOST_CELLS``, and so is what
    the driver and the tasks hold. There is a bucket for every 512 characters of the training texts, from 2^14 up to that bound.
    Without rows to learn from the model has no language.
    """
    rows = _training_rows(docs, learn)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).orderBy("lang").collect()
    if not sizes:
        return Model([], np.zeros((LEAST_BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), np.zeros(0))
    langs = [r["lang"] for r in sizes]
    room = 1 << max(0, MOST_CELLS // len(langs)).bit_length() - 1 if len(langs) < MOST_CELLS else 1
    wanted = 1 << (sum(r["chars"] for r in sizes) // CHARS_A_BUCKET).bit_length()
    buckets = min(room, max(LEAST_BUCKETS, wanted))
    counts, scripts = np.zeros((buckets, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    cells = gram_counts(rows, langs, buckets).toArrow()  # at most MOST_CELLS rows and a few for the scripts
    bucket, lang, n = (cells[name].to_numpy() for name in ("bucket", "lang", "n"))
    of_text = bucket < buckets
    counts[bucket[of_text], lang[of_text]] = n[of_text]
    scripts[bucket[~of_text] - buckets, lang[~of_text]] = n[~of_text]
    total = counts.sum(0)
    weights = np.log((counts + 0.5) / (total + 0.5 * buckets)).astype(np.float32)
    allowed = scripts >= SHARE * np.maximum(scripts.sum(0), 1)
    prior = np.array([r["rows"] for r in sizes], float)
    return Model(langs, weights, allowed & (scripts > 0), np.log(prior / prior.sum()))


def gram_counts(rows: DataFrame, langs: list[str], buckets: int) -> DataFrame:
    """(lang, bucket, n): n-grams of the texts by number of the language; from ``buckets`` on, letters of a script.

    A task sends one row per language and bucket, and holds tables for as many languages as ``MOST_CELLS`` allows.
    """
    width, number = buckets + len(SCRIPT_NAMES), {lang: i for i, lang in enumerate(langs)}

    def table_rows(tables: dict[str, np.ndarray]) -> pa.RecordBatch:
        used = {lang: np.flatnonzero(table) for lang, table in tables.items()}
        columns = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for lang, at in used.items():
            for column, values in zip(columns, (np.full(len(at), number[lang]), at, tables[lang][at]), strict=True):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = drop_from(batch, "lang").to_pylist(), drop_from(batch, "text").to_pylist()
            for lang in sorted(set(names)):
                if lang not in tables and (len(tables) + 1) * width > 2 * MOST_CELLS:
                    yield table_rows(tables)
                    tables = {}
                table = tables.setdefault(lang, np.zeros(width, np.int64))
                for _, held in _pieces([t for t, name in zip(texts, names, strict=True) if name == lang]):
                    points, borders = _code_points([_lower(t) for t in held])
                    words = find_words(points, borders)
                    for part in words.parts():
                        once, _, times = _different(points, part)
                        grams, owner = _grams(points, once, buckets)
                        np.add.at(table, grams, times[owner])
                    np.add.at(table[buckets:], words.script, words.letters)
        yield table_rows(tables)

    return rows.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def best_labels(scores: np.ndarray, borders: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The labelling of the words of each text with the largest sum of scores and prior, less ``switch`` for every change.

    Texts are cut into blocks of ``BLOCK`` words. For all blocks at once the best gain from every label before the block to
    every label at its end is worked out word by word; blocks of a text are chained in order, all texts at once; then the
    labels are read off backwards. Of equal labellings the one with the lower label wins, and staying before changing.
    """
    n, k = scores.shape
    spans = np.diff(borders)
    if not n:
        return np.zeros(0, np.int64)
    per_text = -(-spans // BLOCK)
    text_of = np.repeat(np.arange(len(spans)), per_text)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = borders[:-1][text_of] + nth * BLOCK
    size = np.minimum(BLOCK, borders[1:][text_of] - begin)
    scores = np.maximum(scores, -1e9)
    # gain[b, i, j]: best sum over the block b, after label i, ending in j
    step_cost = switch * (1 - np.eye(k))
    gain = np.broadcast_to(np.where(np.eye(k) > 0, 0.0, -1e12), (len(begin), k, k)).copy()
    for t in range(int(size.max())):
        live = np.flatnonzero(size > t)
        now = gain[live]
        now = np.maximum(now, now.max(2, keepdims=True) - switch) + scores[begin[live] + t][:, None, :]
        gain[live] = now
    # chain the blocks: best sum up to the end of each block, by label
    upto = np.zeros((len(begin), k))
    order = np.argsort(nth, kind="stable")
    steps = np.concatenate([[0], np.cumsum(np.bincount(nth))])
    for r in range(len(steps) - 1):
        at = order[steps[r] : steps[r + 1]]
        before = upto[at - 1] if r else np.broadcast_to(prior, (len(at), k))
        upto[at] = (before[:, :, None] + gain[at]).max(1)
    # read back: the label at the end of each block, last blocks first
    last = np.zeros(len(begin), np.int64)
    entry = np.zeros(len(begin), np.int64)
    for r in range(len(steps) - 2, -1, -1):
        at = order[steps[r] : steps[r + 1]]
        final = np.flatnonzero(nth[at] == per_text[text_of[at]] - 1)
        last[at[final]] = upto[at[final]].argmax(1)
        inner = np.flatnonzero(nth[at] < per_text[text_of[at]] - 1)
        last[at[inner]] = entry[at[inner] + 1]
        before = upto[at - 1] if r else np.broadcast_to(prior, (len(at), k))
        entry[at] = (before + gain[at, :, last[at]]).argmax(1)
    # inside the blocks: forward from the entry, backward from the last label
    best = np.full((len(begin), k), -1e12)
    best[np.arange(len(begin)), entry] = 0.0
    stayed = np.zeros((n, k), bool)
    came = np.zeros(n, np.int64)
    for t in range(int(size.max())):
        live = np.flatnonzero(size > t)
        now, at = best[live], begin[live] + t
        top = now.argmax(1)
        moved = now.max(1)[:, None] - switch
        stayed[at], came[at] = now >= moved, top
        best[live] = np.maximum(now, moved) + scores[at]
    labels = np.zeros(n, np.int64)
    now = last.copy()
    for t in range(int(size.max()) - 1, -1, -1):
        live = np.flatnonzero(size > t)
        at = begin[live] + t
        labels[at] = now[live]
        now[live] = np.where(stayed[at, now[live]], now[live], came[at])
    return labels


def _softmax_of(values: np.ndarray, label: np.ndarray) -> np.ndarray:
    shifted = np.exp((values - values.max(1, keepdims=True)) / TEMPER)
    return shifted[np.arange(len(label)), label] / shifted.sum(1)


def label_texts(texts: list[str | None], model: Model) -> Iterator[tuple[np.ndarray, ...]]:
    """Per text (start, end, label, score, letters) of its spans: places of first and past-the-last character of a span of words.

    The score of a span is what its words say for its language against the others.
    """
    for _, held in _pieces(texts):
        points, borders = _code_points([_lower(t) for t in held])
        words = find_words(points, borders)
        if not len(words.start) or not model.langs:
            yield from ((np.zeros(0, np.int64),) * 5 for _ in held)
            continue
        scores = model.word_scores(points, words)
        labels = best_labels(scores, words.borders, model.prior)
        first = np.r_[True, labels[1:] != labels[:-1]]
        first[words.borders[:-1][words.borders[:-1] < len(labels)]] = True
        begin = np.flatnonzero(first)
        past = np.append(begin[1:], len(labels)) - 1
        sums = np.add.reduceat(np.maximum(scores, -1e9), begin, axis=0)
        letters = np.add.reduceat(words.letters, begin)
        surety = _softmax_of(sums, labels[begin])
        cuts = np.searchsorted(begin, words.borders)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            ends = words.start[past[a:b]] + words.length[past[a:b]]
            yield words.start[begin[a:b]] - borders[i], ends - borders[i], labels[begin[a:b]], surety[a:b], letters[a:b]


def language(text: Column, model: Model) -> Column:
    """A struct of ``lang``, ``score`` and ``spans`` (start and end in characters, lang, score).

    ``lang`` is that of the spans with the most letters, each counted by its score (ties: the name that comes first), and
    ``score`` their share. Null texts, texts without a letter and a model without languages give 'und', 0 and no spans. Texts
    are taken whole; all of a text's words are labelled together.
    """
    names = pa.array([*model.langs, NONE], pa.string())

    @F.arrow_udf(f"struct<lang: string, score: double, spans: {SPANS}>")
    def label(column: pa.Array) -> pa.Array:
        best, surety, counts, parts = [], [], [0], []
        for start, end, labels, score, letters in label_texts(column.to_pylist(), model):
            counts.append(counts[-1] + len(start))
            parts.append((start, end, labels, score))
            if len(start):
                weight = np.bincount(labels, letters * score, minlength=len(model.langs))
                best.append(int(weight.argmax()))
                surety.append(min(1.0, float(weight.max() / letters.sum())))
            else:
                best.append(len(model.langs))
                surety.append(0.0)
        start, end, labels, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
        spans = [pa.array(start, pa.int64()), pa.array(end, pa.int64()), names.take(pa.array(labels, pa.int64())), pa.array(score, pa.float64())]
        spans = pa.StructArray.from_arrays(spans, ["start", "end", "lang", "score"])
        lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)
        columns = [names.take(pa.array(best, pa.int64())), pa.array(surety, pa.float64()), lists]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "spans"])

    return label(text)


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the decimal id leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out and have an id, tried on all."""
    model = fit(docs, ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    found = docs.select("doc_id", language(F.col("text"), model).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
