"""Phrase collocations: n-grams counted in HAT-tries, scored by the least likely of their cuts.

Phrases are counted length by length. A phrase can only be frequent if the two phrases that lack its last and its first word
are, so before the next length is counted the frequent phrases are written as a bitmap of their hashes (at most 16 MB), which
every task reads; what the bitmap lets through by chance is counted and dropped, so counts are exact at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import _FOLD, _mixed, _powers, drop_from, flat_bytes
from trendloom.session import cut

LEAST, LONGEST, TOP = 10, 3, 2000
PERCENT = 50  # of the occurrences of a phrase that a longer candidate must have to absorb it
NO_LANG = "und"
BURST = 8192  # keys in a container before it bursts
KEYS = 1_000_000  # keys in the tries of a task before whole subtrees are spilled: about 80 MB
WORDS = 300_000  # words that a task holds before it sends their counts
GATHER = 400_000  # phrases added to the tries at a time
MOST_BITS = 1 << 27
STEP = 1 << 20  # bytes worked through at a time

# What ends a piece, and what parts words inside one.
ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + list(range(10, 14)))
BLANK = np.isin(np.arange(256), [32, 9])
_APART = ENDS | BLANK
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_FOLD]

# Spark moves a rank limit ahead of the shuffle only up to this rank.
SETTINGS = {"spark.sql.optimizer.windowGroupLimitThreshold": "10000"}


class Pieces:
    """Words of texts laid end to end: 64-bit hash (A-Z lower-cased), bytes, and whether a word follows on the one before."""

    def __init__(self, texts: pa.Array):
        self.flat, borders = flat_bytes(texts)
        word = ~_APART[self.flat]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = borders[:-1][borders[:-1] < len(word)]
        first[edges] = word[edges]
        self.begin = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[edges[edges > 0] - 1] = word[edges[edges > 0] - 1]
        self.end = np.flatnonzero(last) + 1
        self.hashes = self._hashes()
        breaks = np.flatnonzero(ENDS[self.flat])
        pieces = np.searchsorted(breaks, self.begin) + np.searchsorted(borders[1:], self.begin, "right")
        self.follows = np.r_[False, pieces[1:] == pieces[:-1]] if len(self.begin) else np.zeros(0, bool)
        self.text_of = np.searchsorted(borders[1:], self.begin, "right")

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self.begin), np.uint64)
        a = 0
        while a < len(out):  # words of about STEP bytes, at least one
            b = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + STEP)))
            size = self.end[a:b] - self.begin[a:b]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) - np.repeat(ends - size, size)
            values = _BYTE[self.flat[np.repeat(self.begin[a:b], size) + place]] * _powers(int(size.max()))[place]
            out[a:b] = _mixed(np.add.reduceat(values, ends - size))
            a = b
        return out

    def words(self, at: np.ndarray) -> list[bytes]:
        """The words at these places, A-Z lower-cased."""
        text = _FOLD.astype(np.uint8)[self.flat].tobytes()
        return [text[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]

    def starts(self, n: int) -> np.ndarray:
        """Places from which n words lie in one piece."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        for i in range(1, n):
            at = at[self.follows[at + i]]
        return at


def phrase_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases, for the bitmap."""
    out = lang
    for i, w in enumerate(words):
        out = _mixed(out + w + np.uint64(i + 1))
    return out


class Container:
    """A hash table from the ids of a phrase to its count, in arrays, with open addressing; whole batches are added at once."""

    def __init__(self, n: int):
        self.n, self.held = n, 0
        self._room(64)

    def _room(self, size: int) -> None:
        self.mask = np.uint64(size - 1)
        self.ids = np.zeros((self.n, size), np.uint64)
        self.counts = np.zeros(size, np.int64)  # 0: free
        self.claims = np.zeros(size, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds the columns of ``ids``, all different."""
        if 2 * (self.held + len(counts)) > len(self.counts):
            old_ids, old_counts = self.rows()
            self.held = 0
            self._room(1 << int(4 * (len(old_counts) + len(counts))).bit_length() - 1)
            self._insert(old_ids, old_counts)
        self._insert(ids, counts)

    def _insert(self, ids: np.ndarray, counts: np.ndarray) -> None:
        slot = np.zeros(len(counts), np.uint64)
        for column in ids:
            slot = _mixed(slot + column)
        slot = (slot & self.mask).astype(np.int64)
        todo = np.arange(len(counts))
        while len(todo):
            at = slot[todo]
            free = self.counts[at] == 0
            wanted = todo[free]
            self.claims[slot[wanted]] = wanted  # of several, one gets the place
            won = wanted[self.claims[slot[wanted]] == wanted]
            self.ids[:, slot[won]] = ids[:, won]
            self.counts[slot[won]] = counts[won]
            self.held += len(won)
            met = todo[~free]
            same = (self.ids[:, slot[met]] == ids[:, met]).all(0)
            self.counts[slot[met[same]]] += counts[met[same]]
            lost = wanted[self.claims[slot[wanted]] != wanted]
            on = met[~same]
            slot[on] = (slot[on] + 1) & np.int64(self.mask)
            todo = np.concatenate([lost, on])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.counts)
        return self.ids[:, used], self.counts[used]


class HatTrie:
    """Counts of sequences of word ids: a shallow trie over the ids, four bits a step, with burstable hash containers below it.

    A container holds all sequences of one prefix. One that outgrows ``burst`` keys becomes a node with a container
    for every next step, so that only the prefixes of frequent words lie deep. When the whole holds more than ``keys`` keys,
    the subtrees under the root with the most keys are cut off as sorted runs until half is left.
    """

    def __init__(self, n: int, burst: int = BURST, keys: int = KEYS):
        self.n, self.burst, self.bound = n, burst, keys
        self.root: dict[int, dict | Container] = {}
        self.sizes: dict[int, int] = {}

    @property
    def held(self) -> int:
        return sum(self.sizes.values())

    @staticmethod
    def _by_nibble(ids: np.ndarray, depth: int) -> Iterator[tuple[int, slice]]:
        """Sorted columns cut where the four bits at this depth change."""
        nibble = (ids[depth // 16] >> np.uint64(60 - 4 * (depth % 16))) & np.uint64(15)
        first = np.flatnonzero(np.r_[True, nibble[1:] != nibble[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(nibble)], strict=True):
            yield int(nibble[a]), slice(a, b)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds sequences, one a column, all different and sorted."""
        if len(counts):
            self._into(self.root, ids, counts, 0)

    def _into(self, node: dict, ids: np.ndarray, counts: np.ndarray, depth: int) -> int:
        """Adds below a node; gives the number of new keys."""
        new = 0
        for step, part in self._by_nibble(ids, depth):
            child = node.get(step)
            if child is None:
                child = node[step] = Container(self.n)
            if isinstance(child, dict):
                grown = self._into(child, ids[:, part], counts[part], depth + 1)
            else:
                before = child.held
                child.add(ids[:, part], counts[part])
                grown = child.held - before
                if child.held > self.burst and depth + 1 < 16 * self.n:
                    node[step] = {}
                    self._into(node[step], *_sorted(*child.rows()), depth + 1)
            if not depth:
                self.sizes[step] = self.sizes.get(step, 0) + grown
            new += grown
        return new

    def _walk(self, found: dict | Container) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if isinstance(found, Container):
            yield _sorted(*found.rows())
        else:
            for step in sorted(found):
                yield from self._walk(found[step])

    def cut_off(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted run of a subtree, which leaves the trie."""
        self.sizes.pop(step)
        parts = list(self._walk(self.root.pop(step)))
        return np.concatenate([ids for ids, _ in parts], axis=1), np.concatenate([counts for _, counts in parts])

    def spill(self, all_of_it: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees until half the bound is left, or of all."""
        if self.held <= self.bound and not all_of_it:
            return
        for step in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if not all_of_it and self.held <= self.bound // 2:
                return
            yield self.cut_off(step)


def _sorted(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(ids[::-1])
    return ids[:, order], counts[order]


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the different rows, sorted by the columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lang_seeds(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Number of the language of each text among those of the batch, and their names."""
    names = langs.fill_null(NO_LANG).dictionary_encode()
    return names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()


def _seed(lang: str) -> np.uint64:
    """The hash that starts the phrases of a language."""
    value = np.uint64(1)
    with np.errstate(over="ignore"):
        for byte in lang.encode():
            value = _mixed(np.array([value * np.uint64(257) + np.uint64(byte)], np.uint64))[0]
    return value


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, id, word, n): every word with its 64-bit id and its number of occurrences.

    Each task sends a word once for every time its table is full. Two words of one id (a chance of n²/2^65 for n words) are
    told by their rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes, int], int] = {}
        for batch in batches:
            number, names = _lang_seeds(drop_from(batch, "lang"))
            pieces = Pieces(drop_from(batch, "text"))
            if not len(pieces.hashes):
                continue
            lang = number[pieces.text_of]
            first, times = _distinct([lang, pieces.hashes])
            keys = zip([names[i] for i in lang[first].tolist()], pieces.words(first), _signed(pieces.hashes)[first].tolist(), strict=True)
            for key, n in zip(keys, times.tolist(), strict=True):
                held[key] = held.get(key, 0) + n
            if len(held) > WORDS:
                yield rows(held)
                held = {}
        yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ([], [], [])
        lang, word, ids = (list(c) for c in columns)
        arrays = [pa.array(lang, pa.string()), pa.array(ids, pa.int64()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "id", "word", "n"])

    return docs.mapInArrow(count, "lang string, id long, word string, n long").groupBy("lang", "id", "word").agg(F.sum("n").alias("n"))


def bitmap(spark: SparkSession, frequent: DataFrame, n: int) -> Broadcast:
    """Bits of the hashes of phrases (lang, w1 .. wn), 16 for each and 2^27 at most: a broadcast of at most 16 MB.

    Beyond some 8 million phrases it lets more and more others through, which costs time and changes nothing.
    """
    size = 1 << min(MOST_BITS.bit_length() - 1, max(15, (16 * frequent.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, names = _lang_seeds(drop_from(batch, "lang"))
            seeds = np.array([_seed(x) for x in names], np.uint64)
            words = [drop_from(batch, f"w{i}").to_numpy().view(np.uint64) for i in range(1, n + 1)]
            at = phrase_hash(seeds[number], words) if len(number) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((at % np.uint64(size)).astype(np.int64) + 1)], ["at"])

    at = frequent.select("lang", *[f"w{i}" for i in range(1, n + 1)]).mapInArrow(slots, "at long")
    at = at.select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    parts = at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for row in parts.toLocalIterator():  # 4 KB each, 16 MB in all
        bits[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return spark.sparkContext.broadcast((size, bits))


def _known(filters: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    size, bits = filters
    at = hashes % np.uint64(size)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrase_counts(docs: DataFrame, n: int, shorter: Broadcast, least: int = LEAST) -> DataFrame:
    """(lang, w1 .. wn, n): phrases of n words with at least ``least`` occurrences, among those whose parts ``shorter`` knows.

    Tasks count in HAT-tries and send sorted runs; a run goes to the partition of its prefix, where a third field of hashes
    cuts the phrases of a frequent first word into 64 slices, and equal phrases are added up.
    """
    names = [f"w{i}" for i in range(1, n + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0
        for batch in batches:
            for lang, ids in phrases(batch):
                held.setdefault(lang, []).append(ids)
                waiting += ids.shape[1]
            if waiting > GATHER:
                yield from into_tries(tries, held)
                held, waiting = {}, 0
        yield from into_tries(tries, held)
        for lang, trie in tries.items():
            yield from runs(lang, trie.spill(all_of_it=True))

    def phrases(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        """By language the ids of all phrases of the texts that may be frequent."""
        number, langs = _lang_seeds(drop_from(batch, "lang"))
        pieces = Pieces(drop_from(batch, "text"))
        at = pieces.starts(n)
        lang = number[pieces.text_of[at]]
        ids = np.stack([pieces.hashes[at + i] for i in range(n)])
        if not len(at):
            return
        seeds = np.array([_seed(x) for x in langs], np.uint64)[lang]
        good = np.flatnonzero(_known(shorter.value, phrase_hash(seeds, list(ids[:-1]))))
        good = good[_known(shorter.value, phrase_hash(seeds[good], list(ids[1:, good])))]
        for i, name in enumerate(langs):
            yield name, ids[:, good[lang[good] == i]]

    def into_tries(tries: dict[str, HatTrie], held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            ids = np.concatenate(parts, axis=1)
            first, times = _distinct(list(ids))
            tries.setdefault(lang, HatTrie(n, BURST, KEYS)).add(ids[:, first], times)
        while sum(t.held for t in tries.values()) > KEYS:
            lang = max(tries, key=lambda x: tries[x].held)
            yield from runs(lang, tries[lang].spill(all_of_it=tries[lang].held <= KEYS))

    def runs(lang: str, subtrees: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for ids, counts in subtrees:
            columns = [pa.array(_signed(np.ascontiguousarray(c))) for c in ids]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), *columns, pa.array(counts)], ["lang", *names, "n"])

    found = docs.mapInArrow(count, f"lang string, {', '.join(f'{w} long' for w in names)}, n long")
    found = found.withColumn("slice", F.pmod(F.xxhash64(*names[1:]), F.lit(64)))
    merged = found.repartition("lang", "w1", "slice").groupBy("lang", "w1", "slice", *names[1:]).agg(F.sum("n").alias("n"))
    return merged.where(F.col("n") >= least).select("lang", *names, "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a² / (left right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    square = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(candidates that are not absorbed, words): lang, w1 .. w_longest (null past the end), size, a, l, r, n, score; lang, id, word, n.

    Needs columns ``text`` and ``lang``, others are ignored. Null and empty texts have no words; a null lang counts as 'und'.
    Texts are taken whole, phrases do not cross them; equal rows count each. Ties between cuts go to the first. The products of
    a score are exact as long as a phrase occurs less than 10^16 times.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").where(F.col("text").isNotNull())
    words = cut(word_counts(docs))
    clash = words.groupBy("lang", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not clash.isEmpty():
        raise RuntimeError("two words share a 64-bit id; change the constants of the hash")
    total = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    counts = {1: words.where(F.col("n") >= least).select("lang", F.col("id").alias("w1"), "n")}
    for n in range(2, longest + 1):
        counts[n] = cut(phrase_counts(docs, n, bitmap(spark, counts[n - 1], n - 1), least))

    def part(n: int, first: int, name: str) -> DataFrame:
        """Counts of phrases of n words under the names that they have inside a longer one."""
        names = {f"w{i}": f"w{i + first}" for i in range(1, n + 1)}
        return counts[n].select("lang", *[F.col(a).alias(b) for a, b in names.items()], F.col("n").alias(name))

    scored, absorbed = [], None
    for n in range(longest, 1, -1):
        own = [f"w{i}" for i in range(1, n + 1)]
        cuts = counts[n].withColumnRenamed("n", "a")
        for k in range(1, n):
            cuts = cuts.join(part(k, 0, f"l{k}"), ["lang", *own[:k]]).join(part(n - k, k, f"r{k}"), ["lang", *own[k:]])
        options = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]
        best = F.array_min(F.array(*options))
        found = cuts.select("lang", *own, "a", best.alias("best")).select("lang", *own, "a", "best.l", "best.r", "best.score")
        if absorbed is not None:
            longer = absorbed[n]
            inside = found.join(longer, ["lang", *own], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
            found = inside.drop("most")
        blank = [F.lit(None).cast("long").alias(f"w{i}") for i in range(n + 1, longest + 1)]
        scored.append(found.select("lang", *own, *blank, F.lit(n).alias("size"), "a", "l", "r", "score"))
        absorbed = absorbed or {}
        for m in range(2, n):  # the most occurrences of a candidate of n words that holds a phrase of m
            windows = F.array(*[F.struct(*[F.col(f"w{i + at}").alias(f"w{i}") for i in range(1, m + 1)]) for at in range(n - m + 1)])
            inner = counts[n].select("lang", F.explode(windows).alias("p"), F.col("n").alias("most")).select("lang", "p.*", "most")
            inner = inner.unionByName(absorbed[m]) if m in absorbed else inner
            absorbed[m] = inner.groupBy("lang", *[f"w{i}" for i in range(1, m + 1)]).agg(F.max("most").alias("most"))
    both = scored[0]
    for more in scored[1:]:
        both = both.unionByName(more)
    return both.join(F.broadcast(total), "lang"), words


def top_phrases(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each language by score and a, falling, and by phrase.

    Ranks by score and a come first, with all ties of the last place; only for those rows are words looked up.
    """
    for key, value in SETTINGS.items():
        docs.sparkSession.conf.set(key, value)
    found, words = collocations(docs, least, longest, percent)
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = cut(found.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place"))
    for i in range(1, longest + 1):
        named = words.select("lang", F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"))
        near = near.join(named, ["lang", f"w{i}"], "left" if i > 2 else "inner")
    near = near.withColumn("phrase", F.concat_ws(" ", *[f"t{i}" for i in range(1, longest + 1)]))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
  SELECT lang, doc_id, row_number() OVER () AS piece, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang, doc_id,
               unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS p
        FROM documents WHERE text IS NOT NULL)
), g1 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM pieces) GROUP BY ALL),
g2 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, count(*) AS f
       FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= {LEAST}),
g3 AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f
       FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM pieces WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= {LEAST}),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM g1 GROUP BY lang),
cuts AS (
  SELECT g2.lang, g2.a || ' ' || g2.b AS phrase, g2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.p = g2.a JOIN g1 y ON y.lang = g2.lang AND y.p = g2.b
  WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.a = g2.a AND g3.b = g2.b AND 100 * g3.f >= {PERCENT} * g2.f)
    AND NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.b = g2.a AND g3.c = g2.b AND 100 * g3.f >= {PERCENT} * g2.f)
  UNION ALL
  SELECT g3.lang, g3.a || ' ' || g3.b || ' ' || g3.c, g3.f, 1, x.f, y.f
  FROM g3 JOIN g1 x ON x.lang = g3.lang AND x.p = g3.a JOIN g2 y ON y.lang = g3.lang AND y.a = g3.b AND y.b = g3.c
  UNION ALL
  SELECT g3.lang, g3.a || ' ' || g3.b || ' ' || g3.c, g3.f, 2, x.f, y.f
  FROM g3 JOIN g2 x ON x.lang = g3.lang AND x.a = g3.a AND x.b = g3.b JOIN g1 y ON y.lang = g3.lang AND y.p = g3.c
), scored AS (
  SELECT *, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT))::BIGINT AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM best
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
