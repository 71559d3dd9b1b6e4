"""Runs of periodic words by internal pattern matching: dyadic blocks look for their next occurrence in a neighbouring window.

A text is a sequence of words. A run is a stretch with smallest period q and at least ``exponent`` times q words (and at least
``least`` in all) that no neighbouring word extends. Words are numbered per text, so results are exact, without hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import words

LEAST, EXPONENT = 6, 4
GROUP_WORDS = 1 << 17  # short texts are worked through together, up to so many words; a longer text is a group of its own

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixClasses:
    """Suffixes of a sequence sorted by doubling; texts in it are parted by ``ends`` and share no class.

    ``left[k][i]`` is the first place in the suffix array of the suffixes that begin with the 2^k words at i, and
    ``size[k][i]`` their number: the block of level k at i occurs at ``array[left : left + size]`` and nowhere else. A suffix
    shorter than 2^k is alone in its class.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = len(ids)
        self.array = np.argsort(ids, kind="stable").astype(np.int64)
        self.left, self.size = [], []
        left, size = np.empty(n, np.int64), np.empty(n, np.int64)
        self._classes(ids[self.array], self.array, np.arange(n), left, size)
        active = self.array[size[self.array] > 1]  # in the order of the array
        k = 0
        while True:
            self.left.append(left.astype(np.int32) if n < 1 << 31 else left)
            self.size.append(size.astype(np.int32) if n < 1 << 31 else size)
            if not len(active):
                return
            step = 1 << k
            beyond = active + step
            second = np.where(beyond < ends[active], left[np.minimum(beyond, n - 1)] + 1, 0)
            key = left[active] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            places = self._places(left, size, active)
            key, active = key[order], active[order]
            self.array[places] = active
            left, size = left.copy(), size.copy()
            self._classes(key, active, places, left, size)
            active = active[size[active] > 1]
            k += 1

    @staticmethod
    def _places(left: np.ndarray, size: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Places in the array of suffixes that stand in class order."""
        first = np.flatnonzero(np.r_[True, left[active][1:] != left[active][:-1]])
        spans = size[active[first]]
        return np.repeat(left[active[first]], spans) + np.arange(len(active)) - np.repeat(first, spans)

    @staticmethod
    def _classes(key: np.ndarray, sorted_suffixes: np.ndarray, places: np.ndarray, left: np.ndarray, size: np.ndarray) -> None:
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        spans = np.diff(np.append(first, len(key)))
        left[sorted_suffixes] = np.repeat(places[first], spans)
        size[sorted_suffixes] = np.repeat(spans, spans)

    def common_prefix(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length of what the suffixes at a < b of one text share."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.left) - 1, -1, -1):
            left, step, top = self.left[k], 1 << k, k == len(self.left) - 1
            while True:
                at = b + out
                live = np.flatnonzero(at + step <= ends)
                live = live[left[a[live] + out[live]] == left[at[live]]]
                out[live] += step
                if not top or not len(live):
                    break
        return out

    def common_suffix(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Length of what the stretches that end before a < b of one text share."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.left) - 1, -1, -1):
            left, step, top = self.left[k], 1 << k, k == len(self.left) - 1
            while True:
                at = a - out - step
                live = np.flatnonzero(at >= starts)
                live = live[left[at[live]] == left[b[live] - out[live] - step]]
                out[live] += step
                if not top or not len(live):
                    break
        return out


class WaveletTree:
    """Bits of a permutation level by level (as a wavelet matrix): the least value from x on within a stretch of places."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        values = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            self.zeros.append(np.r_[0, np.cumsum(zero)].astype(np.int32 if len(values) < 1 << 31 else np.int64))
            values = np.r_[values[zero], values[~zero]]

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each stretch [left, right) the least value that is at least x; -1 if there is none."""
        less = np.zeros(len(x), np.int64)
        lo, hi = left.astype(np.int64), right.astype(np.int64)
        for i, zeros in enumerate(self.zeros):  # how many values are less than x
            lo0, hi0 = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = (x >> (self.bits - 1 - i)) & 1 == 1
            less += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, zeros[-1] + lo - lo0, lo0), np.where(one, zeros[-1] + hi - hi0, hi0)
        found = np.flatnonzero(less < right - left)
        lo, hi, rank = left[found].astype(np.int64), right[found].astype(np.int64), less[found]
        value = np.zeros(len(found), np.int64)
        for i, zeros in enumerate(self.zeros):  # the value of that rank
            lo0, hi0 = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = rank >= hi0 - lo0
            rank = np.where(one, rank - (hi0 - lo0), rank)
            lo, hi = np.where(one, zeros[-1] + lo - lo0, lo0), np.where(one, zeros[-1] + hi - hi0, hi0)
            value += one.astype(np.int64) << (self.bits - 1 - i)
        out = np.full(len(x), -1, np.int64)
        out[found] = value
        return out


def find_runs(ids: np.ndarray, borders: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs in texts laid end to end, by start and period. ``borders`` are the n + 1 text borders.

    A run of period q holds, for the level with 2^(k-1) < q <= 2^k, a block of 2^k words that starts at a multiple of 2^(k-1)
    and again q words later, since 3/2 * 2^k + q - 1 < 4q. The block's occurrences in the window of 2^k words after it form a
    progression with the period as its step; its first one, found by range successor, is the candidate period, and no smaller
    shift fits, since both would be periods of a stretch as long as their sum. Candidates are then extended to both sides.
    """
    if exponent < 4:
        raise ValueError("blocks half a step apart find runs of four periods or more")
    spans = np.diff(borders)
    starts, ends = np.repeat(borders[:-1], spans), np.repeat(borders[1:], spans)
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    suffixes = SuffixClasses(ids, ends)
    places, level = [], []
    for k, size in enumerate(suffixes.size):
        step = max(1, 1 << k >> 1)
        at = np.arange(0, len(ids), step)
        at = at[size[at] > 1]
        places.append(at)
        level.append(np.full(len(at), k))
    at, k = np.concatenate(places), np.concatenate(level)
    left = np.concatenate([suffixes.left[i][p] for i, p in enumerate(places)]).astype(np.int64)
    right = left + np.concatenate([suffixes.size[i][p] for i, p in enumerate(places)])
    step = WaveletTree(suffixes.array).successor(left, right, at + 1) - at
    block = np.int64(1) << k
    # a smaller step belongs to a lower level, a larger one lies outside the window
    good = (step > 0) & (step <= block) & (2 * step > block)
    at, step = at[good], step[good]
    after = suffixes.common_prefix(at, at + step, ends[at])
    before = suffixes.common_suffix(at, at + step, starts[at])
    start, length = at - before, before + after + step
    enough = length >= np.maximum(least, exponent * step)
    found = np.unique(np.stack([start[enough], step[enough], length[enough]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _groups(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of the texts, a few texts at a time."""
    held, size = [], 0
    for text in texts:
        parts = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes split at ASCII white space alone
        if held and size + len(parts) > GROUP_WORDS:
            yield held
            held, size = [], 0
        held.append(parts)
        size += len(parts)
    if held:
        yield held


def _numbered(group: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of a group of texts, different ones in different texts, and the text borders."""
    borders = np.concatenate([[0], np.cumsum([len(x) for x in group])]).astype(np.int64)
    ids, base = np.empty(borders[-1], np.int64), 0
    for parts, a, b in zip(group, borders[:-1], borders[1:], strict=True):
        seen: dict[bytes, int] = {}
        ids[a:b] = [seen.setdefault(w, len(seen)) for w in parts]
        ids[a:b] += base
        base += len(seen)
    return ids, borders


def _dropped(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def periodic(text: Column, least: int = LEAST, exponent: int = EXPONENT) -> Column:
    """A struct of ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without repetitions.

    Words are runs of other characters than ASCII white space, numbered from 0. In ``collapsed`` every run keeps its first
    period; the words that stay are joined by one blank, so a text without runs has its white space made plain. Null, empty and
    blank texts have no runs and collapse to ''. Texts are taken whole; a text longer than ``GROUP_WORDS`` words is worked
    through alone, with about 500 bytes a word. Equal texts have equal results, and ties do not arise: a run is fixed by its
    start and period.
    """

    @F.arrow_udf(f"struct<runs: {RUNS}, collapsed: string>")
    def find(texts: pa.Array) -> pa.Array:
        offsets, columns, collapsed = [np.zeros(1, np.int64)], [], []
        for group in _groups(texts):
            ids, borders = _numbered(group)
            start, length, period = find_runs(ids, borders, least, exponent)
            gone = _dropped(start, length, period, len(ids))
            cuts = np.searchsorted(start, borders)
            offsets.append(offsets[-1][-1] + cuts[1:])
            columns.append((start - np.repeat(borders[:-1], np.diff(cuts)), length, period))
            touched = np.diff(cuts) > 0
            for i, parts in enumerate(group):
                if touched[i]:
                    keep = np.flatnonzero(~gone[borders[i] : borders[i + 1]])
                    parts = [parts[j] for j in keep.tolist()]
                collapsed.append(b" ".join(parts).decode())
        fields = [pa.array(np.concatenate(c) if columns else [], pa.int64()) for c in (zip(*columns, strict=True) if columns else [[]] * 3)]
        runs = pa.ListArray.from_arrays(
            pa.array(np.concatenate(offsets), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        )
        return pa.StructArray.from_arrays([runs, pa.array(collapsed, pa.string())], ["runs", "collapsed"])

    return find(text)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one id in ten has its words with the tail made periodic, as the contract of the query says.

    With h the unsigned crc32 of the decimal id and g = h div 10, an id with h % 10 = 0 has word i >= a replaced by word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id or a text without words changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"))
    chosen = chosen.select("doc_id", "text", F.expr("h div 10").alias("g"), words(F.when(F.col("h") % 10 == 0, F.col("text"))).alias("parts"))
    chosen = chosen.withColumn("n", F.size("parts").cast("long")).withColumn("a", F.expr("g % nullif(n, 0)"))
    chosen = chosen.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(sequence(0L, n - 1), i -> element_at(parts, cast(if(i < a, i, a + (i - a) % p) AS int) + 1)), ' ')")
    return chosen.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document its number of runs, the longest one (ties: least start, then period), and digests of runs and collapsed text."""
    found = with_repeated_tails(docs).select("doc_id", periodic(F.col("text")).alias("found")).select("doc_id", "found.*")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(order)
    all_runs = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        F.call_function("div", -best["l"] * 1000, best["p"]).alias("exponent_milli"),
        F.sha2(all_runs.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
