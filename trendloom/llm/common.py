"""What several operators share: word expressions, global row numbers, word hashes of Arrow text, files on shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.session import cut

# What separates words, and the letters that are lower-cased.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Settings of all operators here: batches that stay small where texts are long; and a Bloom filter of the smaller side before
# texts are shuffled, where Spark can tell that side to be selective.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0b",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def words(text: Column) -> Column:
    """Runs of other characters than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: str = "text") -> Column:
    """What equal texts share; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def row_numbers(df: DataFrame, *order: Column, name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with the place of each row in the given order, from 0 without gaps, and the row count.

    Rows are dealt by range and numbered inside their partition; the counts of the partitions (one row each) give the
    offsets. Rows equal in ``order`` are spread over partitions, their order among themselves is arbitrary.
    """
    keys = [f"_order_{i}" for i in range(len(order))]
    tagged = df.withColumns({k: c for k, c in zip(keys, order, strict=True)}).withColumn("_tie", F.monotonically_increasing_id())
    dealt = cut(tagged).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop(*keys, "_tie")
    at = F.monotonically_increasing_id()
    placed = cut(dealt.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("_part", "_rows", before.alias("_before")))
    total = offsets.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    numbered = placed.join(offsets.drop("_rows"), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return numbered.drop("_part", "_at", "_before"), total


# --- Hashes of words, computed for a whole Arrow column at once -------------------------------------------------

_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE_FOLDED = np.where(_BLANK, np.uint64(0), _BYTE[_FOLD])


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 borders; a null text has none."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data else np.zeros(0, np.uint8)
    return flat, borders - borders[0]


def word_hashes(texts: pa.Array, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased) of all texts in a row, and the n + 1 borders of the texts.

    Works through about ``step`` bytes at a time, cut between words, so memory follows the longest word.
    """
    flat, borders = flat_bytes(texts)
    hashes, starts = [], []
    at = 0
    while at < len(flat):
        end = min(at + step, len(flat))
        if end < len(flat) and not _BLANK[flat[end]]:
            blanks = np.flatnonzero(_BLANK[flat[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                while end < len(flat):
                    blanks = np.flatnonzero(_BLANK[flat[end : end + step]])
                    end = min(end + step, len(flat)) if not len(blanks) else end + int(blanks[0])
                    if len(blanks):
                        break
        piece = flat[at:end]
        word = ~_BLANK[piece]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inside = borders[(borders > at) & (borders < end)] - at
        first[inside] |= word[inside]
        begin = np.flatnonzero(first)
        if len(begin):
            spans = np.diff(np.append(begin, len(piece)))
            place = np.arange(begin[0], len(piece)) - np.repeat(begin, spans)
            values = _BYTE_FOLDED[piece[begin[0] :]] * _powers(int(spans.max()))[place]
            hashes.append(_mixed(np.add.reduceat(values, begin - begin[0])))
            starts.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(borders), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), borders)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places too near the end are left out."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = _mixed(out + hashes[i : i + count] + np.uint64(i + 1))
    return out


def joined_words(texts: pa.Array, separator: str, ids_of: Callable[[list[str]], list[bytes]]) -> list[memoryview]:
    """For each text what ``ids_of`` gives for its words, which lie between separators, one after the other.

    ``ids_of`` gets the different words of all texts, each once.
    """
    words = pc.split_pattern(texts.cast(pa.large_string()), separator)
    different = words.flatten().dictionary_encode()
    ids = pa.array(ids_of(different.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(different.indices)
    flat, borders = flat_bytes(ids)
    ends = borders[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist() if len(words) else []
    whole = memoryview(flat)
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


# --- Files ------------------------------------------------------------------------------------------------------


def shared_files(folder: str):
    """(file system, path) of a folder on shared storage, for Python tasks that write or read whole files."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return system, path


def drop_from(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Row dictionaries as record batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def larger(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until the texts of a column have ``size`` bytes; none without rows."""
    held, seen = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        seen += pc.sum(pc.binary_length(drop_from(batch, column))).as_py() or 0
        if seen >= size:
            yield pa.concat_batches(held)
            held, seen = [], 0
    if held:
        yield pa.concat_batches(held)
