"""Token ids as Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import drop_from, joined_words, larger, shared_files
from trendloom.session import cut, cut_and_measure

LENGTH = 2048  # ids of a sequence
ROWS = 64  # sequences of a record batch
WORDS = 800_000  # encoded words held at a time; when half of them are new, the half not used since is dropped
TEXT = 1 << 22  # characters of texts that are encoded together, or one text
LETTER, MARK = "([A-Za-zÀ-ÖØ-öø-ÿ])", "([,.;:!?])"  # a blank between these two changes no ids
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids by a tokenizer that drops white space and cuts words where letters, digits and other characters meet, so that a text's
    ids are those of its words one after the other, and a word's those of its letters and of the punctuation after them.

    Each word goes through the tokenizers library once while it is held. The tokenizer lower-cases, so a word of ASCII letters
    alone is looked up in lower case (others are not: a special token counts only as it is spelled).
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.ids, self.kind).tobytes()

    def _letters(self, words: list[str]) -> None:
        """Words of letters alone, as one text: each ends with its first id that ends a word, if there are as many ends as words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        flat, size = ids.tobytes(), self.kind.itemsize
        borders = [0, *(ends * size).tolist()]
        self.known.update(zip(words, (flat[x:y] for x, y in zip(borders, borders[1:], strict=False)), strict=True))

    def _learn(self, words: set[str]) -> None:
        parts, alone, odd = {}, [], []
        for word in words:
            letters = word.rstrip(PUNCTUATION)
            if letters != word and letters.isalpha() and _stays_letter(letters[-1]):
                parts[word] = (letters, word[len(letters) :])
            else:
                (alone if word.isalpha() else odd).append(word)
        for part in {part for pair in parts.values() for part in pair} - words:
            if part not in self.known:
                (alone if part.isalpha() else odd).append(part)
        self._each(odd)
        for i in range(0, len(alone), 1000):
            self._letters(alone[i : i + 1000])
        for word, (first, rest) in parts.items():
            self.known[word] = self.known[first] + self.known[rest]

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > WORDS // 2:
            self.older, self.known = self.known, {}
        words = [word.lower() if word.isascii() and word.isalpha() else word for word in words]
        found = list(map(self.known.get, words))
        new = set()
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.older.get(words[i])
                if found[i] is None:
                    new.add(words[i])
                else:
                    self.known[words[i]] = found[i]
        if new:
            self._learn(new)
            found = [self.known[word] if ids is None else ids for word, ids in zip(words, found, strict=True)]
        return found

    def encode(self, texts: list[str]) -> list[memoryview]:
        """Ids of each text, little-endian, of the width of ``kind``."""
        plain = pa.array([text.replace("\n", " ") for text in texts], pa.large_string())
        return joined_words(pc.replace_substring_regex(plain, LETTER + MARK, r"\1 \2"), " ", self._words)


def _stays_letter(letter: str) -> bool:
    """Whether a letter is one after normalizing too; some become a letter and a mark, which the tokenizer joins with what follows."""
    return letter.isascii() or unicodedata.normalize("NFC", letter).lower().isalpha()


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def sequence_schema(length: int, kind: np.dtype) -> pa.Schema:
    """``ids`` (16 bits wide where the vocabulary allows it) and ``mask`` (true where ``ids`` holds an id, not the fill at a file's end)."""
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _sequences(ids: np.ndarray, length: int) -> pa.RecordBatch:
    """Ids as rows of ``length``, the last one filled up."""
    rows = -(-len(ids) // length)
    full = np.zeros(rows * length, ids.dtype)
    full[: len(ids)] = ids
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (full, np.arange(len(full)) < len(ids))]
    return pa.RecordBatch.from_arrays(lists, schema=sequence_schema(length, ids.dtype))


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes their ids in the order of doc_id; gives (part, path, n_docs, n_ids).

    Documents are dealt by range of doc_id, each partition writes a file ``path``.arrow in Arrow's file format, whose record
    batches hold equal-length lists of ids and masks, and ``path``.index.arrow with (doc_id, start, n_tokens) in that file.
    Every document ends with ``end_id``. Names hold the task attempt, so what a lost attempt has left is not read.

    Null texts are empty: their end id alone. Rows of one doc_id follow each other in the order of their text's hash; a null
    doc_id comes first. Empty partitions write nothing.
    """
    keys = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    dealt = keys.repartitionByRange("doc_id", "_hash", "_tie").sortWithinPartitions("doc_id", "_hash", "_tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = _encoder(tokenizer), TaskContext.get()
        kind = encoder.kind
        end = np.array([end_id], kind).tobytes()
        system, root = shared_files(folder)
        path, n_docs, n_ids = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0
        held, size, files = [], 0, None
        for batch in larger(batches, "text", TEXT):
            if files is None:
                system.create_dir(root, recursive=True)
                streams = system.open_output_stream(f"{path}.arrow"), system.open_output_stream(f"{path}.index.arrow")
                files = pa.ipc.new_file(streams[0], sequence_schema(length, kind)), pa.ipc.new_file(streams[1], INDEX)
            encoded = [b"".join((ids, end)) for ids in encoder.encode([t or "" for t in drop_from(batch, "text").to_pylist()])]
            counts = np.array([len(ids) // kind.itemsize for ids in encoded], np.int64)
            starts = n_ids + np.concatenate([[0], np.cumsum(counts)[:-1]])
            files[1].write(pa.RecordBatch.from_arrays([drop_from(batch, "doc_id").cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=INDEX))
            n_docs, n_ids = n_docs + len(encoded), n_ids + int(counts.sum())
            held += encoded
            size += int(counts.sum())
            if size >= length * ROWS:
                ids = np.frombuffer(b"".join(held), kind)
                whole = len(ids) // (length * ROWS) * length * ROWS
                for i in range(0, whole, length * ROWS):
                    files[0].write(_sequences(ids[i : i + length * ROWS], length))
                held, size = [ids[whole:].tobytes()], len(ids) - whole
        if files is not None:
            if size:
                files[0].write(_sequences(np.frombuffer(b"".join(held), kind), length))
            for file, stream in zip(files, streams, strict=True):
                file.close()
                stream.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    return cut(dealt.mapInArrow(write, "part long, path string, n_docs long, n_ids long"))


def opened(system, path: str) -> pa.ipc.RecordBatchFileReader:
    """A file for reading; on a local disk mapped to memory, so that what is read is not copied."""
    from pyarrow import fs

    return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``i`` of an opened file, as views of it: all batches but the last have ``ROWS`` sequences."""
    batch = reader.get_batch(i // ROWS)
    length = batch.schema.field("ids").type.list_size
    ids, mask = (batch.column(c).flatten().slice(i % ROWS * length, length) for c in (0, 1))
    return ids.to_numpy(), mask


def documents_in(system, path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of one file, batch after batch of its index."""
    reader, index = opened(system, f"{path}.arrow"), opened(system, f"{path}.index.arrow")
    batch, ids, first = -1, np.zeros(0, np.uint16), 0  # ids [first, first + len(ids)) of the file

    for k in range(index.num_record_batches):
        part = index.get_batch(k)
        sums = []
        for start, n in zip(part.column(1).to_numpy(), part.column(2).to_numpy(), strict=True):
            crc, at = 0, int(start)
            while at < start + n:
                while at >= first + len(ids):
                    first += len(ids)
                    batch += 1
                    rows = reader.get_batch(batch)
                    values, mask = (rows.column(c).flatten() for c in (0, 1))
                    ids = values.to_numpy()[: mask.true_count]
                piece = ids[at - first : int(start + n) - first]
                crc = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc)
                at += len(piece)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``manifest``, as ``write_sequences`` gave it.

    start counts the ids of all documents before, over all files in their order. The manifest has one row per file.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files, seen = cut_and_measure(manifest.select("path", F.coalesce(before, F.lit(0)).alias("before")), files=F.count(F.lit(1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = shared_files(folder)
        for rows in batches:
            for row in rows.to_pylist():
                for found in documents_in(system, row["path"]):
                    start = pa.array(found.column(1).to_numpy() + row["before"], pa.int64())
                    yield pa.RecordBatch.from_arrays([found.column(0), start, found.column(2), found.column(3)], names=found.schema.names)

    spread = files.repartition(max(1, seen["files"]))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
