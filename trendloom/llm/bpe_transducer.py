"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.llm.common import flat_bytes, joined_words

# What a worker holds beside the ranks, in bytes as estimated for each entry. A table that is full is dropped and built anew,
# of pieces only the older half.
STATES = 120_000  # determinised states with their moves, about 500 bytes each: 60 MB
PAIRS = 400_000  # verdicts on neighbours, about 110 bytes each: 44 MB
PIECE_BYTES, PIECES_HELD = 200, 160 << 20  # encoded pieces and words: their text, ids and so many bytes each
LONG = 1 << 20  # characters from which a text is cut into pieces bit by bit, and of texts that are worked through together
ONE = (1 << 32) - 1  # the bits of a token
BLOCK = 1 << 16  # bytes of a piece after which what is settled is written


def read_ranks(path: str) -> dict[bytes, int]:
    """Token ids by their bytes, from a file of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Reads the bytes of a piece and writes the ids that merging by rank would give.

    A merge order has this property (Berglund and van der Merwe, 2023): a sequence of tokens is the result for its bytes if
    every two neighbours are the result for theirs. So the nondeterministic machine guesses where tokens end: it walks the trie
    of token bytes and may go back to the root wherever a token ends that may follow the last one. It is determinised as it is
    used: a state is the set of live guesses, each a place in the trie that has places below it and the token before it, the
    oldest guess first.

    The bytes read so far have one result, so after each byte one guess is at the root, and the token before it is the last one
    of that result. The machine notes it for each byte; the tokens are then read from the end, each gives where the one before
    ends. Tokens not yet written are thus no part of a state, which would multiply the states. Of a long piece what all live
    guesses have in common is written after each ``BLOCK`` bytes.
    """

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.bound = ranks, states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        # trie: 256 * node + byte -> node; what token ends at a node; bytes from the root to a node; whether it goes on there
        self.next: dict[int, int] = {}
        ends, depth, inner = [-1], [0], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = self.next.get(node << 8 | byte)
                if step is None:
                    step = self.next[node << 8 | byte] = len(ends)
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                    inner.append(0)
                    inner[node] = 1
                node = step
            ends[node] = rank
        self.ends, self.depth = array("i", ends), array("i", depth)
        self.inner = bytes(inner)
        self.spines: dict[int, tuple[list[int], list[int]]] = {}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = (0,)  # trie node << 32 | token before it + 1
        self.ids = {start: 0}
        self.places = [start]
        self.last = [-1]  # by state: the last token of what was read
        self.moves: dict[int, int] = {}  # 256 * state + byte -> state

    @property
    def guesses(self) -> Iterator[list[tuple[int, int, tuple[int, ...]]]]:
        """The guesses of each state: trie node, token before it, and what the guess holds unwritten, which is that token."""
        for state in self.places:
            pairs = [(place >> 32, (place & ONE) - 1) for place in state]
            yield [(node, last, (last,) if last >= 0 else ()) for node, last in pairs]

    def merged(self, text: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging by rank, down to ``stop`` parts, for the few bytes of a token."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > stop:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            i = ranks.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spines(self, token: int) -> tuple[list[int], list[int]]:
        """What stands at the right and at the left border of a token while it is merged, from single bytes to the token.

        Both are empty for a token that merging never gives.
        """
        known = self.spines.get(token)
        if known is None:
            text = self.bytes_of[token]
            if len(text) == 1:
                known = [token], [token]
            else:
                parts = self.merged(text, stop=2)
                apart = [self.ranks[x] for x in parts]
                stable = len(parts) == 2 and self.ranks[text] == token and all(self._spines(x)[0] for x in apart)
                known = ([*self._spines(apart[1])[0], token], [*self._spines(apart[0])[1], token]) if stable else ([], [])
            self.spines[token] = known
        return known

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both leaves the two tokens."""
        if last < 0:
            return bool(self._spines(token)[0])
        key = last << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(self._spines(last)[0], self._spines(token)[1])
        return known

    def _stay_apart(self, left: list[int], right: list[int]) -> bool:
        """Whether no merge across the border comes before the merges that take its neighbours inwards.

        Merges happen in the order of ranks, equal ones from the left.
        """
        if not left or not right:
            return False
        i = j = 0
        while True:
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]])
            up = left[i + 1] if i + 1 < len(left) else None
            on = right[j + 1] if j + 1 < len(right) else None
            if across is not None and (up is None or across < up) and (on is None or across <= on):
                return False
            if up is None and on is None:
                return True
            if on is None or (up is not None and up <= on):
                i += 1
            else:
                j += 1

    def _state(self, found: tuple[int, ...]) -> int:
        state = self.ids.get(found)
        if state is None:
            state = self.ids[found] = len(self.places)
            self.places.append(found)
            self.last.append(found[-1] - 1)
        return state

    def _move(self, state: int, byte: int) -> int:
        found, final = [], -1
        step_of, ends, inner, pairs = self.next.get, self.ends, self.inner, self.pairs
        for place in self.places[state]:
            step = step_of(place >> 32 << 8 | byte)
            if step is None:
                continue
            if inner[step]:
                found.append(step << 32 | place & ONE)
            token = ends[step]
            if final < 0 <= token:
                last = (place & ONE) - 1
                may = pairs.get(last << 32 | token)
                if may or (may is None and self._may_follow(last, token)):
                    final = token
        found.append(final + 1)
        target = self.moves[state << 8 | byte] = self._state(tuple(found))
        return target

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, by the last token of each stretch from the start."""
        out, length = [], self.length
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def _settled(self, ends: list[int], state: int) -> int:
        """The last border between tokens that all live guesses share."""
        borders = {len(ends) - self.depth[place >> 32] for place in self.places[state]}
        while len(borders) > 1:
            at = max(borders)
            borders.remove(at)
            borders.add(at - self.length[ends[at - 1]])
        return borders.pop()

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. A piece that is a token is that token."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        if len(self.places) > self.bound:
            self._clear()
        out: list[int] = []
        ends: list[int] = []  # for each byte not yet written: the last token up to there
        state = 0
        for i in range(0, len(piece), BLOCK):
            moves, last = self.moves.get, self.last
            for byte in piece[i : i + BLOCK] if i or len(piece) > BLOCK else piece:
                move = moves(state << 8 | byte)
                state = self._move(state, byte) if move is None else move
                ends.append(last[state])
            if len(ends) >= BLOCK:
                settled = self._settled(ends, state)
                out += self._back(ends, settled)
                del ends[:settled]
            if len(self.places) > 2 * self.bound:  # a long piece: carry on from the guesses of this state
                places = self.places[state]
                self._clear()
                state = self._state(places)
        return out + self._back(ends, len(ends))


# White space other than the blank and the line feed; a text that holds some is cut by the pattern as a whole.
OTHER_SPACE = [chr(i) for i in (*range(9, 10), *range(11, 14), *range(28, 32))]
WIDE_SPACE = [chr(i) for i in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Encoder:
    """Text to ids: cuts a text by a pattern and sends each piece through the transducer, once for pieces that come back.

    ``pattern`` must be one that cuts before a blank or line feed, and after a line feed, where it stands alone between other
    characters than white space; what lies between such cuts is then looked up as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern, self.transducer = regex.compile(pattern), Transducer(ranks)
        self.known: dict[str, bytes] = {}  # by piece, and by word where a word is a stretch between safe cuts
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, text: str, ids: bytes) -> bytes:
        """Holds the ids. The younger half becomes the older one when it is full; what is used again comes back from there."""
        if self.held > PIECES_HELD // 2:
            self.older, self.known, self.held = self.known, {}, 0
        self.held += len(text) + len(ids) + PIECE_BYTES
        self.known[text] = ids
        return ids

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) < LONG:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while block := [m.group() for m in islice(matches, LONG // 8)]:
            yield block

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                found = self.transducer.encode(piece.encode())
                ids = struct.pack(f"<{len(found)}I", *found)
            self._learn(piece, ids)
        return ids

    def _by_pattern(self, text: str) -> bytes:
        return b"".join([self._piece(p) for pieces in self._pieces(text) for p in pieces])

    def _word(self, word: str) -> bytes:
        """Ids of a stretch between safe cuts that is not among the known ones."""
        ids = self.older.get(word)
        if ids is None:
            pieces = self.pattern.findall(word) if len(word) < LONG else []
            if len(pieces) == 1:
                return self._piece(word)
            ids = self._by_pattern(word) if not pieces else b"".join(map(self._piece, pieces))
        return self._learn(word, ids)

    def _words(self, words: list[str]) -> list[bytes]:
        return [self._word(word) if ids is None else ids for word, ids in zip(words, list(map(self.known.get, words)), strict=True)]

    def _is_plain(self, text: str) -> bool:
        """Whether a text can be cut at every blank and line feed."""
        if text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text:
            return False
        return not any(c in text for c in OTHER_SPACE) and (text.isascii() or not any(c in text for c in WIDE_SPACE))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes | memoryview]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts of ``LONG`` characters in all, or one, at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= LONG:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes | memoryview]:
        plain = [bool(text) and self._is_plain(text) for text in texts]
        cut = [text.replace(" ", "\0 ").replace("\n", "\0\n\0") for text, so in zip(texts, plain, strict=True) if so]
        joined = iter(joined_words(pa.array(cut, pa.large_string()), "\0", self._words))
        for text, so in zip(texts, plain, strict=True):
            yield next(joined) if so else self._by_pattern(text)

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return bytes(next(self.encode_all([text])))


class StreamDecoder:
    """Ids to text in chunks of any size: an incremental UTF-8 machine whose state is the unfinished character.

    Bytes that are no UTF-8 become the replacement character, as in a decoding of the whole.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import codecs

        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.table = pa.array(table, pa.large_binary())
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return bytes(flat_bytes(self.table.take(pa.array(ids)))[0])

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        """The characters that these ids finish; with ``last`` also what is left over."""
        text = self.machine.decode(self.bytes_of(ids), last)
        if last:
            self.machine.reset()
        return text


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """One coder for all tasks of a Python worker, which lives on between them: hence the bounds in bytes."""
    ranks = read_ranks(path)
    return Encoder(ranks, pattern), StreamDecoder(ranks)


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers, without special tokens; empty for null."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        encoder, _ = _coder(path, pattern)
        return pa.array(map(bytes, encoder.encode_all(t.as_py() or "" for t in texts)), pa.binary())

    return encode(text)


def decoded(ids: Column, path: str, pattern: str, chunk: int = 1 << 16) -> Column:
    """Text of ``token_ids``, decoded in a stream; empty for null."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        _, decoder = _coder(path, pattern)
        return pa.array(["".join(_stream(decoder, x.as_buffer() if x.is_valid else b"", chunk)) for x in column], pa.string())

    return decode(ids)


def _stream(decoder: StreamDecoder, ids: bytes | memoryview | pa.Buffer, chunk: int) -> Iterable[str]:
    all_ids = np.frombuffer(ids, "<u4")
    for i in range(0, len(all_ids), chunk):
        yield decoder.feed(all_ids[i : i + chunk])
    yield decoder.feed(all_ids[:0], last=True)


def round_trip(text: Column, path: str, pattern: str, chunk: int = 1 << 16, with_ids: bool = False) -> Column:
    """A struct of n_tokens, ids_sha256 and decoded_sha256: a text encoded, and its ids decoded again in chunks.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the UTF-8 bytes of the decoded text.
    With ``with_ids`` the bytes of the ids are a fourth field. Null is an empty text: no tokens, and the digests of nothing.
    Every row is worked out by itself, so equal rows have equal results, an empty table gives an empty one, other columns do
    not matter and there are no ties. Texts are taken whole; one of ``LONG`` characters or more is cut into pieces bit by bit.
    """
    fields = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + (", ids: binary" if with_ids else "")

    @F.arrow_udf(f"struct<{fields}>")
    def both(texts: pa.Array) -> pa.Array:
        encoder, decoder = _coder(path, pattern)
        n, of_ids, of_text, kept = [], [], [], []
        for ids in encoder.encode_all(t.as_py() or "" for t in texts):
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            digest = hashlib.sha256()
            for part in _stream(decoder, ids, chunk):
                digest.update(part.encode())
            of_text.append(digest.hexdigest())
            kept += [bytes(ids)] if with_ids else []
        columns = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        columns += [pa.array(kept, pa.binary())] if with_ids else []
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return both(text)
