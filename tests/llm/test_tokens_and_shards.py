"""BPE, token files and shards against the libraries and plain loops."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendloom.llm import bpe_transducer, common, sharding, token_files
from trendloom.session import work_folder

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\n ", "a  b\n c", "x" * 200_000, " " * 5_000, "é 漢字🙂   don't I'LL 123456 ...!!", "<|endoftext|>", "\x00\x1c a", "tab\tand\r\nline "]


@pytest.fixture(scope="module")
def coder():
    ranks = bpe_transducer.read_ranks(PATH)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe_transducer.Encoder(ranks, PATTERN), bpe_transducer.StreamDecoder(ranks), reference


def texts(n, seed=5):
    r = random.Random(seed)
    parts = ["the", "ing", "er", "tion", " ", "  ", "\n", "an", "aa", "Z", "9", ".", "'s", "é", "漢", "🙂", "\t", " ", " "]
    for i in range(n):
        if i % 3:
            yield "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        else:
            yield "".join(chr(r.randint(1, 0x2FFF)) for _ in range(r.randint(0, 40)))


def test_ids_equal_the_library(coder):
    encoder, _, reference = coder
    for text in [*texts(4000), *[t or "" for t in ODD]]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text), text[:80]


def test_a_small_bound_on_states_changes_nothing(coder):
    _, _, reference = coder
    small = bpe_transducer.Transducer(bpe_transducer.read_ranks(PATH), states=50)
    for text in ("abracadabra" * 300, "supercalifragilistic" * 20):
        assert small.encode(text.encode()) == reference.encode_single_piece(text) if text in reference._mergeable_ranks else True
        assert [i for p in [small.encode(text.encode())] for i in p] == reference.encode_ordinary(text)


def invented(n):
    r = random.Random(3)
    return ["".join(r.choices(["er", "on", "th", "en", "sch", "eaux", "ing", "re", "a", "ß", "ti"], k=r.randint(2, 6))) for _ in range(n)]


def test_states_hold_no_unwritten_tokens(coder):
    """Contexts that differ only in tokens before the live guesses share a state."""
    machine = bpe_transducer.Transducer(bpe_transducer.read_ranks(PATH))
    for word in invented(3000):
        machine.encode(word.encode())
    assert len(machine.ids) < 3100


def test_one_new_word_is_looked_up_alone(coder, monkeypatch):
    words = sorted(set(invented(500)))
    encoder = bpe_transducer.Encoder(coder[0].transducer.ranks, PATTERN)
    encoder.encode(" ".join(words))
    asked, plain = [], encoder._word
    monkeypatch.setattr(encoder, "_word", lambda word: asked.append(word) or plain(word))
    text = " ".join([*words, "anothernewword", *words[1:], "anothernewword"])
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == coder[2].encode_ordinary(text)
    assert asked.count(" anothernewword") == 1 and len(asked) <= 2


def test_long_pieces_are_written_in_blocks(coder, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "BLOCK", 50)
    machine, most = bpe_transducer.Transducer(coder[0].transducer.ranks, states=100), []
    settled = machine._settled
    monkeypatch.setattr(machine, "_settled", lambda ends, state: most.append(len(ends)) or settled(ends, state))
    for text in ("".join(invented(500)), "x" * 3000, "abracadabra" * 300, "é漢" * 500):
        want = coder[2].encode_ordinary(text)
        assert [i for p in coder[0].pattern.findall(text) for i in machine.encode(p.encode())] == want
    assert max(most) < 300


def test_groups_of_texts_equal_single_texts(coder, monkeypatch):
    encoder, _, reference = coder
    rows = [*texts(500), *[t or "" for t in ODD], "a\0b c", "last one"]
    for long in (8, 60, 1 << 20):
        monkeypatch.setattr(bpe_transducer, "LONG", long)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all(rows)] == [reference.encode_ordinary(t) for t in rows]


def test_tokens_leave_early(coder):
    """A long piece is not held back: the guesses of a state keep only few unwritten tokens."""
    machine = coder[0].transducer
    machine.encode(b"abc" * 2000)
    assert max(len(held) for guesses in machine.guesses for _, _, held in guesses) < 130


def test_stream_decoder(coder):
    encoder, decoder, _ = coder
    text = "漢字🙂é plain " * 50
    ids = np.frombuffer(encoder.encode(text), "<u4")
    for step in (1, 2, 7, 1000):
        assert "".join(decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + decoder.feed(ids[:0], last=True) == text
    broken = np.array([i for b, i in coder[0].transducer.ranks.items() if b in (b"\xe6", b"a")], "<u4")
    expected = decoder.bytes_of(broken).decode("utf-8", "replace")
    assert "".join(decoder.feed(broken[i : i + 1]) for i in range(len(broken))) + decoder.feed(broken[:0], last=True) == expected


def test_columns(frame, coder):
    docs = frame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    ids = bpe_transducer.token_ids(F.col("text"), PATH, PATTERN)
    rows = docs.select("text", ids.alias("ids"), bpe_transducer.round_trip(F.col("text"), PATH, PATTERN, chunk=3).alias("r"))
    rows = rows.select("*", bpe_transducer.decoded(F.col("ids"), PATH, PATTERN, 2).alias("back")).collect()
    for r in rows:
        assert r.back == (r.text or "") and r.r.n_tokens == len(r.ids) // 4 == len(coder[2].encode_ordinary(r.text or ""))
    assert docs.where("false").select(ids).count() == 0


def test_files_hold_the_ids(frame, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    rows = [(i * 3 % 101, t) for i, t in enumerate([*ODD, *texts(80)])] + [(7, "same"), (7, "same")]
    folder = work_folder(spark)
    manifest = token_files.write_sequences(frame(rows, "doc_id long, text string").selectExpr("*", "0 as part"), path, folder, length=32)
    got = sorted(map(tuple, token_files.read_documents(manifest, folder).collect()), key=lambda r: r[1])
    bags = {}
    for doc_id, text in rows:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        bags.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0
    for doc_id, found in bags.items():
        assert sorted((n, crc) for i, _, n, crc in got if i == doc_id) == sorted(found)


def test_sequences_are_views_with_masks(frame, spark):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), work_folder(spark)
    manifest = token_files.write_sequences(frame([(1, "one two three " * 700)], "doc_id long, text string"), path, folder, length=16)
    row = manifest.first()
    system, _ = common.shared_files(folder)
    reader = token_files.opened(system, f"{row.path}.arrow")
    before = pa.total_allocated_bytes()
    ids, mask = token_files.sequence(reader, 70)
    assert len(ids) == 16 and mask.true_count == 16 and pa.total_allocated_bytes() - before < 4096
    last = token_files.sequence(reader, -(-row.n_ids // 16) - 1)[1]
    assert last.true_count == (row.n_ids - 1) % 16 + 1


def test_words_that_need_care():
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["İstanbul ΑΣ, ﬁn!! don't x's. ª² e\u0301 \u0301a A\u030a. Ǆ ß", "a-b c_d 1.5, (x) … “q” word. word, word", "한글 กำ ไทย、漢字。", "<|endoftext|> x<|startoftext|>."]
    texts += [" ".join(random.Random(i).choices([*"aé漢Ⅷ١'.,-\u0308İſ"], k=40)).replace(" ", "", 25) for i in range(300)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == reference.encode(text, add_special_tokens=False).ids, text


def test_letters_that_become_marks_and_special_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, reference = token_files.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["İ. aİ, x", "\u0958! क़.", "é, É; ß: Ñ.,x ÿ?!", "<|ENDOFTEXT|> <|endoftext|>. <|StartOfText|>,", "THE The the, THE.% it's, IT'S.", "ĳ. ǅ, ﬁ! ª: º; µ."]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == reference.encode(text, add_special_tokens=False).ids, text


def test_words_in_use_are_encoded_once(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 40)
    encoder, asked = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    plain = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: asked.extend(words) or plain(words))
    for i in range(20):
        encoder.encode(["again Again and, again. " + " ".join(f"{'abcdefghij'[i % 10]}{'klmno'[i // 10]}{c}" for c in "pqrstuvwxy")])
        assert len(encoder.known) + len(encoder.older) < 100
    assert asked.count("again") == 1 and len(asked) == len(set(asked)) and "Again" not in asked and "again." not in asked


def test_larger_batches_keep_every_row():
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(t, pa.string()), "n": pa.array(range(len(t)), pa.int64())}) for t in (["a", None], [], ["é" * 9], [None], ["b"])]
    got = list(common.larger(iter(batches), "text", 10))
    assert [b.num_rows for b in got] == [3, 2] and [t for b in got for t in b.column(0).to_pylist()] == ["a", None, "é" * 9, None, "b"]
    assert list(common.larger(iter(batches[1:2]), "text", 10)) == []


def test_no_documents_no_files(frame, spark):
    folder = work_folder(spark)
    manifest = token_files.write_sequences(frame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), folder)
    assert manifest.count() == 0 and token_files.read_documents(manifest, folder).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4097])
def test_permutation(total):
    there = [sharding.permuted(x, total, 5) for x in range(total)]
    assert sorted(there) == list(range(total)) and [sharding.row_at(p, total, 5) for p in there] == list(range(total))


def test_shards_equal_a_loop(frame):
    rows = [(i * 7 % 500, f"text {i}é") for i in range(300)] + [(None, "a"), (None, None), (3, None), (9, ""), (9, ""), (9, "x" * 100_000)]
    docs = frame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as row_number")
    got = sorted(map(tuple, sharding.sharded(docs, 40, seed=3).collect()), key=str)
    facts = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    facts.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    want = []
    for n, (i, size, crc) in enumerate(facts):
        p = sharding.permuted(n, len(facts), 3)
        want.append((i, size, crc, p % 40, p // 40))
    assert got == sorted(want, key=str)
    assert sharding.sharded(docs.where("false"), 40).count() == 0
