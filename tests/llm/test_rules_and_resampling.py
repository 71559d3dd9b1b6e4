"""Quality rules and importance resampling on small tables."""

import itertools
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from trendloom.llm import quality_rules, resampling
from trendloom.session import cut

CLEAN = "The house is on the hill and it was built of stone for the people that came to the valley with horses in spring."
ROWS = [
    (1, CLEAN), (2, None), (3, ""), (4, " \n\t "), (5, "a b"), (6, CLEAN), (6, CLEAN), (None, CLEAN),
    (7, ("one two three four five six seven eight nine " * 5) + "end"), (8, "$$$ ### " * 20), (9, "THE END IS NEAR AND " * 5),
    (10, f"{CLEAN}\n{CLEAN}\n\n{CLEAN}\nlast"), (11, "x" * 300_000), (12, "word " * 40_000), (13, "ünï 漢字  é " * 30),
]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(frame):
    rows = quality_rules.judged(frame(ROWS, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed) for r in rows), key=str)
    want = []
    for doc_id, text in ROWS:
        b = base(text)
        want.append((doc_id, b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == sorted(want, key=str)


def test_verdicts(frame):
    kept = {r.doc_id: r.kept for r in quality_rules.judged(frame(ROWS, "doc_id long, text string")).collect()}
    assert kept[1] and kept[6] and kept[None]
    assert not any(kept[i] for i in (2, 3, 4, 5, 7, 8, 9, 11, 12))


def test_filter_on_the_verdict_and_clashing_columns(frame):
    docs = frame([(1, CLEAN, "mine", 7)], "doc_id long, text string, kept string, extra int")
    result = quality_rules.judged(docs)
    assert result.columns.count("kept") == 1 and result.where("kept").select("extra").first().extra == 7


def test_own_rules(frame):
    rules = [quality_rules.Rule("few", "mean_word_length", None, 1.0)]
    assert not quality_rules.judged(frame([(1, CLEAN)], "doc_id long, text string"), rules).first().kept


def test_empty_table(frame):
    assert quality_rules.judged(frame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_counts_of_buckets(frame):
    docs = frame([("a b a", 1), ("a b", 0), (None, 1), ("", None)], "text string, good int")
    rows = resampling.bucket_counts(docs, 1 << 20).collect()
    assert sum(r.raw for r in rows) == 5 + 3 and sum(r.target for r in rows) == 5
    assert sorted(r.raw for r in rows) == [1, 2, 2, 3]  # "b a"; "a b", "b"; "a"


def test_good_text_stays_and_bad_text_goes(corpus):
    docs, labels = corpus
    ratios, share = resampling.fit(docs, labels)
    result = resampling.resampled(cut(resampling.weighed(docs, ratios)), share)
    counted = result.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in counted}
    assert kept[1] > 0.97 and kept[0] < 0.1
    total = result.count()
    assert abs(result.where("kept").count() - share * total) <= total * 0.01 + 1


def test_resampling_of_odd_rows(frame, corpus):
    _, labels = corpus
    docs = frame([(1, None), (1, None), (2, ""), (None, CLEAN), (3, CLEAN), (3, CLEAN)], "doc_id long, text string")
    ratios, share = resampling.fit(docs, labels.where("false"))
    assert share == 1.0 and not ratios.any()
    result = resampling.resampled(cut(resampling.weighed(docs.withColumn("log_ratio", F.lit("old")), ratios)), 0.5).collect()
    by_row = {}
    for r in result:
        by_row.setdefault((r.doc_id, r.text), set()).add(r.kept)
    assert all(len(v) == 1 for v in by_row.values()) and 3 <= sum(r.kept for r in result) <= 4
    assert resampling.resampled(cut(resampling.weighed(docs.where("false"), ratios)), 0.5).count() == 0


def test_buckets_follow_the_labelled_text(frame):
    docs = frame([(i, " ".join(f"w{i}x{j}" for j in range(20_000))) for i in range(40)], "doc_id long, text string")
    labels = frame([(i, int(i < 30)) for i in range(40)], "doc_id long, quality int")
    ratios, share = resampling.fit(docs, labels)
    assert share == 0.75 and len(ratios) == 1 << 16  # 30 texts of 39 999 n-grams, at most 32 in a bucket
    assert len(resampling.fit(docs, labels.where("doc_id = 1"))[0]) == resampling.LEAST_BUCKETS
    assert len(resampling.fit(docs, labels, 777)[0]) == 777


def spark_hash(doc_id, text, seed):
    """Spark's xxhash64 of a long, a string and an int, nulls left out."""
    value = 42
    for data in (None if doc_id is None else struct.pack("<q", doc_id), None if text is None else text.encode(), struct.pack("<i", seed)):
        value = value if data is None else xxhash.xxh64(data, seed=value).intdigest()
    return value


def plain_grams(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [(w,) for w in words] + list(itertools.pairwise(words))


@pytest.mark.parametrize("weight", [400, 5, None])
def test_models_noise_and_choice_equal_dictionaries(frame, weight):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(vocabulary[: 10 if i % 3 else 40]) for _ in range(r.choice([0, 1, 2, 9, 60])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "w1 w2 w1"), (3, rows[3][1]), (502, "W1\tw2\n" * 900)]
    labels = [(i, int(i % 3 > 0)) for i in range(60)] + [(7, 0), (None, 1), (9, None), (9999, 1)]
    docs = frame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, kept string, sample_key double")
    buckets = 1 << 22
    ratios, share = resampling.fit(docs, frame(labels, "doc_id long, quality int"), buckets)
    bad = {i for i, q in labels if q == 0}
    good = {i for i, q in labels if q == 1 and i is not None} - bad
    raw = Counter(g for _, t in rows for g in plain_grams(t))
    target = Counter(g for i, t in rows if i in good for g in plain_grams(t))
    of_labelled = [i in good for i, _ in rows if i in good | bad]
    assert share == pytest.approx(sum(of_labelled) / len(of_labelled))
    ratio = {g: math.log((target[g] + 1) / (target.total() + buckets)) - math.log((n + 1) / (raw.total() + buckets)) for g, n in raw.items()}
    want = []
    for i, t in rows:
        grams = plain_grams(t)
        weight_of = sum(ratio[g] for g in grams) / len(grams) * min(len(grams), weight or len(grams)) if grams else 0.0
        uniform = ((spark_hash(i, t, resampling.SEED) >> 11) + 0.5) / 2**53
        want.append((i, t, weight_of, weight_of - math.log(-math.log(uniform))))
    least = sorted((w[3] for w in want), reverse=True)[max(math.ceil(share * len(rows)), 1) - 1]
    found = resampling.resampled(cut(resampling.weighed(docs, ratios, weight_grams=weight)), share).collect()
    got = sorted(((r.doc_id, r.text, round(r.log_ratio, 6), r.kept) for r in found), key=str)
    assert got == sorted(((i, t, round(w, 6), k >= least - 1e-9) for i, t, w, k in want), key=str)
