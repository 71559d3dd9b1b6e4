"""Key phrases and scripts written without spaces."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trendloom.functions import text as T
from trendloom.operators import clusters, keywords, similarity

ZH = "北方的天气很冷，镇上的人们每天早上带着狗走过古老的街道，晚上在河边吃饭聊天"
JA = "北の天気は寒くて、町の人々は毎朝犬と一緒に古い通りを歩き、夜は川のそばで食事をします"
TH = "อากาศทางเหนือหนาวเย็นและผู้คนในเมืองพาสุนัขเดินผ่านถนนเก่าทุกเช้าและกินข้าวริมแม่น้ำ"


def items_of(spark, rows):
    return spark.createDataFrame([("w", i, t) for i, t in rows], "workspace_id STRING, content_item_id BIGINT, content STRING")


def test_terms_by_script(spark):
    cases = {
        "New york, x1": ["new", "york", "x1"],
        "北京天": ["北京", "京天"],
        "a北京b 狗": ["a", "b", "北京", "狗"],
        "ไทย": ["ไท", "ทย"],
        "カ、カナ": ["カ", "カナ"],
        "": [],
        None: None,
    }
    df = items_of(spark, enumerate(cases))
    got = {r["content"]: r["t"] for r in df.select("content", T.terms(F.col("content")).alias("t")).collect()}
    assert {k: v and sorted(v) for k, v in got.items()} == {k: v and sorted(v) for k, v in cases.items()}


def test_near_copies_in_scripts_without_spaces(spark):
    rows, near = [], set()
    for n, text in enumerate((ZH, JA, TH)):
        rows += [(10 * n, text), (10 * n + 1, text + text[3:5]), (10 * n + 2, text[::-1])]
        near.add((10 * n, 10 * n + 1))
    df = items_of(spark, rows)
    assert {(r["src_id"], r["dst_id"]) for r in similarity.similar_texts(df, 0.9).collect()} == near
    groups = {r["content_item_id"]: r["content_cluster_id"] for r in clusters.text_clusters(df, 0.9).collect()}
    assert groups == {i: 10 * (i // 10) if i % 10 < 2 else i for i, _ in rows}


def test_a_phrase_absorbs_what_it_explains(spark):
    found = lambda t, n=3: {r["term"]: r["tf"] for r in keywords.phrase_counts(items_of(spark, [(1, t)]), longest=n).collect()}
    # all of "new york city" in one phrase; the fourth "york" is too few to stay
    assert found("New York City! new york city; new york city. York") == {"new york city": 3}
    # half of the words are elsewhere, so they stay beside the phrase
    assert found("a b, a b, a, a, b, b") == {"a b": 2, "a": 4, "b": 4}
    # signs part phrases, white space of any kind does not; once is no phrase
    assert found("a. b a. b a　b") == {"a": 3, "b": 3, "b a": 2}
    assert found("x\ty x　y", 2) == {"x y": 2}
    assert found("北京天气好 北京天气") == {"北京天气": 2, "气好": 1}
    assert found("狗 狗。猫") == {"狗": 2, "猫": 1}
    assert found("") == {} and keywords.phrase_counts(items_of(spark, [(1, None)])).count() == 0


def test_phrases_rank_before_their_words(spark):
    texts = [(1, "solar power plant here, solar power plant there, and more"), *[(i, f"and word{i} more here there") for i in range(2, 12)]]
    top = keywords.tfidf_keyphrases(items_of(spark, texts), 2).where("content_item_id = 1").orderBy("rank").collect()
    assert [r["keyword_text"] for r in top][0] == "solar power plant"


def plain_candidates(stretches, runs, longest):
    """Candidates of one text, phrase by phrase."""
    counts = [Counter() for _ in range(longest + 1)]
    for words in map(str.split, stretches):
        for n in range(1, longest + 1):
            counts[n].update(zip(*(words[i:] for i in range(n)), strict=False))
    for run in runs:
        counts[1].update([run] if len(run) == 1 else [])
        for n in range(1, longest + 1):
            counts[n].update(run[i : i + n + 1] for i in range(len(run) - n))
    found, explained = {}, Counter()
    for n in range(longest, 0, -1):
        for phrase, count in counts[n].items():
            if n > 1 and count < 2:
                continue
            spaceless = isinstance(phrase, str)
            if 4 * explained[n, phrase] < 3 * count:
                found[phrase if spaceless else " ".join(phrase)] = count
            for m in range(1, n):
                for i in range(n - m + 1):
                    inner = m, phrase[i : i + m + spaceless]
                    explained[inner] = max(explained[inner], count)
    return found


def random_texts(n, signs):
    draw = random.Random(5)
    return [(i, "".join(draw.choice(signs) for _ in range(draw.choice([0, 3, 40, 400])))) for i in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_phrases_counted_by_number_equal_plain_counts(spark, longest, monkeypatch):
    monkeypatch.setattr(keywords, "BATCH_CHARS", 500)  # a text longer than this is a batch of its own
    texts = random_texts(120, ["a ", "b ", "é\t", "c\u3000", "Long Word ", ". ", "東", "京", "東京 ", "ไ", "1"]) + [(500, None), (501, " "), (502, "狗")]
    items = items_of(spark, texts)
    parts = {r["content_item_id"]: (r["s"] or [], r["r"] or []) for r in items.select(
        "content_item_id", T.segments(F.col("content")).alias("s"), T.spaceless_runs(F.col("content")).alias("r")).collect()}
    got = {i: {} for i, _ in texts}
    for r in keywords.phrase_counts(items, longest=longest).collect():
        assert r["term"] not in got[r["content_item_id"]]
        got[r["content_item_id"]][r["term"]] = r["tf"]
    assert got == {i: plain_candidates(*parts[i], longest) for i, _ in texts}


@pytest.mark.parametrize("known", [0, 4, 1 << 17])
def test_only_phrases_that_can_be_among_the_heaviest_are_joined(spark, known, monkeypatch):
    monkeypatch.setattr(keywords, "KNOWN_TERMS", known)
    draw = random.Random(7)
    texts = [(i, " ".join(f"w{int(draw.paretovariate(0.4)) % 5000}" for _ in range(draw.choice([3, 30, 300])))) for i in range(300)] + [(900, "")]
    items = items_of(spark, texts).withColumn("workspace_id", F.when(F.col("content_item_id") % 9 > 0, F.concat(F.lit("w"), F.col("content_item_id") % 2)))
    columns = ["workspace_id", "content_item_id", "term", "tf", "df", "weight"]
    every = {tuple(r) for r in keywords.term_weights(items).select(*columns).collect()}
    few = {tuple(r) for r in keywords.term_weights(items, k=5).select(*columns).collect()}
    best = lambda rows, i: sorted((-r[5], r[2]) for r in rows if r[1] == i)[:5]
    assert few <= every and all(best(few, i) == best(every, i) for i, _ in texts)
    assert len(few) <= (0.3 if known > 4 else 1) * len(every)  # with nothing known little can be left out, and nothing is lost


def test_no_items_have_no_phrases(spark):
    assert keywords.tfidf_keyphrases(items_of(spark, [(1, None)]).where("content_item_id = 2")).count() == 0
    assert keywords.tfidf_keyphrases(items_of(spark, [(1, None), (2, "")])).count() == 0
