"""Benchmark passages in documents, found by winnowed k-gram fingerprints and extended to whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import ascii_lower, text_key
from trendloom.session import cut

# Fixed value: what separates words; a word is a run of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10  # words that must be shared
K = 8  # words of a k-gram; of the WINDOW - K + 1 k-grams in a window the smallest hash is kept


def _shifted(column: Column, by: int, f) -> Column:
    """f(x[i], x[i + by]) for each i that has both."""
    later = F.slice(column, by + 1, F.greatest(F.size(column) - by, F.lit(0)))
    return F.zip_with(F.slice(column, 1, F.size(later)), later, f)


def with_grams(df: DataFrame, lengths: list[int], words: str = "_words") -> DataFrame:
    """Adds ``_gram_<n>``, the hashes of all n words in a row, for each n, from an array of words.

    A run is made of two that overlap, of the largest power of two in it. Hashes are of words in lower case of all scripts,
    which may only make more of them meet; what counts is compared by the words themselves afterwards.
    """
    df = df.withColumn("_gram_1", F.transform(words, lambda w: F.xxhash64(F.lower(w))))
    for n in sorted({p for n in lengths for p in [*_powers(n), n]} - {1}):
        half, salt = 1 << ((n - 1).bit_length() - 1), F.lit(n)
        df = df.withColumn(f"_gram_{n}", _shifted(F.col(f"_gram_{half}"), n - half, _pair_hash(salt)))
    return df


def _pair_hash(salt: Column):
    return lambda a, b: F.xxhash64(a, b, salt)


def _powers(n: int) -> list[int]:
    return [1 << i for i in range((n - 1).bit_length())]


def _winnowed(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds ``_kept``: the smallest k-gram hash of every run of ``window`` words; none for shorter texts."""
    span, column = window - k + 1, f"_gram_{k}"
    done = 1
    df = df.withColumn("_least_1", F.col(column))
    while done < span:
        step = min(done, span - done)
        df = df.withColumn(f"_least_{done + step}", _shifted(F.col(f"_least_{done}"), step, lambda a, b: F.least(a, b)))
        done += step
    return df.withColumn("_kept", F.col(f"_least_{span}"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def _fingerprints(df: DataFrame, short: list[int], k: int, window: int) -> DataFrame:
    """Adds ``_prints``: distinct winnowed hashes, and for each length of a short item the hashes of all runs so long."""
    df = _winnowed(with_grams(df, [k, *short]), k, window)
    return df.withColumn("_prints", F.array_distinct(F.concat("_kept", *[f"_gram_{n}" for n in short])))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, passage): every distinct run of ``window`` words of an item, or all words of a shorter one."""
    own = benchmark.select("item_id", F.transform(_words(F.col("text")), ascii_lower).alias("_words")).where(F.size("_words") > 0)
    n = F.size("_words")
    length = F.least(n, F.lit(window))
    starts = F.sequence(F.lit(1), n - length + 1)
    passages = F.transform(starts, lambda i: F.array_join(F.slice(F.col("_words"), i, length), " "))
    return own.select("item_id", length.alias("length"), F.explode(F.array_distinct(passages)).alias("passage")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs`` (doc_id, text).

    A window is a run of ten words of a ``benchmark`` (item_id, text) row, or all words of a shorter one. n_hit counts the
    document words inside an occurrence of a window, n_items the items with a window that occurs, items_sha256 is of their ids
    sorted as strings and joined by commas.

    Both sides keep the smallest hash of the k-grams in every run of ten words, so any shared run has a fingerprint on both
    sides. Fingerprints of documents meet those of items; only texts with a hit are read again, and each hit is extended to
    the windows around it, which are compared word by word. Equal texts are looked at once. Items shorter than a window are
    looked up by hashes of all runs of their length.

    Null, empty and wordless texts have no words and no hit. Items without words or item_id match nothing, repeated items count
    once. Empty tables are allowed on both sides; other columns are not read. The Spark plan broadcasts a side only if its
    written size is below Spark's threshold.
    """
    docs = docs.select("doc_id", "text")
    items = cut(benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()))
    windows = cut(item_windows(items, window))
    short = [r[0] for r in windows.select("length").where(F.col("length") < window).distinct().collect()]  # at most nine numbers
    short.sort()
    item_words = items.select(_words(F.col("text")).alias("_words"))
    # outer generators: for inner ones Spark infers a filter on the array and writes all levels below out in full for it
    wanted = _fingerprints(item_words, short, k, window).select(F.explode_outer("_prints").alias("fingerprint"))
    wanted = cut(wanted.where(F.col("fingerprint").isNotNull()).distinct())

    split = docs.select("doc_id", text_key().alias("text_key"), _words(F.col("text")).alias("_words"))
    marked = _fingerprints(split.withColumn("n_words", F.size("_words").cast("long")), short, k, window)
    base = cut(marked.select("doc_id", "text_key", "n_words", "_prints"))
    hits = cut(base.select("text_key", F.explode("_prints").alias("fingerprint")).join(wanted, "fingerprint", "left_semi").distinct())

    # true of all hits: with a comparison on one side Spark sends its Bloom filter ahead, and only texts with a hit are shuffled
    found = hits.where(F.col("fingerprint") <= F.lit((1 << 63) - 1)).select("text_key")
    texts = docs.select(text_key().alias("text_key"), "text").join(found, "text_key", "left_semi").dropDuplicates(["text_key"])
    held = cut(texts.select("text_key", F.transform(_words(F.col("text")), ascii_lower).alias("_words")))
    grams = with_grams(held, [k, *short])

    def placed(column: str, length: int) -> Column:
        return F.transform(column, lambda x, i: F.struct(x.alias("fingerprint"), i.alias("at"), F.lit(length).alias("length")))

    every = F.concat(placed(f"_gram_{k}", window), *[placed(f"_gram_{n}", n) for n in short])
    at = grams.select("text_key", F.inline_outer(every)).join(hits, ["text_key", "fingerprint"], "left_semi")
    reach = F.when(F.col("length") == window, window - k).otherwise(0)
    starts = at.select("text_key", "length", F.explode(F.sequence(F.greatest(F.col("at") - reach, F.lit(0)), F.col("at"))).alias("start"))
    starts = starts.distinct().groupBy("text_key").agg(F.collect_list(F.struct("start", "length")).alias("starts"))
    near = held.join(starts, "text_key")
    whole = F.filter("starts", lambda s: s.start + s.length <= F.size("_words"))
    runs = F.transform(whole, lambda s: F.struct(s.start.alias("start"), s.length.alias("length"), F.array_join(F.slice(F.col("_words"), s.start + 1, s.length), " ").alias("passage")))
    met = cut(near.select("text_key", F.inline(runs)).join(windows.select("length", "passage").distinct(), ["length", "passage"]))

    places = met.select("text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    n_hit = places.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    with_items = met.select("text_key", "length", "passage").distinct().join(windows, ["length", "passage"])
    pairs = with_items.select("text_key", F.col("item_id").cast("string").alias("item")).distinct()
    listed = F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256)
    n_items = pairs.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_items"), listed.alias("items_sha256"))
    verdicts = n_hit.join(n_items, "text_key")

    result = base.select("doc_id", "text_key", "n_words").join(verdicts, "text_key", "left")
    zero = F.lit(0).cast("long")
    return result.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM i),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
o AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM p),
m AS (SELECT o.r, o.s, o.n, o.k FROM o SEMI JOIN v ON o.n = v.n AND o.k = v.k),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT m.r, CAST(v.item_id AS VARCHAR) AS item FROM m JOIN v ON m.n = v.n AND m.k = v.k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r"""
