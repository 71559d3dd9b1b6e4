"""Keyword rows and their roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.batches import parts_of_size, plain
from trendloom.functions.text import hashtags, segments, spaceless_runs, terms
from trendloom.operators.filters import in_list, in_workspace, keep_listed, published_between
from trendloom.operators.ranking import top_per_key, with_running_sum
from trendloom.session import cut

KEYWORD_COLUMNS = [
    "content_keyword_id", "workspace_id", "keyword_model_name", "content_item_id", "keyword_text", "keyword_score",
    "content_published_date",
]
LIST_PART = 10_000
CLASSIFY_BATCH = 25
LONGEST_PHRASE = 3
ABSORB = 4  # a phrase with 3 of 4 occurrences of a shorter one absorbs it
BATCH_CHARS = 1 << 22
BATCH_TERMS = 1 << 20
KNOWN_TERMS = 1 << 17  # common terms that every task holds with their idf: some 4 MB
BETWEEN = "\0"  # in no term


def keyword_id(item: Column, model: Column, position: Column) -> Column:
    return F.xxhash64(item, model, position)


def hashtag_keywords(items: DataFrame, id_of: Callable[[Column, Column, Column], Column] = keyword_id) -> DataFrame:
    """One row per hashtag occurrence; a tag used twice gives two rows."""
    model = F.lit("hashtags")
    found = items.select(
        "workspace_id", "content_item_id", "content_published_date",
        F.posexplode(hashtags(F.col("content"))).alias("position", "keyword_text"),
    )
    return found.withColumns({
        "keyword_model_name": model,
        "content_keyword_id": id_of(F.col("content_item_id"), model, F.col("position")),
        "keyword_score": F.lit(1.0),
    }).select(*KEYWORD_COLUMNS)


def attach_keywords(sets: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyword sets (workspace, item, model, [(text, score)]) to rows, and the sets that were refused.

    A set is refused when its item is unknown or belongs to another workspace.
    """
    owner = items.select(
        "content_item_id", F.col("workspace_id").alias("item_workspace_id"), "content_published_date"
    )
    joined = sets.join(owner, "content_item_id", "left")
    ok = F.coalesce(F.col("workspace_id") == F.col("item_workspace_id"), F.lit(False))
    rows = joined.where(ok).select(
        "workspace_id", "content_item_id", "keyword_model_name", "content_published_date",
        F.posexplode("keywords").alias("position", "k"),
    )
    rows = rows.withColumns({
        "content_keyword_id": keyword_id(F.col("content_item_id"), F.col("keyword_model_name"), F.col("position")),
        "keyword_text": F.col("k.keyword_text"),
        "keyword_score": F.coalesce("k.keyword_score", F.lit(1.0)),
    })
    refused = joined.where(~ok).select(*sets.columns)
    return rows.select(*KEYWORD_COLUMNS), refused


def keyword_rows(
    keywords: DataFrame, workspace_id=None, model_name=None, content_item_ids=None, keyword_texts=None,
    start_date=None, end_date=None, max_limit: int | None = None,
) -> DataFrame:
    """Keyword rows by workspace, model, items, texts and published date; the first ``max_limit`` in id
    order, or all of them, unsorted."""
    rows = keywords.where(in_workspace(workspace_id) & in_list("keyword_model_name", [model_name] if model_name else None))
    rows = rows.where(in_list("keyword_text", keyword_texts) & published_between(start_date, end_date))
    rows = keep_listed(rows, "content_item_id", content_item_ids)
    return rows if max_limit is None else rows.orderBy("content_keyword_id").limit(max_limit)


def keyword_rollup(
    keywords: DataFrame, items: DataFrame, workspace_id=None, model_name=None, min_count: int = 2,
    content_cluster_ids=None, keyword_texts=None, min_pub_date=None, max_pub_date=None,
    max_limit: int | None = None,
) -> DataFrame:
    """Items, clusters and newest date per keyword, most used first.

    Counted in two steps, by (keyword, cluster) and then by keyword: a hot keyword is spread over its
    clusters, and both counts come without a distinct. Keyword ids are keys, so rows count as ids.
    """
    picked = _rollup_input(keywords, items, workspace_id, model_name, content_cluster_ids, keyword_texts)
    keys = ["workspace_id", "keyword_model_name", "keyword_text"]
    by_cluster = picked.groupBy(*keys, "content_cluster_id").agg(
        F.count("content_keyword_id").alias("n"),
        F.min("content_published_date").alias("first_date"),
        F.max("content_published_date").alias("last_date"),
    )
    rolled = by_cluster.groupBy(*keys).agg(
        F.sum("n").alias("num_items"),
        F.count("content_cluster_id").alias("num_clusters"),
        F.min("first_date").alias("min_published_date"),
        F.max("last_date").alias("max_published_date"),
    )
    kept = rolled.where(F.col("num_items") >= min_count)
    kept = kept.where(published_between(start=min_pub_date, col="min_published_date"))
    kept = kept.where(published_between(end=max_pub_date, col="max_published_date")).drop("min_published_date")
    kept = kept.orderBy(F.desc("num_items"), F.asc_nulls_last("max_published_date"), *keys)
    return kept if max_limit is None else kept.limit(max_limit)


def _rollup_input(keywords, items, workspace_id, model_name, content_cluster_ids, keyword_texts) -> DataFrame:
    wanted = keywords.where(in_workspace(workspace_id) & in_list("keyword_model_name", [model_name] if model_name else None))
    wanted = wanted.where(in_list("keyword_text", keyword_texts))
    wanted = wanted.select("content_keyword_id", "workspace_id", "keyword_model_name", "keyword_text", "content_item_id")
    owner = items.where(in_list("content_cluster_id", content_cluster_ids)).select(
        "content_item_id", "content_cluster_id", "content_published_date"
    )
    return wanted.join(owner, "content_item_id")


def keyword_id_lists(
    keywords: DataFrame, items: DataFrame, rollup: DataFrame, part_size: int = LIST_PART
) -> DataFrame:
    """The id lists of the keywords in ``rollup``, comma-separated in keyword id order.

    A keyword with more than ``part_size`` items gets its lists in several parts, numbered from 0 and in id order; each
    is built by its own group, so that no list grows past a bound and none is cut. Places of ids are counted only for such
    keywords, over even segments where one is very large.
    """
    keys = ["workspace_id", "keyword_model_name", "keyword_text"]
    picked = _rollup_input(keywords, items, None, None, None, None)
    picked = picked.join(rollup.select(*keys, (F.col("num_items") > part_size).alias("is_long")), keys)
    short = picked.where("NOT is_long").withColumn("part", F.lit(0))
    long = with_running_sum(picked.where("is_long"), keys, ["content_keyword_id"], F.lit(1), "place")
    long = long.withColumn("part", F.floor((F.col("place") - 1) / part_size).cast("int")).drop("place")
    picked = short.unionByName(long)

    def listed(col: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct("content_keyword_id", F.col(col).cast("string").alias("v"))))
        values = F.filter(F.transform(pairs, lambda p: p["v"]), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.array_join(values, ",")).alias(f"{col}s")

    return picked.groupBy(*keys, "part").agg(
        listed("content_keyword_id"), listed("content_item_id"), listed("content_cluster_id")
    )


def joined_id_lists(parts: DataFrame) -> DataFrame:
    """The parts of ``keyword_id_lists`` put together again: one row a keyword, with part 0 and its whole lists."""
    keys = ["workspace_id", "keyword_model_name", "keyword_text"]
    columns = ["content_keyword_ids", "content_item_ids", "content_cluster_ids"]
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", *columns))).alias("parts"))

    def whole(col: str) -> Column:  # a part without values is null and adds nothing
        values = F.filter(F.transform("parts", lambda p: p[col]), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.array_join(values, ",")).alias(col)

    return gathered.select(*keys, F.lit(0).alias("part"), *[whole(c) for c in columns])


def size_filter(rollup: DataFrame, min_items: int = 2, min_clusters: int = 0) -> DataFrame:
    return rollup.where((F.col("num_items") >= min_items) & (F.col("num_clusters") >= min_clusters))


def _units(batch: pa.RecordBatch) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts of a batch, with the stretch and the row each is in, and whether it is a pair of neighbouring characters."""

    def rows_of(lists: pa.ListArray) -> np.ndarray:
        return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))

    split = pc.utf8_split_whitespace(batch.column("stretches").flatten())
    words = split.flatten()
    stretch = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(words), 0)
    words, stretch = words.filter(real), stretch[real.to_numpy(zero_copy_only=False)]
    runs = batch.column("runs").flatten().to_pylist()
    pairs = [[run[i : i + 2] for i in range(max(1, len(run) - 1))] for run in runs]
    of_run = np.repeat(np.arange(len(runs)), [len(p) for p in pairs]).astype(np.int64) + len(split)
    units = pa.concat_arrays([words, pa.array([u for p in pairs for u in p], pa.string())])
    row = np.concatenate([rows_of(batch.column("stretches")), rows_of(batch.column("runs"))])
    stretch = np.concatenate([stretch, of_run])
    return units, stretch, row[stretch], np.arange(len(units)) >= len(words)


def _candidates(batch: pa.RecordBatch, longest: int) -> pa.RecordBatch:
    """Phrases of each text with their counts: words, repeated phrases of 2 to ``longest`` words, less what longer ones explain.

    A phrase of n words has the number that its first and its last n - 1 words have as a pair. Only what occurs twice in a text
    can be part of a phrase that does.
    """
    units, stretch, row, spaceless = _units(batch)
    word = units.dictionary_encode()
    ids = [np.zeros(0, np.int64), word.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    _, first, inverse, count = np.unique(row * max(1, len(word.dictionary)) + ids[1], return_index=True, return_inverse=True, return_counts=True)
    ids[1], firsts, counts = inverse, [first, first], [count, count]
    often = count[inverse] >= 2  # by place: whether the phrase that starts here occurs twice
    for n in range(2, longest + 1):
        at = np.nonzero(often[:-1] & often[1:])[0]
        at = at[at + n <= len(stretch)]
        at = at[stretch[at] == stretch[at + n - 1]]
        keys = ids[n - 1][at] * len(counts[n - 1]) + ids[n - 1][at + 1]
        _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        ids.append(np.full(len(stretch), -1))
        ids[n][at] = inverse
        firsts.append(at[first])
        counts.append(count)
        often = np.zeros(len(stretch), bool)
        often[at] = count[inverse] >= 2
    explained = [np.zeros(len(c), np.int64) for c in counts]
    terms_of, rows, found = [], [], []
    for n in range(longest, 0, -1):
        stays = ABSORB * explained[n] < (ABSORB - 1) * counts[n]
        again = counts[n] >= 2
        for m in range(1, n):
            for i in range(n - m + 1):
                np.maximum.at(explained[m], ids[m][firsts[n][again] + i], counts[n][again])
        chosen = stays if n == 1 else stays & again
        for kind in (False, True):
            here = chosen & (spaceless[firsts[n]] == kind)
            at = firsts[n][here]
            parts = [units.take(pa.array(at + i)) for i in range(n)]
            if kind:  # n pairs of neighbours are n + 1 characters
                parts[1:] = [pc.utf8_slice_codeunits(p, 1) for p in parts[1:]]
            terms_of.append(pc.binary_join_element_wise(*parts, "" if kind else " ") if n > 1 else parts[0])
            rows.append(row[at])
            found.append(counts[n][here])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    offsets = pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32))
    lists = [pa.concat_arrays(terms_of).take(pa.array(order)), pa.array(np.concatenate(found).astype(np.int64)[order])]
    return pa.RecordBatch.from_arrays(
        [batch.column("workspace_id"), batch.column("content_item_id"), *[pa.ListArray.from_arrays(offsets, v) for v in lists]],
        names=["workspace_id", "content_item_id", "terms", "tfs"],
    )


def phrase_lists(items: DataFrame, text: str = "content", longest: int = LONGEST_PHRASE) -> DataFrame:
    """(workspace_id, content_item_id, terms, tfs): the candidate phrases of each item with their counts, one row an item.

    A candidate is a word, or 2 to ``longest`` words that white space alone parts and that occur at least twice; in scripts
    without spaces 2 to ``longest`` + 1 neighbouring characters. A phrase is left out if a longer one that holds it has at
    least three quarters of its occurrences. Texts are counted many at a time, over numbers instead of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of_size(batch, pc.fill_null(batch.column("size"), 0).to_numpy(zero_copy_only=False), BATCH_CHARS):
                yield _candidates(part, longest)

    c = F.col(text)
    read = items.select(
        "workspace_id", "content_item_id", F.length(c).cast("bigint").alias("size"), segments(c).alias("stretches"), spaceless_runs(c).alias("runs")
    )
    return read.mapInArrow(run, "workspace_id STRING, content_item_id BIGINT, terms ARRAY<STRING>, tfs ARRAY<BIGINT>")


def _each_phrase(lists: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))
    return lists.select("workspace_id", "content_item_id", F.inline(pairs).alias("term", "tf"))


def phrase_counts(items: DataFrame, text: str = "content", longest: int = LONGEST_PHRASE) -> DataFrame:
    """(workspace_id, content_item_id, term, tf): the rows of ``phrase_lists``, one a phrase."""
    return _each_phrase(phrase_lists(items, text, longest))


def _idf(total: Column, df: Column) -> Column:
    return 1 + F.floor(16 * F.ln(total / df))


def _common_terms(rated: DataFrame) -> tuple[pa.StringArray, np.ndarray, int]:
    """Terms with their workspace that most items have, at most ``KNOWN_TERMS``, their idf, and the number of items from which on all are known."""
    level = F.length(F.bin("df"))
    sizes = rated.groupBy(level.alias("level")).count().collect()  # one row a power of two
    least, total = 64, 0
    for bits, n in sorted(sizes, reverse=True):
        total += n
        if total > KNOWN_TERMS:
            break
        least = bits
    known = rated.where(level >= least).select(F.concat("term", F.lit(BETWEEN), "workspace_id").alias("key"), "idf").toArrow()
    return known["key"].combine_chunks(), known["idf"].to_numpy(), 2 ** (least - 1)


def heaviest(lists: DataFrame, rated: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(workspace_id, content_item_id, term, tf): the phrases that can be among the k heaviest of their item, few more than k.

    Tasks hold the idf of the common terms; that of any other lies between those of one item and of as many as the rarest of them
    has. A phrase stays unless k others of its item weigh more for certain, so none of the k heaviest is lost, whatever is known.
    """
    found = _common_terms(rated)
    common = lists.sparkSession.sparkContext.broadcast(found)
    bounds = totals.select("workspace_id", _idf(F.col("total"), F.lit(1)).alias("most"), _idf(
        F.col("total"), F.least("total", F.lit(max(1, found[2] - 1)))).alias("least"))
    names = ["workspace_id", "content_item_id", "term", "tf"]

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, idf, _ = common.value
        sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        words, tf = batch.column("terms").flatten(), batch.column("tfs").flatten().to_numpy()
        workspace = batch.column("workspace_id").take(pa.array(row))
        place = pc.fill_null(pc.index_in(pc.binary_join_element_wise(words, workspace, BETWEEN), value_set=keys), -1).to_numpy(zero_copy_only=False)
        own = np.append(idf, 0)[place]
        low, high = (tf * np.where(place >= 0, own, batch.column(c).to_numpy()[row]) for c in ("least", "most"))
        ordered = low[np.lexsort((-low, row))]
        kth = np.cumsum(sizes) - sizes + k - 1
        bound = np.where(sizes >= k, ordered[np.minimum(kth, len(ordered) - 1)], 0) if len(ordered) else np.zeros(len(sizes))
        kept = np.nonzero(high >= bound[row])[0]
        columns = [workspace.take(pa.array(kept)), batch.column("content_item_id").take(pa.array(row[kept])), words.take(pa.array(kept)), pa.array(tf[kept])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of_size(batch, pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False), BATCH_TERMS):
                yield weigh(part)

    return lists.join(bounds, "workspace_id").mapInArrow(run, "workspace_id STRING, content_item_id BIGINT, term STRING, tf BIGINT")


def term_weights(items: DataFrame, text: str = "content", longest: int = LONGEST_PHRASE, k: int | None = None) -> DataFrame:
    """Whole-number tf-idf weight of each candidate phrase per item: tf * (1 + floor(16 ln(N / df))).

    Whole weights make sums exact, so that results do not depend on partitioning. Candidates are written once, a row an item. With
    ``k`` only phrases that can be among the k heaviest of their item are joined with their counts, else all are; that join
    on (workspace, term) has a hot side for common words, which AQE splits.
    """
    lists = cut(phrase_lists(items, text, longest))
    each = lists.select("workspace_id", F.explode("terms").alias("term"))
    spread = each.groupBy("workspace_id", "term").agg(F.count(F.lit(1)).alias("df"))
    totals = cut(items.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total")))
    rated = spread.join(totals, "workspace_id").select("workspace_id", "term", "df", _idf(F.col("total"), F.col("df")).alias("idf"))
    if k is None:
        counts = _each_phrase(lists)
    else:
        rated = cut(rated)
        counts = heaviest(lists, rated, totals, k)
    weighed = counts.join(rated, ["workspace_id", "term"])
    return weighed.select(
        "workspace_id", "content_item_id", "term", "tf", "df", (F.col("tf") * F.col("idf")).alias("weight")
    )


def word_sets(items: DataFrame, text: str = "content") -> DataFrame:
    """The distinct words of each item with weight 1, and the number of items that have the word.

    Repeats are dropped within the row, so that each word of an item is shuffled once.
    """
    words = items.select("workspace_id", "content_item_id", F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    spread = words.groupBy("workspace_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return words.join(spread, ["workspace_id", "term"]).select(
        "workspace_id", "content_item_id", "term", "df", F.lit(1).cast("bigint").alias("weight")
    )


def tfidf_keyphrases(items: DataFrame, k: int = 5, text: str = "content", model: str = "tfidf") -> DataFrame:
    """The k heaviest words and phrases of each item as keyword rows; a lower score is better."""
    top = top_per_key(
        term_weights(items, text, k=k), ["workspace_id", "content_item_id"], [F.desc("weight"), F.asc("term")], k
    )
    return top.select(
        "workspace_id", "content_item_id", F.lit(model).alias("keyword_model_name"), F.col("rank"),
        F.col("term").alias("keyword_text"), (F.lit(1.0) / F.col("weight")).alias("keyword_score"),
    )


# Topics of the default classifier and the words that stand for them.
TOPICS = {
    "election": ["election", "vote", "ballot", "poll"],
    "health": ["health", "vaccine", "virus", "doctor"],
    "economy": ["economy", "price", "tax", "market"],
}


def lexicon_classifier(topics: dict[str, list[str]] | None = None) -> Callable[[pd.DataFrame], pd.Series]:
    """A classifier over batches: labels of the topics whose words occur in a text."""
    lexicon = {topic: set(words) for topic, words in (topics or TOPICS).items()}

    def classify(batch: pd.DataFrame) -> pd.Series:
        words = batch["content"].fillna("").str.lower().str.findall(r"\w+").map(set)
        return words.map(lambda w: [t for t, known in lexicon.items() if w & known])

    return classify


def batch_classify(
    items: DataFrame, schema_id: str, model: Callable[[pd.DataFrame], pd.Series], batch_size: int = CLASSIFY_BATCH
) -> DataFrame:
    """Labels of each item from a model that takes batches of at most ``batch_size`` rows.

    The model must answer each batch with as many label lists as it has rows. Labels become keyword
    sets of score 1.0, ready for ``attach_keywords``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                batch = frame.iloc[start:start + batch_size]
                labels = list(model(batch))
                if len(labels) != len(batch):
                    raise ValueError(f"{len(labels)} answers for {len(batch)} items")
                answers = pd.Series([list(one) for one in labels], index=batch.index, dtype=object)
                yield plain(batch[["workspace_id", "content_item_id"]].assign(labels=answers))

    answered = items.select("workspace_id", "content_item_id", "content").mapInPandas(
        run, "workspace_id STRING, content_item_id BIGINT, labels ARRAY<STRING>"
    )
    return label_keywords(answered, f"classifier:{schema_id}")


def label_keywords(answered: DataFrame, model_name: str) -> DataFrame:
    """Label lists as keyword sets of score 1.0."""
    pairs = F.transform(
        "labels", lambda label: F.struct(label.alias("keyword_text"), F.lit(1.0).alias("keyword_score"))
    )
    return answered.select(
        "workspace_id", "content_item_id", F.lit(model_name).alias("keyword_model_name"), pairs.alias("keywords")
    )
