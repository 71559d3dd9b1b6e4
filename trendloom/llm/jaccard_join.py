"""Texts that share most of their word shingles: size-banded tiles, hashed bitmaps, exact intersections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import drop_from, gram_hashes, text_key, word_hashes
from trendloom.operators.clusters import connected_components
from trendloom.session import cut, cut_and_measure

SHINGLE = 5
LEAST = 80  # per cent of the union that two sets must share
FREQUENT = 1 << 17  # shingles whose counts settle the order; all others come before them
SMALL = 16  # rows of a token that are compared with each other right away
TILE = 2048  # rows of one side of a tile


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``size`` words.

    A text of fewer words has one: the whole sequence. A text without words has none.
    """
    hashes, borders = word_hashes(texts)
    grams = gram_hashes(hashes, size)
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1].view(np.int64))
        else:
            yield gram_hashes(hashes[a:b], int(b - a)).view(np.int64)[:1] if b > a else np.zeros(0, np.int64)


def frequent_shingles(docs: DataFrame, size: int = FREQUENT, local: int = 3, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all texts and their counts, sorted by shingle.

    They only settle in which order shingles are taken, never which texts link, so a count may leave out what a task saw
    fewer than ``local`` times in a block. At most ``size`` numbers reach the driver and the tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= local
            return pa.RecordBatch.from_pydict({"shingle": values[often], "n": counts[often].astype(np.int64)})

        for batch in batches:
            for shingles in shingle_sets(batch.column(0)):
                held.append(shingles)
                n += len(shingles)
                if n >= block:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "shingle").limit(size).orderBy("shingle").toPandas()
    return rows["shingle"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles that fall on each bit, as 64-bit integers; as many bits as shingles, rounded up to a power of two."""
    bits = 1 << max(6, int(len(shingles) - 1).bit_length())
    return np.packbits(np.bincount(shingles & np.int64(bits - 1), minlength=bits) & 1).view(np.int64)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bits as they would be with ``size`` integers: parities of halves combine by exclusive or."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def profiles(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, doc_id, text_key, set_key, n_shingles, rare, prefix, bits) of every row of ``docs``, written to the shared folder.

    ``rare`` counts the shingles that are not among the frequent ones: few in a text that its near copies were made from.
    ``prefix`` holds the shingles, rarest first, of which two texts must share one if they link: a set of n shares at least
    0.8 n with any partner, so all but 0.8 n - 1 of its shingles are enough. ``set_key`` is null for an empty set.
    """
    known, counts = frequent

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            keys, sizes, rare, prefixes, bitmaps = [], [], [], [], []
            for s in shingle_sets(drop_from(batch, "text")):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    n = np.where(known[at] == s, counts[at], 0)
                    order = np.lexsort((s, n))
                    rare.append(int((n == 0).sum()))
                else:
                    order = np.arange(len(s))
                    rare.append(len(s))
                prefixes.append(s[order[: len(s) - (LEAST * len(s) + 99) // 100 + 1]] if len(s) else s)
                bitmaps.append(_bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [drop_from(batch, "doc_id"), drop_from(batch, "text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(rare, pa.int64()), _lists(prefixes), _lists(bitmaps)],
                names=["doc_id", "text_key", "set_key", "n_shingles", "rare", "prefix", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    found = keyed.mapInArrow(profile, f"doc_id {kind}, text_key binary, set_key binary, n_shingles long, rare long, prefix array<long>, bits array<long>")
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sizes_fit(na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= LEAST * F.greatest(na, nb)


def _may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may link if ``differ`` of their bits differ.

    Each bit that differs stands for at least one shingle that only one set holds, so they share (na + nb - differ) / 2 at most.
    """
    return (100 + LEAST) * (na + nb - differ) >= 2 * LEAST * (na + nb)


def bounded(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Those pairs (a, b) of rows whose sizes and bitmaps do not rule them out."""

    @F.arrow_udf("boolean")
    def may(x: pa.Array, y: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        left, right = (np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) for c in (x, y))
        differ = np.zeros(len(x), np.int64)
        for i, (s, t) in enumerate(zip(left, right, strict=True)):
            size = min(len(s), len(t))
            differ[i] = np.bitwise_count((_folded(s, size) ^ _folded(t, size)).view(np.uint64)).sum()
        return pa.array(_may_link(na.to_numpy(), nb.to_numpy(), differ))

    side = profile.select("row", "n_shingles", "bits")
    left = side.select(F.col("row").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("xa"))
    right = side.select(F.col("row").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("xb"))
    both = pairs.join(left, "a").join(right, "b").where(_sizes_fit(F.col("na"), F.col("nb")))
    return both.where(may("xa", "xb", "na", "nb")).select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, profile: DataFrame) -> DataFrame:
    """Those pairs (a, b) of rows that link, by exact intersection of their sorted sets.

    Only texts that are part of a pair are read again; ``pairs`` is read more than once, so hand in a written table.
    """
    rows = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    wanted = profile.select("row", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).join(rows, "row", "left_semi")
    texts = docs.select("doc_id", "text", text_key().alias("text_key"))
    met = texts.join(wanted, F.col("text_key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([drop_from(batch, "row"), _lists(list(shingle_sets(drop_from(batch, "text"))))], names=["row", "shingles"])

    held = cut(met.select("row", "text").mapInArrow(sets, "row long, shingles array<long>").dropDuplicates(["row"]))

    @F.arrow_udf("boolean")
    def link(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        left, right = x.flatten().to_numpy(), y.flatten().to_numpy()
        a = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
        b = np.concatenate([[0], np.cumsum(y.value_lengths().to_numpy())])
        for i in range(len(x)):
            s, t = left[a[i] : a[i + 1]], right[b[i] : b[i + 1]]
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            common = int((t[at] == s).sum())
            out.append(100 * common >= LEAST * (len(s) + len(t) - common))
        return pa.array(out)

    left = held.select(F.col("row").alias("a"), F.col("shingles").alias("sa"))
    right = held.select(F.col("row").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(link("sa", "sb")).select("a", "b")


def tile_pairs(members: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) that tiles leave over, of rows that share a token but no component.

    ``members`` has (token, row, n_shingles, bits, component). In each token the rows outside its largest component, on the left,
    are compared with all its rows, on the right. More than ``tile`` rows are cut by size into bands of ratio 0.8 and each side of
    a band by hash into slices of about ``tile`` rows; rows can only link inside a band or with a neighbouring one, and a slice of
    the left with one of the right is a tile. Inside a tile the bitmaps bound the overlap from above.
    """
    parts = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("token").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "component")).alias("largest"))
    slices = whole.select(
        "token", F.col("largest.component").alias("main"), F.ceil(F.col("rows") / tile).cast("int").alias("rights"),
        F.greatest(F.ceil((F.col("rows") - F.col("largest.n")) / tile), F.lit(1)).cast("int").alias("lefts"),
    )
    split = F.col("rights") > 1
    band = F.when(split, F.floor(F.log(F.col("n_shingles") * 1.0) / math.log(100 / LEAST))).otherwise(0).cast("int")
    cuts = members.join(slices, "token").withColumns({"band": band, "rest": F.col("component") != F.col("main"), "mixed": F.xxhash64("row")})
    steps = F.when(split, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    own = F.col("band")

    def side(left: bool) -> Column:
        mine, others = ("lefts", "rights") if left else ("rights", "lefts")
        at = F.pmod("mixed", F.col(mine)).cast("int")

        def tiles(step: Column) -> Column:
            one = lambda o: F.struct(
                (own if left else own + step).alias("left_band"), (own + step if left else own).alias("right_band"),
                (at if left else o).alias("s"), (o if left else at).alias("t"), F.lit(left).alias("left"),
            )
            return F.transform(F.sequence(F.lit(0), F.col(others) - 1), one)

        return F.flatten(F.transform(steps, tiles))

    spread = cuts.select(
        "token", "row", "n_shingles", "bits", "component", "rest", F.inline(F.when(F.col("rest"), F.concat(side(True), side(False))).otherwise(side(False)))
    )

    def compare(table: pa.Table) -> pa.Table:
        rows, n, component = (table.column(c).to_numpy() for c in ("row", "n_shingles", "component"))
        left, rest = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "rest"))
        bits = table.column("bits").to_numpy(zero_copy_only=False)
        widths = np.array([len(x) for x in bits])
        wide = {w: np.flatnonzero((widths == w) & ~left) for w in np.unique(widths)}
        table_of = {w: np.stack([bits[i] for i in at]) for w, at in wide.items() if len(at)}
        a, b = [], []
        for i in np.flatnonzero(left):
            fit = (component != component[i]) & (100 * np.minimum(n, n[i]) >= LEAST * np.maximum(n, n[i])) & (~rest | (rows > rows[i]))
            for w in table_of:
                chosen = fit[wide[w]]
                j = wide[w][chosen]
                if len(j):
                    size = min(w, widths[i])
                    apart = _folded(table_of[w][chosen], size) ^ _folded(bits[i], size)
                    j = j[_may_link(n[j], n[i], np.bitwise_count(apart.view(np.uint64)).sum(axis=1).astype(np.int64))]
                    a.append(np.minimum(rows[i], rows[j]))
                    b.append(np.maximum(rows[i], rows[j]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return spread.groupBy("token", "left_band", "right_band", "s", "t").applyInArrow(compare, "a long, b long").distinct()


def small_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of rows of one token, of (token, row, at, n), that may link.

    ``at`` is the place of the token in the row's order. Where the first token that two sets have in common stands at these
    places, what follows bounds what they share.
    """
    left = members.select("token", F.col("row").alias("a"), F.col("at").alias("pa"), F.col("n").alias("na"))
    right = members.select("token", F.col("row").alias("b"), F.col("at").alias("pb"), F.col("n").alias("nb"))
    follows = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = (100 + LEAST) * follows >= LEAST * (F.col("na") + F.col("nb"))
    met = left.join(right, "token").where((F.col("a") < F.col("b")) & _sizes_fit(F.col("na"), F.col("nb")) & enough)
    return met.select("a", "b").distinct()


def _components(edges: DataFrame) -> DataFrame:
    """(row, component) of the rows that take part in an edge (a, b)."""
    named = edges.select(F.lit(0).alias("workspace_id"), F.col("a").alias("src_id"), F.col("b").alias("dst_id"))
    found = connected_components(named)
    return cut(found.select(F.col("content_item_id").alias("row"), F.col("group_id").alias("component")))


def near_duplicates(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) of every row of ``docs`` (doc_id, text).

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set holds the distinct runs of five words,
    compared by 64-bit hashes. Two rows link when their sets share at least 80 % of their union; component_id is the smallest
    doc_id that links reach; ``component`` numbers components, also where a doc_id that several rows bear names two of them.

    Rows of equal sets are handled as one. A set is dealt out by its rarest shingles, so only near copies and chance meet. The
    few rows of a rare shingle are compared with each other. Those of a frequent one are first compared with the one that holds
    the fewest rare shingles, which joins a group of near copies in as many comparisons as it has rows; only rows that are then
    in different components are compared with each other, tile by tile. No link that could join two components is left out,
    and rows of one component need no more of them.

    Null, empty and blank texts have an empty set and link with nothing: component_id is their own doc_id. A null doc_id is
    never the smallest; a component of such rows alone has a null id. Repeated rows are rows of equal sets. An empty table
    gives an empty one; columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    profile = profiles(docs, frequent_shingles(docs, frequent))
    filled = profile.where(F.col("n_shingles") > 0)
    classes = cut(filled.groupBy("set_key").agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id")))
    chosen = cut(filled.select("row", "n_shingles", "rare", "prefix").join(classes.select("row"), "row", "left_semi"))
    tokens = chosen.select("row", F.col("n_shingles").alias("n"), "rare", F.posexplode("prefix").alias("at", "token"))
    central = F.min(F.struct("rare", "row"))["row"].alias("hub")
    groups = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1))
    members = cut(tokens.join(groups, "token"))
    small = small_pairs(members.where(F.col("rows") <= SMALL).drop("rows", "rare"))
    large = members.where(F.col("rows") > SMALL).select("token", "row", "rare")
    stars = large.join(large.groupBy("token").agg(central), "token").where(F.col("row") != F.col("hub")).select(F.least("hub", "row").alias("a"), F.greatest("hub", "row").alias("b"))
    first = cut(bounded(small.unionByName(stars.distinct()).distinct(), profile))
    edges = cut(linked(first, docs, profile))
    components = _components(edges)

    named = large.select("token", "row").join(components, "row", "left").withColumn("component", F.coalesce("component", "row"))
    open_tokens = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where(F.col("x") != F.col("y"))
    rest, seen = cut_and_measure(named.join(open_tokens.select("token"), "token", "left_semi"), rows=F.count(F.lit(1)))
    if seen["rows"]:
        dressed = rest.join(profile.select("row", "n_shingles", "bits"), "row")
        more, seen = cut_and_measure(tile_pairs(dressed).join(first, ["a", "b"], "left_anti"), rows=F.count(F.lit(1)))
        if seen["rows"]:
            components = _components(edges.unionByName(linked(more, docs, profile)))

    whole = classes.join(components, "row", "left").withColumn("component", F.coalesce("component", "row"))
    smallest = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = whole.select("set_key", "component").join(smallest, "component")
    result = profile.select("doc_id", "text_key", "n_shingles", "set_key").join(by_set, "set_key", "left")
    return result.select("doc_id", "text_key", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


# The DuckDB twin over ``documents``, for distinct ids: all pairs that share a shingle, and their closure.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(id, seen) AS (SELECT DISTINCT a, a FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.seen = l.a),
component AS (SELECT id, min(seen) AS root FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component ON id = d.doc_id"""
