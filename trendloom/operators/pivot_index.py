"""A stored index of vectors: a two-level tree of pivots whose cells are folders on shared storage.

An index of n vectors has about n^(1/4) upper pivots and as many lower ones under each, so about the square root of n cells
with about the square root of n vectors. A vector lies in the cell of its nearest upper pivot and, under that, of its nearest
lower one. A cell knows how near and how far its vectors are from both pivots. A lookup visits a cell only if a vector within
the threshold can lie there: by these distances (triangle inequality) and by the plane between two pivots. Both tests are
exact, so nothing is lost, and only the folders of visited cells are read.

Vectors are added batch by batch; a batch writes ``cell=/batch=`` folders of its own and overwrites them when it is repeated.
Once an index holds four times what it was built for it is built anew beside the old one, so the work per vector stays
the same however long it grows.

    root/generation=g/pivots   cell, upper, vector     (at most MOST x MOST rows)
    root/generation=g/cells    batch: workspace_id, cell, n, least and largest distances
    root/generation=g/vectors  cell, batch: the vectors with their columns
    root/ready                 one row for every finished generation
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.functions.batches import plain
from trendloom.operators.ranking import top_per_key
from trendloom.operators.similarity import BLOCK_ROWS, ROUNDING, _check, _unit, best_of_block
from trendloom.session import cut, path_exists

MOST = 181  # pivots of a level: 181 x 181 cells at most, reached at about 10^9 vectors; the pivots are all that the driver holds
REBUILD = 4
MARGIN = 1e-6
VISIT_ROWS = 2000
READY = "generation INT, built_for BIGINT"
CELLS = "workspace_id STRING, cell INT, n BIGINT, low DOUBLE, high DOUBLE, upper_low DOUBLE, upper_high DOUBLE, batch STRING"
FIELDS = "workspace_id STRING, content_item_id BIGINT, vector ARRAY<FLOAT>"


@dataclass
class Tree:
    """Pivots as unit vectors, lower ones by upper one, and the cell number of each lower pivot."""

    upper: np.ndarray
    lower: list[np.ndarray]
    cells: list[np.ndarray]
    rings: dict[int, tuple[float, ...]] = field(default_factory=dict)  # by cell: low, high, upper_low, upper_high

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, and its distance to the lower and to the upper pivot."""
        near = _distances(vectors, self.upper)
        home = near.argmin(1)
        cell, far = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for u in np.unique(home):
            at = np.flatnonzero(home == u)
            below = _distances(vectors[at], self.lower[u])
            cell[at], far[at] = self.cells[u][below.argmin(1)], below.min(1)
        return cell, far, near[np.arange(len(vectors)), home]

    def visits(self, vectors: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell in which a vector within ``reach`` of the row can lie."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        near = _distances(vectors, self.upper)
        over = _across(near, self.upper) <= reach + MARGIN
        for u, cells in enumerate(self.cells):
            known = np.array([i for i, c in enumerate(cells) if int(c) in self.rings], np.int64)
            at = np.flatnonzero(over[:, u])
            if not len(known) or not len(at):
                continue
            low, high, upper_low, upper_high = np.array([self.rings[int(c)] for c in cells[known]]).T
            below = _distances(vectors[at], self.lower[u])
            beyond = _across(below, self.lower[u])[:, known]
            below, above = below[:, known], near[at, u][:, None]
            able = (below - reach <= high + MARGIN) & (below + reach >= low - MARGIN) & (beyond <= reach + MARGIN)
            able &= (above - reach <= upper_high + MARGIN) & (above + reach >= upper_low - MARGIN)
            i, j = np.nonzero(able)
            rows.append(at[i])
            found.append(cells[known[j]])
        return np.concatenate(rows), np.concatenate(found)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _across(near: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """How far each row is, at least, from the vectors whose nearest pivot is each one: beyond the plane to the row's own."""
    home = near.argmin(1)
    gap = _distances(pivots, pivots)[home]
    own = near[np.arange(len(near)), home][:, None]
    return np.where(gap > MARGIN, (near * near - own * own) / (2 * np.maximum(gap, MARGIN)), 0.0)


def _first_by_hash(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("vector"), "vector")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _tree(vectors: DataFrame, n: int) -> Tree:
    """Pivots drawn from the vectors by the hash of their values, so that equal vectors give one."""
    most = int(min(MOST, max(1, round(n**0.25))))
    some = vectors.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(most)
    upper = _unit(pd.Series([r["vector"] for r in some.collect()]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                yield plain(frame.assign(upper=_distances(_unit(frame["vector"]), upper).argmin(1).astype("int32"))[["upper", "vector"]])

    dealt = vectors.select("vector").mapInPandas(place, "upper INT, vector ARRAY<FLOAT>").distinct()
    lower = [[] for _ in upper]
    for row in _first_by_hash(dealt, ["upper"], most).orderBy("upper", F.xxhash64("vector"), "vector").collect():  # most x most rows
        lower[row["upper"]].append(row["vector"])
    kept = [u for u, rows in enumerate(lower) if rows]
    counts = np.cumsum([0, *[len(lower[u]) for u in kept]])
    cells = [np.arange(a, b, dtype=np.int32) for a, b in zip(counts[:-1], counts[1:], strict=True)]
    return Tree(upper[kept], [_unit(pd.Series(lower[u])) for u in kept], cells)


def _generation(spark: SparkSession, root: str) -> tuple[int, int] | None:
    """Newest finished generation, and how many vectors it was built for."""
    if not path_exists(spark, f"{root}/ready"):
        return None
    row = spark.read.schema(READY).json(f"{root}/ready").orderBy(F.desc("generation")).first()
    return (row["generation"], row["built_for"]) if row else None


def _folder(root: str, generation: int) -> str:
    return f"{root}/generation={generation}"


def _write_tree(spark: SparkSession, tree: Tree, folder: str) -> None:
    rows = [(int(c), u, [float(x) for x in tree.upper[u]], [float(x) for x in v])
            for u, (cells, lower) in enumerate(zip(tree.cells, tree.lower, strict=True)) for c, v in zip(cells, lower, strict=True)]
    schema = "cell INT, upper INT, upper_vector ARRAY<DOUBLE>, vector ARRAY<DOUBLE>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/pivots")


def _cell_rows(spark: SparkSession, folder: str, but: str | None = None) -> DataFrame:
    """Counts and rings by workspace, cell and batch; without those of batch ``but``."""
    if not path_exists(spark, f"{folder}/cells"):
        return spark.createDataFrame([], CELLS)
    rows = spark.read.schema(CELLS).parquet(f"{folder}/cells")
    return rows if but is None else rows.where(F.col("batch") != but)


def _read_tree(spark: SparkSession, folder: str, but: str | None = None) -> Tree:
    by_upper: dict[int, list] = {}
    for row in spark.read.parquet(f"{folder}/pivots").orderBy("upper", "cell").collect():
        by_upper.setdefault(row["upper"], []).append(row)
    upper = np.array([rows[0]["upper_vector"] for rows in by_upper.values()])
    lower = [np.array([r["vector"] for r in rows]) for rows in by_upper.values()]
    tree = Tree(upper, lower, [np.array([r["cell"] for r in rows], np.int32) for rows in by_upper.values()])
    rings = _cell_rows(spark, folder, but).groupBy("cell").agg(F.min("low"), F.max("high"), F.min("upper_low"), F.max("upper_high"))
    tree.rings = {r[0]: tuple(r)[1:] for r in rings.collect()}  # one row a cell
    return tree


def _add(vectors: DataFrame, tree: Tree, folder: str, batch: str) -> None:
    spark = vectors.sparkSession
    shape = StructType([*vectors.schema.fields, *StructType.fromDDL("cell INT, low DOUBLE, upper_low DOUBLE").fields])
    bare = Tree(tree.upper, tree.lower, tree.cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                cell, far, above = bare.place(_unit(frame["vector"]))
                yield plain(frame.assign(cell=cell, low=far, upper_low=above))

    placed = cut(vectors.mapInPandas(place, shape))
    # a cell is dealt to as many tasks as its rows call for; a batch has its own folder in each of its cells
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (50 * BLOCK_ROWS)).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("content_item_id"), F.col("parts")))
    rows = dealt.repartition("cell", "part").drop("part", "parts", "low", "upper_low").withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell", "batch").parquet(f"{folder}/vectors")
    seen = placed.groupBy("workspace_id", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("low").alias("high"),
        F.min("upper_low").alias("upper_low"), F.max("upper_low").alias("upper_high"),
    ).withColumn("batch", F.lit(batch))
    seen.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/cells")


def _build(vectors: DataFrame, root: str, generation: int, batch: str, built_for: int | None = None) -> None:
    spark, folder = vectors.sparkSession, _folder(root, generation)
    n = vectors.count()
    tree = _tree(vectors, max(n, built_for or 0))
    _write_tree(spark, tree, folder)
    _add(vectors, tree, folder, batch)
    spark.createDataFrame([(generation, max(n, built_for or 0))], READY).coalesce(1).write.mode("append").json(f"{root}/ready")


def extend_index(vectors: DataFrame, root: str, batch: str = "0", columns: list[str] | None = None) -> None:
    """Adds vectors (workspace_id, content_item_id, vector and ``columns``) to the index at ``root``, which is built if there is none.

    Null vectors are left out. A batch that is repeated, with the same name, replaces what it wrote before.
    """
    spark = vectors.sparkSession
    own = ["workspace_id", "content_item_id", "vector", *(columns or [])]
    vectors = cut(vectors.where(F.col("vector").isNotNull()).select(*own))
    now = _generation(spark, root)
    if now is None:
        if not vectors.isEmpty():
            _build(vectors, root, 0, batch)
        return
    generation, built_for = now
    folder = _folder(root, generation)
    _add(vectors, _read_tree(spark, folder), folder, batch)
    n = _cell_rows(spark, folder).agg(F.sum("n")).first()[0] or 0
    if n > REBUILD * max(built_for, 1):
        everything = read_index(spark, root)
        _build_from(everything, root, generation + 1, n)


def _build_from(stored: DataFrame, root: str, generation: int, n: int) -> None:
    """A new generation that keeps the batches of the old one."""
    spark, folder = stored.sparkSession, _folder(root, generation)
    tree = _tree(stored, n)
    _write_tree(spark, tree, folder)
    for (batch,) in stored.select("batch").distinct().collect():
        _add(stored.where(F.col("batch") == batch).drop("cell", "batch"), tree, folder, batch)
    spark.createDataFrame([(generation, n)], READY).coalesce(1).write.mode("append").json(f"{root}/ready")


def read_index(spark: SparkSession, root: str, cells: list[int] | None = None, but: str | None = None) -> DataFrame | None:
    """Stored vectors with ``cell`` and ``batch``: all, or of the given cells, whose folders alone are listed and read."""
    now = _generation(spark, root)
    if now is None:
        return None
    folder = f"{_folder(root, now[0])}/vectors"
    reader = spark.read.option("basePath", folder)
    if cells is None:
        rows = reader.parquet(folder)
    elif cells:
        rows = reader.parquet(*[f"{folder}/cell={c}" for c in cells]).where(F.col("cell").isin(cells))
    else:
        return None
    rows = rows.withColumn("batch", F.col("batch").cast("string"))
    return rows if but is None else rows.where(F.col("batch") != but)


def _by_cell(frame: pd.DataFrame, row: np.ndarray, cell: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows with the cells they visit, a bounded number at a time: a query may visit every cell, each with a copy of its vector."""
    for at in range(0, len(row), VISIT_ROWS):
        some = slice(at, at + VISIT_ROWS)
        yield plain(frame.iloc[row[some]].assign(cell=cell[some].astype("int32")))


def find_stored(
    queries: DataFrame, root: str, threshold: float, k: int | None = None, columns: list[str] | None = None,
    block_rows: int = BLOCK_ROWS, but: str | None = None,
) -> DataFrame | None:
    """Stored items similar to each query of the same workspace, best first.

    ``queries`` has (workspace_id, query_id, vector). Gives (workspace_id, src_id = query, dst_id = item, score, ``columns`` of
    the item), and the rank with ``k``; all items are found, copies too. None if there is no index yet. What batch ``but`` wrote
    is not looked at. Work is cut into blocks of at most ``block_rows`` queries and stored vectors of one cell.
    """
    _check(threshold)
    spark, columns = queries.sparkSession, columns or []
    now = _generation(spark, root)
    if now is None:
        return None
    folder = _folder(root, now[0])
    tree = _read_tree(spark, folder, but)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + ROUNDING

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                row, cell = tree.visits(_unit(frame["vector"]), reach)
                yield from _by_cell(frame, row, cell)

    asked = queries.where(F.col("vector").isNotNull()).select("workspace_id", F.col("query_id").alias("content_item_id"), "vector")
    asked = cut(asked.mapInPandas(visit, f"{FIELDS}, cell INT"))
    cells = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # at most MOST x MOST numbers
    stored = read_index(spark, root, cells, but)
    shape = "workspace_id STRING, src_id BIGINT, dst_id BIGINT, score DOUBLE"
    if stored is None:
        empty = spark.createDataFrame([], shape + "".join(f", {c} BIGINT" for c in columns))
        return empty.withColumn("rank", F.lit(0)) if k else empty
    kinds = dict(stored.dtypes)
    shape += "".join(f", {c} {kinds[c]}" for c in columns)
    key = ["workspace_id", "cell"]
    rows = _cell_rows(spark, folder, but).groupBy(*key).agg(F.ceil(F.sum("n") / block_rows).cast("int").alias("right_slices"))
    sizes = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("left_slices")).join(rows, key)
    left = _sliced(asked.select(*FIELDS_OF, "cell", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns]), sizes, "left", "right")
    right = _sliced(stored.select(*FIELDS_OF, "cell", *columns), sizes, "right", "left")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["side"] == "left"], frame[frame["side"] == "right"]
        if a.empty or b.empty:
            return pd.DataFrame()
        cos = _unit(a["vector"]) @ _unit(b["vector"]).T
        i, j = np.nonzero(cos >= threshold)
        if not len(i):
            return pd.DataFrame()
        if k is not None:
            best = best_of_block(i, b["content_item_id"].to_numpy()[j], 1 + cos[i, j], k)
            i, j = i[best], j[best]
        found = {"workspace_id": key[0], "src_id": a["content_item_id"].to_numpy()[i], "dst_id": b["content_item_id"].to_numpy()[j], "score": 1 + cos[i, j]}
        return plain(pd.DataFrame(found | {c: b[c].to_numpy()[j] for c in columns}))

    found = left.unionByName(right).groupBy(*key, "left_slice", "right_slice").applyInPandas(compare, shape)
    if k is None:
        return found
    return top_per_key(found, ["workspace_id", "src_id"], [F.desc("score"), F.asc("dst_id")], k)


FIELDS_OF = ["workspace_id", "content_item_id", "vector"]


def _sliced(rows: DataFrame, sizes: DataFrame, side: str, other: str) -> DataFrame:
    """Rows with the slice that holds them, once for every slice of the other side."""
    joined = rows.join(sizes, ["workspace_id", "cell"])
    own: Column = F.pmod(F.xxhash64("content_item_id"), F.col(f"{side}_slices")).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.col(f"{other}_slices") - 1))
    dealt = joined.select(*rows.columns, own.alias(f"{side}_slice"), meets.alias(f"{other}_slice"))
    return dealt.withColumn("side", F.lit(side))
