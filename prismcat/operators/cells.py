"""A tree of cells over a store of vectors, for exact search that leaves most of the store out.

A cell is a set of vectors around one of its members, its representative, with the largest angle any of them has to
it. By the triangle inequality for angles no member is closer to a query than ``angle(query, representative) - radius``,
so a cell is skipped by every query that needs more than that, and with it all cells below.

The tree grows level by level with the number of vectors: every cell above the leaf size is split around some of its
own members, chosen far apart, until a leaf holds about ``leaf_rows``. The work of a level is one shuffle of
the vectors by cell, crowded cells in several pieces. Leaves are stored as blocks in tree order, each with the balls of
the cells above it, so a search reads them where they lie and needs no table of the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismcat.operators import blocks as B
from prismcat.session import materialise

# Vectors of a leaf block (512 vectors of 1024 floats are 2 MB).
LEAF_ROWS = 512
# A cell is split into at most so many, around members out of a sample of four times as many.
_BITS = 5
FANOUT = 1 << _BITS
# Vectors of one cell that a task assigns to the cells below it.
_PIECE_ROWS = 200_000
# Leaves of a file of the tree at least, as long as files are fewer than tasks.
_PART_LEAVES = 64
# Vectors of neighbouring leaves that a search multiplies together.
_FAMILY_ROWS = 1024
# Share of them from which on a query is multiplied with all.
_WIDE = 0.9
# Slack for rounding: on angles, and on similarities (which are compared at 9 decimals).
_ANGLE_SLACK, _SIM_SLACK = 1e-6, 1e-8


@dataclass
class CellTree:
    """``leaves``: (leaf, sub, balls, radii, ids, mat, dim) in tree order; ``representatives``: (id, vec), one per leaf cell."""

    leaves: DataFrame
    representatives: DataFrame
    levels: int
    id_type: str


def _spread_out(vectors: np.ndarray, wanted: int) -> list[int]:
    """At most ``wanted`` rows, always the one furthest from those already chosen."""
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < wanted and nearest.min() < 1.0 - 1e-12:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return chosen


def _centres(rows: DataFrame, sizes: DataFrame, leaf_rows: int) -> DataFrame:
    """(parent, node, id, vec, centre): the members around which every cell is split; ``sizes`` is (node, n)."""
    place = Window.partitionBy("node").orderBy(F.xxhash64("id", "node"), "id")
    sample = rows.select("node", "id", "vec").withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= 4 * FANOUT)
    sample = sample.join(sizes, "node")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_rn")
        vectors = B.unit_rows(np.stack(group["vec"].to_numpy()))
        picked = _spread_out(vectors, min(FANOUT, -(-int(group["n"].iloc[0]) // leaf_rows)))
        node = int(group["node"].iloc[0])
        return pd.DataFrame(
            {
                "parent": node, "node": node * FANOUT + np.arange(len(picked)), "id": group["id"].to_numpy()[picked],
                "vec": [vectors[i] for i in picked], "centre": [vectors[i].tobytes() for i in picked],
            }
        )

    schema = f"parent bigint, node bigint, id {B.spark_type(rows, 'id')}, vec array<double>, centre binary"
    return materialise(sample.groupBy("node").applyInPandas(choose, schema), "cell-centres")


def _with_headers(rows: DataFrame, headers: DataFrame, sizes: DataFrame, piece_rows: int) -> DataFrame:
    """Rows (key, sub, ord, id, vec, aways, m, r) in which the headers of a key stand before each piece of its vectors.

    ``rows`` is (key, id, vec, aways), ``headers`` (key, ord, m, r), ``sizes`` (key, n).
    """
    pieces = sizes.select("key", F.ceil(F.col("n") / piece_rows).cast("int").alias("pieces"))
    many = pieces.where("pieces > 1")  # usually few; the others have one piece
    dealt = rows.join(many, "key", "left").select(
        "key", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("sub"), F.lit(1 << 30).alias("ord"), "id", "vec", "aways",
        F.lit(None).cast("binary").alias("m"), F.lit(None).cast("double").alias("r"),
    )
    heads = headers.join(pieces, "key").select("key", F.explode(F.expr("sequence(0, pieces - 1)")).alias("sub"), "ord", "m", "r")
    return dealt.unionByName(heads, allowMissingColumns=True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    """((key, sub), rows) pieces of a sorted stream; a piece may come in several parts."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        starts = B.row_starts(table, ["key", "sub"])
        for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
            yield (table.column("key")[int(a)].as_py(), table.column("sub")[int(a)].as_py()), table.slice(a, b - a)


def _split_headers(part: pa.Table) -> tuple[pa.Table, pa.Table]:
    head = int((part.column("ord").to_numpy() < 1 << 30).sum())
    return part.slice(0, head), part.slice(head)


def _assign(rows: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` one level further down: each vector in the cell of its nearest centre, with the angle to it."""
    keyed = rows.withColumnRenamed("node", "key")
    heads = centres.select(F.col("parent").alias("key"), (F.col("node") % FANOUT).cast("int").alias("ord"), F.col("centre").alias("m"), F.lit(None).cast("double").alias("r"))
    stream = _with_headers(keyed, heads, sizes.withColumnRenamed("node", "key"), _PIECE_ROWS)
    stream = stream.repartition("key", "sub").sortWithinPartitions("key", "sub", "ord")
    schema = f"node bigint, id {B.spark_type(rows, 'id')}, vec {B.spark_type(rows, 'vec')}, aways array<double>"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, axes = None, []
        for key, part in _runs(batches):
            if key != current:
                current, axes = key, []
            heads, members = _split_headers(part)
            axes += [np.frombuffer(m) for m in heads.column("m").to_pylist()]
            if not members.num_rows:
                continue
            grid = np.stack(axes)
            vectors = B.unit_rows(B.vector_array(members.column("vec")))
            cell, best = np.empty(len(vectors), np.int64), np.empty(len(vectors))
            for strip in B.strips(len(vectors), len(grid)):
                sims = vectors[strip] @ grid.T
                cell[strip], best[strip] = sims.argmax(axis=1), sims.max(axis=1)
            away = np.arccos(np.clip(best, -1.0, 1.0))
            aways = [[*before, a] for before, a in zip(members.column("aways").to_pylist(), away.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[0] * FANOUT + cell), members.column("id").combine_chunks(), members.column("vec").combine_chunks(), pa.array(aways, pa.list_(pa.float64()))],
                names=["node", "id", "vec", "aways"],
            )

    return materialise(stream.mapInArrow(assign, schema), "cell-rows")


def _pack(rows: DataFrame, leaf_rows: int, centres: list[DataFrame], sizes: DataFrame, parts: int) -> DataFrame:
    """Leaf blocks in tree order, in ``parts`` files, each block with the balls of the cells it lies in."""
    levels = len(centres)
    balls = None
    for level, table in enumerate(centres):
        cell = F.shiftright(F.col("node"), (levels - 1 - level) * _BITS)
        radii = rows.groupBy(cell.alias("node")).agg(F.max(F.col("aways")[level]).alias("r"))
        level_balls = table.join(radii, "node").select(F.lit(level).alias("ord"), "node", F.col("centre").alias("m"), "r")
        balls = level_balls if balls is None else balls.unionByName(level_balls)
    sizes = materialise(sizes.withColumnRenamed("node", "key"), "leaf-sizes")
    above = f"explode(transform(sequence(0, {levels - 1}), i -> struct(i AS ord, shiftright(key, ({levels - 1} - i) * {_BITS}) AS node)))"
    heads = sizes.select("key", F.expr(above).alias("a")).select("key", "a.*").join(balls, ["ord", "node"]).select("key", "ord", "m", "r")
    stream = _with_headers(rows.withColumnRenamed("node", "key"), heads, sizes, leaf_rows)
    stream = stream.repartitionByRange(parts, "key", "sub").sortWithinPartitions("key", "sub", "ord", "id")
    id_type = B.spark_type(rows, "id")
    schema = f"leaf bigint, sub int, balls binary, radii binary, ids array<{id_type}>, mat binary, dim int"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(key: tuple[int, int] | None, parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            heads, members = _split_headers(pa.concat_tables(parts)) if parts else (None, pa.table({}))
            if not members.num_rows:  # nothing read yet, or a piece that no id was dealt to
                return
            vectors = np.ascontiguousarray(B.vector_array(members.column("vec")))
            ids = members.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([b"".join(heads.column("m").to_pylist())], pa.binary()),
                    pa.array([heads.column("r").to_numpy().astype(np.float64).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([vectors.tobytes()], pa.binary()), pa.array([vectors.shape[1]], pa.int32()),
                ],
                names=["leaf", "sub", "balls", "radii", "ids", "mat", "dim"],
            )

        current, parts = None, []
        for key, part in _runs(batches):
            if key != current:
                yield from block(current, parts)
                current, parts = key, []
            parts.append(part)
        yield from block(current, parts)

    return materialise(stream.mapInArrow(pack, schema), "cell-leaves")


def build_tree(stored: DataFrame, leaf_rows: int = LEAF_ROWS) -> CellTree:
    """The cell tree of (id, vec). Ids are unique; NULL vectors and those with NaN or infinite elements are left out."""
    usable = F.col("vec").isNotNull() & F.forall("vec", lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = materialise(
        stored.where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False))).select(
            F.lit(0).cast("bigint").alias("node"), "id", "vec", F.array().cast("array<double>").alias("aways")
        ), "cell-rows",
    )
    id_type = B.spark_type(rows, "id")
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    cells, levels, centres = -(-rows.count() // leaf_rows), 1, []
    while FANOUT**levels < cells:
        levels += 1
    for _ in range(levels):
        centres.append(_centres(rows, sizes, leaf_rows))
        rows = _assign(rows, centres[-1], sizes)
        sizes = materialise(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    # a number that is stated isn't lowered by adaptive execution: a small store can still keep all cores busy for many queries
    spark = stored.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    parts = min(most, 1 + cells // _PART_LEAVES)
    return CellTree(_pack(rows, leaf_rows, centres, sizes, parts), centres[-1].select("id", "vec"), levels, id_type)


def _within(cosines: np.ndarray, needed: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Which balls (columns) can hold a vector as similar as each query (row) needs; ``cosines`` are those to the centres.

    That is ``angle <= arccos(needed) + radius``, compared by its cosine so that no angle is worked out for each pair.
    """
    wanted, radii = np.arccos(np.clip(needed - _SIM_SLACK, -1.0, 1.0))[:, None], radii + _ANGLE_SLACK
    least = np.cos(wanted) * np.cos(radii) - np.sin(wanted) * np.sin(radii)
    return (cosines >= least) | (wanted + radii >= np.pi)


class _Reach:
    """Which queries can find something below a cell, worked out down the tree and kept for the next cells below the same ones."""

    def __init__(self, vectors: np.ndarray, levels: int):
        self.vectors, self.levels = vectors, levels
        self.path: list[int] = []
        self.alive: list[np.ndarray] = []

    def _of(self, rows: np.ndarray) -> np.ndarray:
        return self.vectors if len(rows) == len(self.vectors) else self.vectors[rows]

    def above(self, first: int, last: int, balls: np.ndarray, radii: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Rows of the queries that reach the smallest cell above both leaves, which has these balls above it; ``worst`` is what they need."""
        path = []
        for level in range(self.levels - 1):
            cells = {leaf // FANOUT ** (self.levels - 1 - level) for leaf in (first, last)}
            if len(cells) > 1:
                break
            path += cells
        same = 0
        while same < min(len(self.path), len(path)) and self.path[same] == path[same]:
            same += 1
        self.alive = self.alive[:same]
        for level in range(same, len(path)):
            rows = self.alive[-1] if self.alive else np.arange(len(self.vectors))
            cosines = (self._of(rows) @ balls[level])[:, None]
            self.alive.append(rows[_within(cosines, worst[rows], radii[level : level + 1])[:, 0]])
        self.path = path
        return self.alive[-1] if self.alive else np.arange(len(self.vectors))

    def leaves(self, rows: np.ndarray, centres: np.ndarray, radii: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """(query, leaf) marks of what each of ``rows`` can reach among leaves with these balls."""
        marks = np.empty((len(rows), len(centres)), bool)
        for part in B.strips(len(rows), len(centres)):
            marks[part] = _within(self.vectors[rows[part]] @ centres.T, worst[rows[part]], radii)
        return marks


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Neighbouring blocks with a common cell two levels above, about _FAMILY_ROWS vectors at a time."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and (size >= _FAMILY_ROWS or row["leaf"] // FANOUT**2 != held[-1]["leaf"] // FANOUT**2):
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row["ids"])
    if held:
        yield held


def scan_tree(tree: CellTree, held, floors: np.ndarray, new_best: Callable, floor: float, schema: str, count_tiles: bool = False) -> DataFrame:
    """Hits of a delivery's queries, a task's leaves where they lie; or (leaf, sub, queries) for each block, what is multiplied.

    ``floors`` are similarities that each query's k-th hit reaches; ``new_best`` makes the collector of hits. Neighbouring leaves
    are taken together: one product with their centres tells who reaches which. Queries that reach most of their vectors are
    multiplied with all of them at once, which costs less than a product for each leaf.
    """
    limits = tree.leaves.sparkSession.sparkContext.broadcast(floors)
    names = [part.split(" ")[0] for part in schema.split(", ")]
    levels = tree.levels

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = new_best(*held.value, limits.value)
        reach = _Reach(best.vectors, levels)
        for family in _families(batches):
            worst = best.worst()
            balls, radii = (np.stack([np.frombuffer(row[c]).reshape(levels, -1) for row in family]) for c in ("balls", "radii"))
            leaves = [row["leaf"] for row in family]
            rows = reach.above(min(leaves), max(leaves), balls[0], radii[0, :, 0], worst)
            marks = reach.leaves(rows, balls[:, -1], radii[:, -1, 0], worst)
            sizes = np.array([len(row["ids"]) for row in family])
            wide = marks @ sizes >= _WIDE * sizes.sum()
            parts = [(family, wide)] + [([row], marks[:, i] & ~wide) for i, row in enumerate(family)]
            for taken, asked in parts:
                if asked.any():
                    near = [B.id_array(row["ids"]) for row in taken]
                    best.add(np.concatenate(near), np.concatenate([B.matrix(row["mat"], len(i), row["dim"]) for row, i in zip(taken, near, strict=True)]), rows[asked])
            if count_tiles:
                columns = leaves, [row["sub"] for row in family], (marks | wide[:, None]).sum(axis=0).tolist()
                yield pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)), _tile_schema(names))
        if not count_tiles and (found := best.batch(floor, names)) is not None:
            yield found

    tasks = 4 * tree.leaves.sparkSession.sparkContext.defaultParallelism
    return tree.leaves.coalesce(tasks).mapInArrow(scan, schema)


def _tile_schema(names: list[str]) -> pa.Schema:
    return pa.schema(list(zip(names, (pa.int64(), pa.int32(), pa.int64()), strict=True)))
