"""Block products: many vectors per row, so that one numpy product replaces many vector joins.

Rows are packed into blocks of bounded size, pairs of blocks (tiles) are spread by an ordinary
equi-join on the tile number, and each task multiplies one tile at a time, strip by strip. A tile
only ever emits summaries (top-k, sums, histograms); the pairs themselves are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prismcat.session import materialise

# Rows per block: 16384 float vectors of 1024 dimensions are 64 MB. Bigger blocks mean fewer copies
# in the tile shuffle (each block is sent once per block of the other side).
BLOCK_ROWS = 16384
# Blocks of a group are put together into so many panels at most before they are paired, so that a vector is sent
# so many times however many blocks there are; a panel above PANEL_BYTES is cut again, as two of them lie in a task.
MAX_PANELS = 24
PANEL_BYTES = 64 << 20
# Elements of a similarity strip held at once (8 bytes each).
STRIP_ELEMENTS = 1_000_000


def row_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new combination of key values starts."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        values = table.column(k).to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0)
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def vector_array(column: pa.ChunkedArray) -> np.ndarray:
    """List column to a rows x dimension matrix without copying more than once.

    Vectors of different lengths are an error: they can't be compared.
    """
    lengths = pc.min_max(pc.list_value_length(column))
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} and of {lengths['max']} elements in one column")
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks_of(table: pa.Table, keys: list[str], starts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    vectors = np.ascontiguousarray(vector_array(table.column("vec")))
    ends = np.append(starts[1:], table.num_rows)
    ids = table.column("id").combine_chunks()
    columns = [table.column(k).combine_chunks().take(pa.array(starts)) for k in keys]
    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, table.num_rows), pa.int32()), ids))
    columns.append(pa.array([vectors[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()))
    columns.append(pa.array(np.full(len(starts), vectors.shape[1]), pa.int32()))
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def pack_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key combination: (keys, ids, mat, dim), ``mat`` being the raw vector bytes.

    Rows are shuffled and sorted by key and id once; the blocks are then cut from the sorted stream.
    """
    types = ", ".join(f"{k} {spark_type(rows, k)}" for k in keys)
    out_schema = f"{types}, ids array<{spark_type(rows, 'id')}>, mat binary, dim int"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if schema is None:
                fields = [table.schema.field(k) for k in keys]
                id_type = pa.list_(table.schema.field("id").type)
                schema = pa.schema([*fields, pa.field("ids", id_type), pa.field("mat", pa.binary()), pa.field("dim", pa.int32())])
            table = table if held is None else pa.concat_tables([held, table])
            starts = row_starts(table, keys)
            if len(starts) > 1:
                yield _blocks_of(table.slice(0, starts[-1]), keys, starts[:-1], schema)
            held = table.slice(starts[-1])
        if held is not None:
            yield _blocks_of(held, keys, np.array([0]), schema)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, "id", "vec")
    return ordered.mapInArrow(pack, out_schema)


def pack_blocks(df: DataFrame, id_col: str, vec_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Whole table to blocks: (b, nb, ids, mat, dim). Ids are unique, so hashing them balances the blocks."""
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    blocks = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(1))).scalar()
    numbered = rows.withColumn("nb", blocks.cast("int")).withColumn(
        "b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    )
    return pack_rows(numbered, ["b", "nb"])


def pack_group_blocks(
    df: DataFrame, group_col: str, id_col: str, vec_col: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Blocks per group: (g, b, nb, ids, mat, dim). A small group is one block, a hot group is many."""
    rows = df.where(F.col(group_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(group_col).alias("g"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec")
    )
    # only groups above one block are looked up, so the table joined here is usually tiny or empty; written, its size is known
    large = materialise(
        rows.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
        .select("g", F.ceil(F.col("_n") / block_rows).cast("int").alias("nb")), "large-groups",
    )
    spread = rows.join(large, "g", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    spread = spread.withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    return pack_rows(spread, ["g", "b", "nb"])


def self_tiles(blocks: DataFrame) -> DataFrame:
    """All tiles of unordered pairs within a group: (g, a_ids, a_mat, b_ids, b_mat, dim).

    ``b_mat`` is empty for a block paired with itself; those tiles need no join, so only groups of
    more than one block are shuffled again, keyed by tile and therefore spread evenly. Many small blocks are put
    together into panels first: what is sent grows with the vectors, not with the number of pairs of blocks.
    """
    seen = Observation()
    # read once per branch below and once per pass of the caller
    blocks = materialise(blocks.observe(seen, F.max("nb").alias("nb"), F.max(F.length("mat")).alias("bytes")), "blocks")
    if "g" not in blocks.columns:
        blocks = blocks.withColumn("g", F.lit(0))
    most = seen.get["nb"] or 1
    diag = _own_tiles(blocks if most == 1 else blocks.where("nb = 1"))
    if most == 1:
        return diag
    split = blocks.where("nb > 1")
    each = min(-(-most // MAX_PANELS), max(1, PANEL_BYTES // max(seen.get["bytes"], 1)))
    if each > 1:
        split = _panels(split, each)
    lower = split.where("b < nb - 1").select(
        "g", F.col("b").alias("ta"), F.explode(F.expr("sequence(b + 1, nb - 1)")).alias("tb"),
        F.col("ids").alias("a_ids"), F.col("mat").alias("a_mat"),
    )
    upper = split.where("b > 0").select(
        "g", F.explode(F.expr("sequence(0, b - 1)")).alias("ta"), F.col("b").alias("tb"),
        F.col("ids").alias("b_ids"), F.col("mat").alias("b_mat"), "dim",
    )
    off = lower.join(upper, ["g", "ta", "tb"]).select("g", "a_ids", "a_mat", "b_ids", "b_mat", "dim")
    return diag.unionByName(_own_tiles(split)).unionByName(off)


def _own_tiles(blocks: DataFrame) -> DataFrame:
    """Each block paired with itself."""
    return blocks.select(
        "g", F.col("ids").alias("a_ids"), F.col("mat").alias("a_mat"), F.slice("ids", 1, 0).alias("b_ids"),
        F.lit(b"").alias("b_mat"), "dim",
    )


def _panels(blocks: DataFrame, each: int) -> DataFrame:
    """Larger blocks (g, b, nb, ids, mat, dim) of ``each`` neighbouring ones; the vectors are shuffled once."""
    numbered = blocks.select(
        "g", F.floor(F.col("b") / each).cast("int").alias("panel"), F.ceil(F.col("nb") / each).cast("int").alias("nb"), "b", "ids", "mat", "dim"
    )
    schema = f"g {spark_type(blocks, 'g')}, b int, nb int, ids {spark_type(blocks, 'ids')}, mat binary, dim int"

    def together(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("b")
        dims = parts.column("dim").unique().to_pylist()
        if len(dims) > 1:
            raise ValueError(f"vectors of {min(dims)} and of {max(dims)} elements in one column")
        ids = parts.column("ids").combine_chunks().flatten()
        columns = [
            parts.column("g").slice(0, 1).combine_chunks(), parts.column("panel").slice(0, 1).combine_chunks(), parts.column("nb").slice(0, 1).combine_chunks(),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(parts.column("mat").to_pylist())], pa.binary()),
            pa.array(dims, pa.int32()),
        ]
        return pa.table(columns, names=["g", "b", "nb", "ids", "mat", "dim"])

    return materialise(numbered.groupBy("g", "panel").applyInArrow(together, schema), "panels")


def id_array(values) -> np.ndarray:
    """Ids as a sortable numpy array (text ids become fixed-width text)."""
    arr = np.asarray(values)
    return arr.astype(str) if arr.dtype == object else arr


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; zero rows stay zero."""
    wide = vectors.astype(np.float64)
    return wide / np.maximum(np.sqrt(np.einsum("ij,ij->i", wide, wide)), 1e-12)[:, None]


def matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    """Unit vectors of a block; the byte count tells float from double."""
    kind = np.float32 if len(data) == rows * dim * 4 else np.float64
    return unit_rows(np.frombuffer(data, dtype=kind).reshape(rows, dim))


def strips(rows: int, columns: int, most: int | None = None) -> Iterator[slice]:
    """Row ranges whose similarity strip stays below STRIP_ELEMENTS, of ``most`` rows if given."""
    step = max(1, min(STRIP_ELEMENTS // max(columns, 1), most or rows))
    for start in range(0, rows, step):
        yield slice(start, min(start + step, rows))


def tile_strips(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Strips of a self tile: (ids a, ids b, cosines, mask of pairs to use); mask None means all."""
    ids_a = id_array(row.a_ids)
    a = matrix(row.a_mat, len(ids_a), row.dim)
    own = len(row.b_mat) == 0
    ids_b = ids_a if own else id_array(row.b_ids)
    b = a if own else matrix(row.b_mat, len(ids_b), row.dim)
    for part in strips(len(ids_a), len(ids_b)):
        cos = a[part] @ b.T
        mask = np.arange(len(ids_b))[None, :] > np.arange(part.start, part.stop)[:, None] if own else None
        yield ids_a[part], ids_b, cos, mask


def map_tiles(tiles: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(rows) -> iterator of pandas frames`` once per partition over its tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from kernel(row for batch in batches for row in batch.itertuples(index=False))

    return tiles.mapInPandas(run, schema)


def spark_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def scalar_double(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
