"""Statistics over all pairs within a group or between centroids; pairs are never materialised."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.functions.vectors import SIM_DECIMALS, dot, sum_vector, unit
from prismcat.operators import blocks as B

# Similarities are compared at SIM_DECIMALS, so a first pass over bins of this many steps leaves a second pass
# that many cells at most, however many pairs there are.
_STEPS = 4096
_STEP = 10.0**-SIM_DECIMALS
# Distances held before they are counted.
_HELD = 1 << 19


def intra_means(df: DataFrame, key: str, vec: str = "emb") -> DataFrame:
    """Number of pairs, mean cosine and mean distance per group with at least two vectors.

    Uses sum over pairs of u.v = (|sum u|^2 - sum |u|^2) / 2, so it is linear in the vectors and
    combined in the map tasks, however large one group is.
    """
    unit_vec = unit(F.col(vec))
    rows = df.where(F.col(key).isNotNull()).select(key, unit_vec.alias("_u"))
    sums = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_vectors"), sum_vector(F.col("_u")).alias("_s"),
        F.sum(dot(F.col("_u"), F.col("_u"))).alias("_own"),
    ).where(F.col("n_vectors") >= 2)
    pairs = (F.col("n_vectors") * (F.col("n_vectors") - 1) / 2).cast("bigint")
    mean_cos = (dot(F.col("_s"), F.col("_s")) - F.col("_own")) / (2 * pairs)
    return sums.select(
        key, "n_vectors", pairs.alias("n_pairs"), mean_cos.alias("mean_cos"),
        (1.0 - mean_cos).alias("mean_dist"),
    )


def d_aug(per_card: DataFrame) -> DataFrame:
    """Mean distance over all within-card pairs, 0 when there are none (one row)."""
    weighted = F.try_divide(F.sum(F.col("mean_dist") * F.col("n_pairs")), F.sum("n_pairs"))
    return per_card.agg(F.coalesce(weighted, F.lit(0.0)).alias("d_aug"))


def _pair_values(rows) -> Iterator[np.ndarray]:
    """Cosines of all pairs, strip by strip."""
    for row in rows:
        for _, _, cos, mask in B.tile_strips(row):
            yield np.round(cos.ravel() if mask is None else cos[mask], SIM_DECIMALS)


def _counted(
    tiles: DataFrame, cells: Callable[[np.ndarray], np.ndarray], width: int, between: tuple[float, float] | None = None
) -> tuple[np.ndarray, tuple[int, float, float]]:
    """One pass over the pairs: how many distances ``cells`` puts into each of ``width`` cells, and the number, sum and
    sum of squares of the cosines. ``cells`` gets distances in steps, as whole floats; what it puts below 0 doesn't count.

    With ``between`` only cosines of this closed range are looked at, and the figures are theirs.
    At most ``width`` + 1 rows reach the driver, half a million for bins over all distances.
    """

    scale = float(round(1.0 / _STEP))

    def kernel(rows) -> Iterator[pd.DataFrame]:
        counts, total, held, size = np.zeros(width, np.int64), np.zeros(3), [], 0

        def count() -> None:
            cell = cells(scale - (held[0] if len(held) == 1 else np.concatenate(held)))
            cell = cell if between is None else cell[cell >= 0]
            counts[:] += np.bincount(cell, minlength=width)

        for row in rows:
            for _, _, cos, mask in B.tile_strips(row):
                use = mask
                if between is not None:
                    use = (cos >= between[0]) & (cos <= between[1])
                    use = use if mask is None else use & mask
                v = cos.ravel() if use is None else cos[use]
                if not len(v):
                    continue
                np.rint(np.multiply(v, scale, out=v), out=v)  # cosines in steps, rounded as np.round does
                total += len(v), v.sum() / scale, (v @ v) / scale**2
                held.append(v)
                size += len(v)
                if size >= _HELD:
                    count()
                    held, size = [], 0
        if held:
            count()
        hit = np.flatnonzero(counts)
        zeros = np.zeros(len(hit))
        yield pd.DataFrame({"cell": np.append(-1, hit), "n": np.append(int(total[0]), counts[hit]), "s": np.append(total[1], zeros), "ss": np.append(total[2], zeros)})

    found = B.map_tiles(tiles, kernel, "cell bigint, n bigint, s double, ss double")
    table = found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).toArrow()
    cell, n, s, ss = (table.column(c).to_numpy() for c in ("cell", "n", "s", "ss"))
    counts = np.zeros(width, np.int64)
    counts[cell[cell >= 0]] = n[cell >= 0]
    total = cell < 0
    return counts, (int(n[total].sum()), float(s[total].sum()), float(ss[total].sum()))


def _place(counts: np.ndarray, rank: int) -> tuple[int, int]:
    """(cell, rank within it) of a 0-based rank among counted cells."""
    upto = np.cumsum(counts)
    cell = int(np.searchsorted(upto, rank, side="right"))
    return cell, rank - int(upto[cell] - counts[cell])


def _steps_at(tiles: DataFrame, bins: np.ndarray, ranks: list[int]) -> list[int]:
    """Distances in steps at 0-based ranks, by one more pass over the pairs of the bins that hold them."""
    places = [_place(bins, rank) for rank in ranks]
    chosen = np.unique([cell for cell, _ in places])
    width = 2 * _STEPS  # rounding can leave a distance a few steps below 0, so a bin gets half a bin more on either side

    def cells(distances: np.ndarray) -> np.ndarray:
        steps = distances.astype(np.int64)
        bin_of = np.clip(steps // _STEPS, 0, None)
        at = np.minimum(np.searchsorted(chosen, bin_of), len(chosen) - 1)
        return np.where(chosen[at] == bin_of, at * width + steps - bin_of * _STEPS + _STEPS // 2, -1)

    # cosines of the chosen bins, a step more on either side
    low, high = 1.0 - ((chosen[-1] + 1) * _STEPS + 1) * _STEP, np.inf if chosen[0] == 0 else 1.0 - (chosen[0] * _STEPS - 1) * _STEP
    counts, _ = _counted(tiles, cells, width * len(chosen), (low, high))
    grid = counts.reshape(-1, width)
    return [cell * _STEPS + _place(grid[np.searchsorted(chosen, cell)], inner)[0] - _STEPS // 2 for cell, inner in places]


def pair_moments(blocks: DataFrame) -> DataFrame:
    """n_pairs, s and ss (sums of the cosines and of their squares) over all pairs within a group; no pair is formed across blocks.

    The sum over pairs of (u.v)^2 is half of |M|^2 - sum |u|^4, where M is the sum of the outer products u u'. A group
    of one block is done where it lies, by its products if that is less work; of a larger group every task sends the
    rows of M. ``blocks`` are those of ``blocks.pack_blocks`` or ``pack_group_blocks``.
    """
    if "g" not in blocks.columns:
        blocks = blocks.withColumn("g", F.lit(0))
    group_type = B.spark_type(blocks, "g")

    def kernel(rows) -> Iterator[pd.DataFrame]:
        # ord -1: sums of the vectors; ord -2: a finished group's sums; from 0 on the rows of M
        done = np.zeros(3)
        held: dict = {}
        for row in rows:
            u = B.matrix(row.mat, len(row.ids), row.dim)
            own = np.einsum("ij,ij->i", u, u)
            figures = np.array([len(u), own.sum(), own @ own])
            if row.nb == 1:
                total = u.sum(0)
                products = u @ u.T if len(u) < row.dim else u.T @ u
                done += len(u) * (len(u) - 1) / 2, (total @ total - figures[1]) / 2, ((products**2).sum() - figures[2]) / 2
                continue
            before = held.get(row.g)
            new = figures, u.sum(0), u.T @ u
            held[row.g] = new if before is None else tuple(a + b for a, b in zip(before, new, strict=True))
            if len(held) > 1:  # blocks of a group usually follow each other
                yield from send(held, row.g)
        yield from send(held, None)
        yield pd.DataFrame({"g": [None], "ord": [-2], "v": [done.tolist()]})

    def send(held: dict, keep) -> Iterator[pd.DataFrame]:
        for g in [g for g in held if keep is None or g != keep]:
            figures, total, outer = held.pop(g)
            values = [figures.tolist(), total.tolist(), *outer.tolist()]
            yield pd.DataFrame({"g": [g] * len(values), "ord": [-3, -1, *range(len(outer))], "v": values})

    parts = B.map_tiles(blocks.select("g", "nb", "ids", "mat", "dim"), kernel, f"g {group_type}, ord int, v array<double>")
    summed = parts.groupBy("g", "ord").agg(sum_vector(F.col("v")).alias("v"))
    one = summed.select(
        "g", F.when(F.col("ord") == -2, F.col("v")).alias("done"), F.when(F.col("ord") == -3, F.col("v")).alias("figures"),
        F.when(F.col("ord") == -1, dot(F.col("v"), F.col("v"))).alias("total"), F.when(F.col("ord") >= 0, dot(F.col("v"), F.col("v"))).alias("outer"),
    )
    groups = one.groupBy("g").agg(F.max("done").alias("done"), F.max("figures").alias("f"), F.max("total").alias("total"), F.sum("outer").alias("outer"))
    n = F.col("f")[0]
    values = [n * (n - 1) / 2, (F.col("total") - F.col("f")[1]) / 2, (F.col("outer") - F.col("f")[2]) / 2]
    return groups.agg(*[
        F.coalesce(F.sum(F.coalesce(F.col("done")[i], F.lit(0.0)) + F.coalesce(v, F.lit(0.0))), F.lit(0.0)).alias(name)
        for i, (name, v) in enumerate(zip(("n_pairs", "s", "ss"), values, strict=True))
    ]).select(F.col("n_pairs").cast("bigint").alias("n_pairs"), "s", "ss")


def pair_summary(blocks: DataFrame, median: bool = True, approx: bool = False) -> DataFrame:
    """n_pairs, mean_cos, mean_dist, median_dist, std_dist over all pairs within the blocks' groups (one row).

    Without the median nothing but the vectors' moments is summed up. The median is exact and takes two passes over
    the pairs, whatever their number: one into bins, one over the bins it lies in. ``approx`` stops after the first
    and answers with the middle of its bin.
    """
    schema = "n_pairs bigint, mean_cos double, mean_dist double, median_dist double, std_dist double"
    spark = blocks.sparkSession
    if not median:
        moments = pair_moments(blocks).head()
        n, s, ss = moments["n_pairs"], moments["s"], moments["ss"]
    else:
        tiles = B.self_tiles(blocks)
        # a distance just below 0 goes into the first bin
        bins, (n, s, ss) = _counted(tiles, lambda distances: (distances * (1.0 / _STEPS)).astype(np.int64), int(2 / _STEP) // _STEPS + 2)
    if n == 0:
        return spark.createDataFrame([(0, None, None, None, None)], schema)
    mean = s / n
    std = max(ss / n - mean * mean, 0.0) ** 0.5
    middle = None
    if median and approx:
        middle = (_place(bins, (n - 1) // 2)[0] + 0.5) * _STEPS * _STEP
    elif median:
        middle = sum(_steps_at(tiles, bins, [(n - 1) // 2, n // 2])) / 2 * _STEP
    return spark.createDataFrame([(n, mean, 1.0 - mean, middle, std)], schema)


def separation(intra: DataFrame, inter: DataFrame) -> DataFrame:
    """Q = median inter distance / mean intra distance, and the advised thresholds (one row).

    ``intra`` is the result of ``d_aug``, ``inter`` that of ``pair_summary``.
    """
    d = intra.select("d_aug").scalar()
    m = inter.select("median_dist").scalar()
    one = intra.select(d.alias("d_aug"), m.alias("dist_med"))
    return one.select(
        "d_aug", "dist_med", F.try_divide("dist_med", "d_aug").alias("q"),
        (1.0 - 1.5 * F.col("d_aug")).alias("thr_high"), (1.0 - F.col("dist_med")).alias("thr_low"),
    )


def cosine_histogram(tiles: DataFrame, bins: int = 40, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """G13 over pairs: counts of pair cosines in equal bins; the last bin is closed, the rest dropped."""

    def kernel(rows) -> Iterator[pd.DataFrame]:
        counts = np.zeros(bins, dtype=np.int64)
        for v in _pair_values(rows):
            v = v[(v >= low) & (v <= high)]
            pos = np.minimum(np.floor((v - low) / (high - low) * bins), bins - 1).astype(np.int64)
            counts += np.bincount(pos, minlength=bins)
        yield pd.DataFrame({"bin": np.arange(bins, dtype=np.int64), "n": counts})

    found = B.map_tiles(tiles, kernel, "bin bigint, n bigint")
    return found.groupBy("bin").agg(F.sum("n").alias("n"))


def boundary_by_card(tiles: DataFrame, id_type: str, d: float | Column) -> DataFrame:
    """J16/J17 per card: pairs, mean cosine, closest distance, mean boundary, number of critical pairs.

    boundary = distance - D_aug; negative boundaries are critical.
    """
    marked = tiles.withColumn("d", B.scalar_double(d))

    def kernel(rows) -> Iterator[pd.DataFrame]:
        for row in rows:  # one row for each card of a tile, however many strips it takes
            left, below, ids = [], None, None
            for ids_a, ids, cos, mask in B.tile_strips(row):
                dist = 1.0 - np.round(cos, SIM_DECIMALS)
                use = np.ones(dist.shape, dtype=bool) if mask is None else mask
                known, close = np.where(use, dist, 0.0), np.where(use, dist, np.inf)
                critical = use & (dist < row.d)
                left.append((ids_a, use.sum(1), known.sum(1), close.min(1), critical.sum(1)))
                new = use.sum(0), known.sum(0), close.min(0), critical.sum(0)
                below = new if below is None else (below[0] + new[0], below[1] + new[1], np.minimum(below[2], new[2]), below[3] + new[3])
            if below is None:
                continue
            both = (np.concatenate(x) for x in zip(*left, (ids, *below), strict=True))
            frame = pd.DataFrame(dict(zip(("id", "n", "s", "lo", "critical"), both, strict=True)))
            yield frame[frame.n > 0]

    schema = f"id {id_type}, n bigint, s double, lo double, critical bigint"
    return B.map_tiles(marked, kernel, schema).groupBy("id").agg(
        F.sum("n").alias("n_pairs"), (1.0 - F.sum("s") / F.sum("n")).alias("mean_cos"),
        F.min("lo").alias("min_dist"), F.sum("critical").alias("n_critical"),
        (F.sum("s") / F.sum("n")).alias("mean_dist"),
    ).withColumn("_d", B.scalar_double(d)).select(
        "id", "n_pairs", "mean_cos", "min_dist", (F.col("min_dist") - F.col("_d")).alias("min_boundary"),
        (F.col("mean_dist") - F.col("_d")).alias("mean_boundary"), "n_critical",
    )


def closest_pairs(tiles: DataFrame, id_type: str, d: float | Column, top_n: int = 20) -> DataFrame:
    """The N pairs with the smallest boundary, ties by ids. Each tile keeps only its own N."""

    def kernel(rows) -> Iterator[pd.DataFrame]:
        for row in rows:
            for ids_a, ids_b, cos, mask in B.tile_strips(row):
                flat = 1.0 - np.round(cos, SIM_DECIMALS).ravel()
                at = np.arange(len(flat)) if mask is None else np.flatnonzero(mask.ravel())
                if len(at) > top_n:  # everything up to the N-th distance, so ties survive
                    cut = np.partition(flat[at], top_n - 1)[top_n - 1]
                    at = at[flat[at] <= cut]
                i, j = np.unravel_index(at, cos.shape)
                x, y = ids_a[i], ids_b[j]
                first, second = np.where(x < y, x, y), np.where(x < y, y, x)
                pick = np.lexsort((second, first, flat[at]))[:top_n]
                yield pd.DataFrame({"card_a": first[pick], "card_b": second[pick], "dist": flat[at][pick]})

    found = B.map_tiles(tiles, kernel, f"card_a {id_type}, card_b {id_type}, dist double")
    top = found.orderBy("dist", "card_a", "card_b").limit(top_n)
    return top.withColumn("_d", B.scalar_double(d)).select(
        "card_a", "card_b", "dist", (F.col("dist") - F.col("_d")).alias("boundary"),
        (F.col("dist") - F.col("_d") < 0).alias("critical"),
    )
