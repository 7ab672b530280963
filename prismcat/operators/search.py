"""Top-k similarity joins and what is reported about their results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from prismcat.functions.columns import match_grade
from prismcat.functions.vectors import SIM_DECIMALS, unit_euclid_from_cosine
from prismcat.operators import blocks as B
from prismcat.operators import cells as CELL
from prismcat.operators.groups import first_rows
from prismcat.session import materialise

# Vectors of the queries that are broadcast together, as doubles.
ROUND_BYTES = 64 << 20
# So many queries are fetched before the query side is written.
FEW_QUERIES = 2048
# Between card and vector id in the ids of a search for distinct cards.
CARD_SEPARATOR = "\u0001"


def _take_largest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, column numbers) of the k largest entries per row, leftmost first; uses ``sims`` up."""
    if k > 32:
        cols = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(sims, cols, 1), cols
    values, cols, rows = np.empty((len(sims), k)), np.empty((len(sims), k), np.int64), np.arange(len(sims))
    for i in range(k):
        cols[:, i] = sims.argmax(axis=1)
        values[:, i] = sims[rows, cols[:, i]]
        sims[rows, cols[:, i]] = -np.inf
    return values, cols


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best entries per row by (rounded similarity, column number).

    Only the entries taken are rounded. Where the next entry could round to the same value as the
    last one taken, the whole row is rounded and chosen from again. Missing entries are -inf.
    """
    k = min(k, sims.shape[1])
    more = min(k + 1, sims.shape[1])
    values, cols = _take_largest(sims if more <= 32 else sims.copy(), more)
    near = 2 * 10.0**-SIM_DECIMALS
    unsure = np.flatnonzero((values[:, more - 1] > -np.inf) & (values[:, more - 1] >= values[:, k - 1] - near)) if more > k else []
    rounded = np.round(values, SIM_DECIMALS)
    order = np.lexsort((cols, -rounded), axis=1)[:, :k]
    result = np.take_along_axis(rounded, order, 1), np.take_along_axis(cols, order, 1)
    if len(unsure):
        again = sims[unsure]
        again[np.arange(len(unsure))[:, None], cols[unsure]] = values[unsure]
        result[0][unsure], result[1][unsure] = _take_largest(np.round(again, SIM_DECIMALS), k)
    return result


def _best_per_card(sims: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``_best`` over the best column of every card; columns of a card are adjacent from ``starts`` on."""
    sims = np.round(sims, SIM_DECIMALS)
    top = np.maximum.reduceat(sims, starts, axis=1)
    width = np.diff(np.append(starts, sims.shape[1]))
    columns = np.where(sims == np.repeat(top, width, axis=1), np.arange(sims.shape[1]), sims.shape[1])
    first = np.minimum.reduceat(columns, starts, axis=1)
    values, cards = _take_largest(top, min(k, len(starts)))
    return values, np.take_along_axis(first, cards, 1)


def _without_repeated_cards(hits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Blank out (-inf) all but the best hit of a card in every row."""
    sims, ids = hits
    cards = _card_part(ids)
    order = np.lexsort((ids, -sims, cards), axis=1)
    sims, ids, cards = (np.take_along_axis(x, order, 1) for x in (sims, ids, cards))
    sims[:, 1:][cards[:, 1:] == cards[:, :-1]] = -np.inf
    return sims, ids


def _card_part(ids: np.ndarray) -> np.ndarray:
    return np.char.partition(ids, CARD_SEPARATOR)[..., 0]


class Best:
    """Running k best hits of some queries, at most one per card if asked; ``round_rows`` queries are multiplied at a time.

    ``floors`` are similarities that each query's k-th hit is known to reach; what lies below is nobody's hit. Queries and
    stored vectors that hold NaN or an infinite number are nobody's hit and have none.
    """

    def __init__(
        self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool, by_card: bool = False, round_rows: int | None = None,
        floors: np.ndarray | None = None,
    ):
        usable = np.isfinite(vectors).all(axis=1)
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors
        self.ids, self.vectors = ids, vectors
        if not usable.all():
            self.ids, self.vectors, self.floors = ids[usable], vectors[usable], self.floors[usable]
        self.k, self.exclude_self, self.by_card, self.round_rows = k, exclude_self, by_card, round_rows
        self.hits = None

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Offer stored vectors to all queries, or to those in ``rows`` only."""
        usable = np.isfinite(vectors).all(axis=1)
        if not usable.all():
            ids, vectors = ids[usable], vectors[usable]
        asked = np.arange(len(self.ids)) if rows is None else rows
        if not len(ids) or not len(asked):
            return
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        starts = None
        if self.by_card:
            cards = _card_part(ids)
            starts = np.flatnonzero(np.append(True, cards[1:] != cards[:-1]))
        for part in B.strips(len(asked), len(ids), self.round_rows):
            self._offer(asked[part], ids, vectors, starts)

    def _offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, starts: np.ndarray | None) -> None:
        sims = self.vectors[rows] @ vectors.T
        if self.exclude_self:
            at = np.minimum(np.searchsorted(ids, self.ids[rows]), len(ids) - 1)
            own = np.flatnonzero(ids[at] == self.ids[rows])
            sims[own, at[own]] = -np.inf
        # most queries find nothing among these vectors that is as good as what they have
        promising = np.flatnonzero(sims.max(axis=1) >= self.worst(rows) - 2 * 10.0**-SIM_DECIMALS)
        if not len(promising):
            return
        if len(promising) < len(rows):
            rows, sims = rows[promising], sims[promising]
        values, cols = _best(sims, self.k) if starts is None else _best_per_card(sims, starts, self.k)
        near = ids[cols]
        if self.hits is None:
            self.hits = np.full((len(self.ids), self.k), -np.inf), np.zeros((len(self.ids), self.k), ids.dtype)
        if near.dtype.itemsize > self.hits[1].dtype.itemsize:  # longer texts than before
            self.hits = self.hits[0], self.hits[1].astype(near.dtype)
        values, near = (np.hstack([held[rows], new]) for held, new in zip(self.hits, (values, near), strict=True))
        if starts is not None:
            values, near = _without_repeated_cards((values, near))
        order = np.lexsort((near, -values), axis=1)[:, : self.k]
        for held, merged in zip(self.hits, (values, near), strict=True):
            held[rows] = np.take_along_axis(merged, order, 1)

    def worst(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Similarity of the queries' k-th hits so far, or their floor; -inf where a query has neither."""
        return self.floors[rows] if self.hits is None else np.maximum(self.hits[0][rows, -1], self.floors[rows])

    def batch(self, floor: float, names: list[str]) -> pa.RecordBatch | None:
        """The hits that reach ``floor`` and their query's own, as (query, stored, similarity)."""
        if self.hits is None:
            return None
        sims, near = self.hits
        rows, cols = np.nonzero(sims >= np.maximum(self.floors, floor)[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.array(near[rows, cols]), pa.array(sims[rows, cols])], names)


def held_queries(queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of one delivery's queries."""
    return B.id_array(queries.column("id").to_numpy()), B.unit_rows(B.vector_array(queries.column("vec")))


def _in_place(stored: DataFrame) -> DataFrame:
    """The same rows in at most four tasks a core; partitions are put together where they lie."""
    return stored.coalesce(4 * stored.sparkSession.sparkContext.defaultParallelism)


def _scan_stored(
    stored: DataFrame, held, k: int, exclude_self: bool, floor: float, schema: str, by_card: bool, round_rows: int | None = None
) -> DataFrame:
    """Read the stored side once, where it lies; a task emits k hits per query at its end."""
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*held.value, k, exclude_self, by_card, round_rows)
        for batch in batches:
            if batch.num_rows:
                best.add(*held_queries(pa.Table.from_batches([batch])))
        if (found := best.batch(floor, names)) is not None:
            yield found

    return _in_place(stored.select("id", "vec")).mapInArrow(scan, schema)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every query with their rank; Spark cuts each task's rows to k per query before the shuffle."""
    order = Window.partitionBy("q_id").orderBy(F.desc("similarity"), F.asc("d_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_cards(hits: DataFrame, k: int) -> DataFrame:
    """The k best cards (``_card``) of every query, each by its best hit, with their rank."""
    hits = hits.select("q_id", "d_id", "similarity", F.split("d_id", CARD_SEPARATOR, 2)[0].alias("_card"))
    return best_of(first_rows(hits, ["q_id", "_card"], [F.desc("similarity"), F.asc("d_id")]), k)


def deliveries(queries: DataFrame) -> Iterator[tuple[pa.Table, bool]]:
    """The queries (id, vec) in tables of ``ROUND_BYTES`` at most, each with whether it is the last.

    Few queries are fetched as they are. More are written once, counted on the way, and dealt out to as many deliveries
    as their bytes need by a hash of the row. What comes to the driver are the queries and a bounded number of
    task results for each delivery.
    """
    few = queries.limit(1 + FEW_QUERIES).toArrow()
    if few.num_rows <= FEW_QUERIES:
        yield few, True
        return
    seen = Observation()
    counted = queries.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
    asked = materialise(counted.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())), "queries")
    count = -(-seen.get["n"] // max(1, ROUND_BYTES // (8 * max(seen.get["dim"], 1))))
    for i in range(count):
        yield _in_place(asked.where(F.pmod("_deal", F.lit(count)) == i).select("id", "vec")).toArrow(), i == count - 1


def candidate_hits(
    queries: DataFrame,
    stored: DataFrame,
    k: int,
    threshold: float | None = None,
    exclude_self: bool = False,
    round_rows: int | None = None,
    by_card: bool = False,
    prune: bool = False,
    leaf_rows: int = CELL.LEAF_ROWS,
) -> DataFrame:
    """At least the true top-k per query as (q_id, d_id, similarity); inputs are (id, vec).

    The stored side stays where it lies. Queries come to it in deliveries: the vectors of one (``ROUND_BYTES``) are
    broadcast, every task takes them up in rounds of ``round_rows`` (all that fit a product, if not given) and holds the
    best hits of its own stored rows, and the hits are cut to k per query and written before the next delivery starts;
    the last one is left to the caller's plan. So jobs follow the bytes of the queries, not the number of rounds, and any
    number of queries goes this way. ``prune`` reads a tree of cells in place of the store
    (see ``cells``), which is built first unless ``stored`` is one already; both ways are exact. ``by_card`` expects
    text ids that start with the card and CARD_SEPARATOR, and keeps one hit per card.
    """
    floor = -1.0 if threshold is None else threshold
    queries = queries.where(F.col("vec").isNotNull()).select("id", "vec")
    tree = None
    if prune and not by_card:
        tree = stored if isinstance(stored, CELL.CellTree) else CELL.build_tree(stored, leaf_rows)
        stored = tree.leaves
    else:
        stored = stored.where(F.col("vec").isNotNull()).select("id", "vec")
    id_type = B.spark_type(stored, "id") if tree is None else tree.id_type
    schema = f"q_id {B.spark_type(queries, 'id')}, d_id {id_type}, similarity double"
    context = queries.sparkSession.sparkContext
    found = None
    for table, last in deliveries(queries):
        if not table.num_rows:  # the hash dealt nothing to this delivery
            continue
        held = context.broadcast(held_queries(table))
        if tree is None:
            hits = _scan_stored(stored, held, k, exclude_self, floor, schema, by_card, round_rows)
        else:
            floors = _floors(tree, held, k, exclude_self, floor, schema)
            hits = CELL.scan_tree(tree, held, floors, lambda *q: Best(*q[:2], k, exclude_self, round_rows=round_rows, floors=q[2]), floor, schema)
        if not last:
            hits = materialise((best_cards if by_card else best_of)(hits, k).select("q_id", "d_id", "similarity"), "round-hits")
            held.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return queries.sparkSession.createDataFrame([], schema) if found is None else found


def _floors(tree: CELL.CellTree, held, k: int, exclude_self: bool, floor: float, schema: str) -> np.ndarray:
    """For every query of a delivery a similarity that its k-th hit reaches: the k-th best of the cells' representatives,
    which are stored vectors themselves."""
    spread = tree.representatives.repartition(tree.representatives.sparkSession.sparkContext.defaultParallelism)
    hits = best_of(_scan_stored(spread, held, k, exclude_self, -1.0, schema, False), k)
    known = hits.where(F.col("rank") == k).select("q_id", "similarity").toArrow()
    ids, floors = held.value[0], np.full(len(held.value[0]), max(floor, -1.0))
    if known.num_rows:
        found = B.id_array(known.column("q_id").to_numpy())
        order = np.argsort(found, kind="stable")
        at = order[np.minimum(np.searchsorted(found[order], ids), len(found) - 1)]
        floors = np.where(found[at] == ids, np.maximum(known.column("similarity").to_numpy()[at], floors), floors)
    return floors


def visited_blocks(queries: DataFrame, tree: CELL.CellTree, k: int, threshold: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(leaf, sub, queries): by how many queries each block of the tree is multiplied in a search; one delivery of queries."""
    floor = -1.0 if threshold is None else threshold
    schema = f"q_id {B.spark_type(queries, 'id')}, d_id {tree.id_type}, similarity double"
    held = queries.sparkSession.sparkContext.broadcast(held_queries(queries.select("id", "vec").toArrow()))
    floors = _floors(tree, held, k, exclude_self, floor, schema)
    return CELL.scan_tree(tree, held, floors, lambda *q: Best(*q[:2], k, exclude_self, floors=q[2]), floor, "leaf bigint, sub int, queries bigint", count_tiles=True)


def top_k_similar(
    queries: DataFrame,
    stored: DataFrame,
    k: int = 5,
    threshold: float | None = 0.88,
    exclude_self: bool = False,
    **plan,
) -> DataFrame:
    """The k most similar stored vectors per query, those below the threshold removed.

    ``queries`` and ``stored`` are (id, vec). Result: query_id, stored_id, similarity, distance, rank.
    Hits are per stored vector. Ties go to the smaller id.
    """
    ranked = best_of(candidate_hits(queries, stored, k, threshold, exclude_self, **plan), k)
    if threshold is not None:
        ranked = ranked.where(F.col("similarity") >= threshold)
    return ranked.select(
        F.col("q_id").alias("query_id"), F.col("d_id").alias("stored_id"), "similarity",
        (1.0 - F.col("similarity")).alias("distance"), "rank",
    )


def _card_ids(side: DataFrame) -> DataFrame:
    """(id, vec) with the card in front of the id; whole numbers are padded so that text sorts like them."""
    numeric = side.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    text = F.format_string("%019d", F.col("id").cast("bigint")) if numeric else F.col("id")
    return side.select(F.concat(F.col("print_id").cast("string"), F.lit(CARD_SEPARATOR), text).alias("id"), "vec")


def top_k_cards(
    queries: DataFrame, stored: DataFrame, k: int = 5, threshold: float | None = 0.88, exclude_self: bool = False, **plan
) -> DataFrame:
    """J09 with at most one hit per card: the k best cards per query, each by its best vector.

    ``stored`` is (id, vec, print_id); so is ``queries`` when ``exclude_self`` is set, else (id, vec).
    Ties go to the smaller card, taken as text, and within a card to the smaller id. A task keeps k
    cards per query, however many vectors a card has.
    """
    types = {c: stored.schema[c].dataType for c in ("id", "print_id")}
    asked = _card_ids(queries) if exclude_self else queries.select("id", "vec")
    ranked = best_cards(candidate_hits(asked, _card_ids(stored), k, threshold, exclude_self, by_card=True, **plan), k)
    own = F.split("q_id", CARD_SEPARATOR, 2)[1].cast(queries.schema["id"].dataType) if exclude_self else F.col("q_id")
    return ranked.select(
        own.alias("query_id"), F.col("_card").cast(types["print_id"]).alias("print_id"),
        F.split("d_id", CARD_SEPARATOR, 2)[1].cast(types["id"]).alias("stored_id"), "similarity", (1.0 - F.col("similarity")).alias("distance"), "rank",
    )


def nearest_neighbour(centroids: DataFrame, key: str, vec: str = "centroid", **plan) -> DataFrame:
    """Closest other group of every group; NULL neighbour when there is no other group.

    ``neighbour_dist`` is Euclidean on unit vectors, ``neighbour_cos_dist`` is 1 - cosine.
    """
    side = centroids.select(F.col(key).alias("id"), F.col(vec).alias("vec"))
    best = top_k_similar(side, side, 1, None, True, **plan)
    best = best.select(
        F.col("query_id").alias(key), F.col("stored_id").alias("neighbour"),
        F.col("similarity").alias("neighbour_cos"),
        unit_euclid_from_cosine(F.col("similarity")).alias("neighbour_dist"),
        F.col("distance").alias("neighbour_cos_dist"),
    )
    return centroids.select(key).join(best, key, "left")


def best_matches(queries: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Every query with its rank-1 hit; a query without a hit scores 0.0 and gets no match."""
    first = hits.where(F.col("rank") == 1).select(query_id, "stored_id", "similarity")
    return queries.select(query_id).join(first, query_id, "left").select(
        query_id, "stored_id", F.coalesce("similarity", F.lit(0.0)).alias("score"),
        match_grade(F.coalesce("similarity", F.lit(0.0))).alias("grade"),
    )


def run_summary(matches: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Totals of one recognition run.

    Failed queries (could not be read) count as searched but contribute no score.
    """
    scored = matches.select(F.col("score"), F.lit(1).alias("one"))
    if failed is not None:
        scored = scored.unionByName(failed.select(F.lit(None).cast("double").alias("score"), F.lit(1).alias("one")))
    return scored.agg(
        F.sum("one").alias("searched"), F.count("score").alias("scored"),
        F.max("score").alias("best_score"), F.min("score").alias("worst_score"),
        F.avg("score").alias("mean_score"),
    )


def grade_distribution(matches: DataFrame) -> DataFrame:
    """Count and share per grade."""
    counts = matches.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("grade", "n", (F.col("n") / total).alias("share"))
