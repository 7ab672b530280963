"""Grouping of vectors: centroids, spread, coverage, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismcat.functions.vectors import euclid, mean_vector, unit
from prismcat.operators.numbering import with_group_index
from prismcat.operators.skew import lookup_join
from prismcat.schemas import CENTROID_INDEX
from prismcat.session import materialise


def centroids(df: DataFrame, key: str, vec: str = "emb", normalise_rows: bool = False) -> DataFrame:
    """Mean vector per group, then L2-normalised. Returns (key, centroid, n_vectors).

    The mean is combined in the map tasks: what is shuffled is one vector per group and task.
    """
    value = unit(F.col(vec)) if normalise_rows else F.col(vec)
    means = df.groupBy(key).agg(mean_vector(value).alias("_mean"), F.count(vec).alias("n_vectors"))
    return means.select(key, unit(F.col("_mean")).alias("centroid"), "n_vectors")


def cluster_spread(
    df: DataFrame, key: str, row_id: str, cents: DataFrame | None = None, vec: str = "emb", **skew
) -> DataFrame:
    """Mean and max distance of a group's unit vectors to its centroid, plus global figures.

    ``global_mean`` / ``global_std`` are the unweighted mean and population deviation of the group
    means. ``row_id`` only spreads hot groups; it does not affect the result.
    """
    cents = centroids(df, key, vec, normalise_rows=True) if cents is None else cents
    rows = df.select(key, F.col(row_id).alias("_row"), unit(F.col(vec)).alias("_unit"))
    joined = lookup_join(rows, cents.select(key, "centroid"), [key], F.col("_row"), "inner", **skew)
    return spread_statistics(joined.select(key, euclid(F.col("_unit"), F.col("centroid")).alias("_d")), key)


def spread_statistics(distances: DataFrame, key: str) -> DataFrame:
    """G03 from (key, _d): per group and global figures."""
    per_group = distances.groupBy(key).agg(
        F.count("_d").alias("n_vectors"), F.avg("_d").alias("intra_mean_dist"), F.max("_d").alias("intra_max_dist")
    )
    per_group = materialise(per_group, "spread")  # one row per group; the global figures read it again
    overall = per_group.agg(
        F.struct(F.avg("intra_mean_dist").alias("m"), F.stddev_pop("intra_mean_dist").alias("s"))
    ).scalar()
    return per_group.withColumn("_o", overall).select(
        key, "n_vectors", "intra_mean_dist", "intra_max_dist",
        F.col("_o.m").alias("global_mean"), F.col("_o.s").alias("global_std"),
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in an explicit order.

    Spark limits each key to one row per task before the shuffle, so hot keys do not pile up.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def values_in_first_seen_order(df: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Distinct non-empty values per key, numbered by first appearance; long format.

    One row per (key, value), so a key with very many values is never held in one row.
    """
    seen = (
        df.where(F.col(value).isNotNull() & (F.col(value) != ""))
        .groupBy(key, value).agg(F.min(F.struct(*order)).alias("_first"))
    )
    return with_group_index(seen, [key], [F.col("_first"), F.col(value)], "position").drop("_first")


def vectors_by_card(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """G01 vectors: every vector with its position in its card's ordered list (long format)."""
    return with_group_index(df, [key], order, "position")


def card_headers(df: DataFrame, key: str, order: list[Column], fields: list[str], language: str) -> DataFrame:
    """G01 metadata: vector count, the first row's fields, the first non-empty language per card."""
    rank = F.struct(*order)
    lang_rank = F.when(F.col(language).isNotNull() & (F.col(language) != ""), rank)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        *[F.min_by(f, rank).alias(f) for f in fields],
        F.min_by(language, lang_rank).alias(language),
    )


def coverage(df: DataFrame, key: str, vec: str = "emb") -> DataFrame:
    """Cards, cards with at least two vectors, vectors, dimension."""
    per_card = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim"))
    return per_card.agg(
        F.count(F.lit(1)).alias("cards"), F.count_if(F.col("n") >= 2).alias("cards_multi"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.max("dim").alias("dimension"),
    )


def number_vectors(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """0-based ``aug_index`` across all images of a card."""
    return with_group_index(df, [key], order, "aug_index").withColumn(
        "aug_index", F.col("aug_index").cast("int")
    )


def export_records(
    vectors: DataFrame,
    key: str,
    order: list[Column],
    append_individual: bool = True,
    append_centroid: bool = True,
    use_centroid: bool = False,
    vec: str = "emb",
) -> DataFrame:
    """Rows to store per card: (key, aug_index, image_id, emb).

    ``use_centroid`` replaces everything by the centroid; no switch at all stores the individuals.
    """
    def centroid_rows() -> DataFrame:
        return centroids(vectors, key, vec).select(
            key, F.lit(CENTROID_INDEX).alias("aug_index"),
            F.lit(None).cast(vectors.schema["image_id"].dataType).alias("image_id"),
            F.col("centroid").alias(vec),
        )

    def individual_rows() -> DataFrame:
        numbered = number_vectors(vectors, key, order)
        return numbered.select(key, "aug_index", "image_id", F.col(vec).cast("array<double>").alias(vec))

    if use_centroid:
        return centroid_rows()
    if append_individual and append_centroid:
        return individual_rows().unionByName(centroid_rows())
    return centroid_rows() if append_centroid else individual_rows()


def expected_vectors(
    base: int, append_individual: bool, append_centroid: bool, use_centroid: bool
) -> int:
    """Rows per card that the export switches ask for."""
    if use_centroid:
        return 1
    wanted = (base if append_individual else 0) + (1 if append_centroid else 0)
    return wanted or base


def export_audit(stored: DataFrame, key: str, expected: int | Column) -> DataFrame:
    """Written rows per card against the expected number, with the difference."""
    counts = stored.groupBy(key).agg(F.count(F.lit(1)).alias("written"))
    want = expected if isinstance(expected, Column) else F.lit(expected)
    return counts.select(
        key, "written", want.cast("bigint").alias("expected"),
        (F.col("written") - want).cast("bigint").alias("difference"),
    )
