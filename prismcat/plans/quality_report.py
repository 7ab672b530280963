"""Cluster-quality job: load, spread, neighbours, metadata, flags, ranked reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.functions.columns import blank_to_null, first_truthy
from prismcat.functions.vectors import euclid, sum_vector, unit
from prismcat.operators import quality as Q
from prismcat.operators.groups import spread_statistics
from prismcat.operators.search import nearest_neighbour
from prismcat.operators.skew import lookup_join
from prismcat.schemas import CENTROID_INDEX
from prismcat.session import materialise

META_FIELDS = ["name", "mana_cost", "cmc", "colors", "color_identity", "set_code", "set_name", "lang", "image_path"]


@dataclass
class QualityReport:
    quality: DataFrame
    meta: DataFrame
    values: DataFrame
    centroids: DataFrame


def build_quality(
    emb: DataFrame,
    cards: DataFrame,
    images: DataFrame,
    mode: str = "analysis",
    spread_max: float = Q.SPREAD_MAX,
    overlap: float = Q.OVERLAP,
    include_centroid_rows: bool = True,
    fields: list[str] | None = None,
) -> QualityReport:
    """The whole report over one mode of the store.

    Vectors are read twice and shuffled at most once. The first pass sums them per print inside the
    map tasks; prints (not vectors) are then joined with the catalogue and summed up to logical
    cards. The second pass measures every vector against the centroid of its print's card.
    """
    fields = META_FIELDS if fields is None else fields
    card_fields = [f for f in fields if f in cards.columns]
    rows = emb.where(F.col("mode") == mode)
    if not include_centroid_rows:
        rows = rows.where(F.col("aug_index") != CENTROID_INDEX)
    # a print's rows may disagree on the logical id they were stored with, NULL and '' included
    rows = rows.withColumn("_member", F.coalesce(F.concat(F.lit("="), "logical_id"), F.lit("")))

    sums = rows.groupBy("print_id", "_member").agg(
        F.first("logical_id").alias("logical_id"), sum_vector(unit(F.col("emb"))).alias("_sum"),
        F.count(F.lit(1)).alias("n"),
    )
    own = cards.select("print_id", F.col("logical_id").alias("_own"), *card_fields)
    prints = sums.join(own, "print_id", "left").withColumn("logical_id", F.coalesce("logical_id", "_own"))
    prints = prints.withColumn("group_id", first_truthy(F.col("logical_id"), F.col("print_id").cast("string")))
    prints = materialise(prints.where(F.col("group_id").isNotNull()).drop("_own"), "prints")

    totals = prints.groupBy("group_id").agg(sum_vector(F.col("_sum")).alias("_sum"), F.sum("n").alias("n_vectors"))
    cents = materialise(totals.select("group_id", unit(F.col("_sum")).alias("centroid"), "n_vectors"), "centroids")
    targets = lookup_join(prints.select("print_id", "_member", "group_id"), cents, ["group_id"], F.col("print_id"), "inner")
    vectors = rows.select("print_id", "_member", "emb_id", unit(F.col("emb")).alias("_unit"))
    measured = lookup_join(
        vectors, targets.select("print_id", "_member", "group_id", "centroid"), ["print_id", "_member"],
        F.col("emb_id"), "inner", count_on=rows.select("print_id", "_member"),
    )
    spread = spread_statistics(measured.select("group_id", euclid(F.col("_unit"), F.col("centroid")).alias("_d")), "group_id")
    neighbours = materialise(nearest_neighbour(cents, "group_id"), "neighbours")

    values = Q.metadata_values(prints, cards, card_fields)
    if "image_path" in fields:
        values = values.unionByName(_image_values(rows, prints, images))
    values = materialise(values, "meta-values")
    meta = materialise(Q.metadata_summary(values, fields), "meta")
    quality = materialise(Q.quality_table(spread, neighbours, meta, spread_max, overlap, mode), "quality")
    return QualityReport(quality, meta, values, cents)


def _image_values(rows: DataFrame, prints: DataFrame, images: DataFrame) -> DataFrame:
    """Distinct image paths per card, from the distinct (print, image) pairs of the stored rows."""
    pairs = rows.where(F.col("image_id").isNotNull()).select("print_id", "_member", "image_id").distinct()
    paths = images.where(blank_to_null(F.col("file_path")).isNotNull()).select("image_id", F.col("file_path").alias("value"))
    found = pairs.join(paths, "image_id").select("print_id", "_member", "value").distinct()
    found = materialise(found, "image-values")
    named = lookup_join(
        found, prints.select("print_id", "_member", "group_id"), ["print_id", "_member"], F.col("value"), "inner"
    )
    return named.select("group_id", F.lit("image_path").alias("field"), "value").distinct()
