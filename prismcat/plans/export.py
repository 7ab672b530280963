"""Image folder to embedding store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.functions.columns import (
    language_from_file_name, parse_file_name, relative_path,
)
from prismcat.operators import images as I
from prismcat.operators.catalogue import backfill_logical_id, upsert
from prismcat.operators.groups import expected_vectors, export_audit, export_records
from prismcat.schemas import embedding_key, image_key
from prismcat.session import materialise
from prismcat.sources.images import image_splits, read_images
from prismcat.sources.store import read_store, replace_mode


@dataclass
class ExportSettings:
    """Which rows an export stores; the two presets are the usual ones."""

    mode: str
    num_augmentations: int = 10
    append_individual: bool = True
    append_centroid: bool = True
    use_centroid: bool = False
    model_id: str = ""
    seed: int = 42

    @staticmethod
    def analysis(**kw) -> ExportSettings:
        return ExportSettings("analysis", **kw)

    @staticmethod
    def runtime(**kw) -> ExportSettings:
        return ExportSettings("runtime", append_individual=False, append_centroid=False, use_centroid=True, **kw)


def encoded_variants(
    images: DataFrame, make_model: Callable, settings: ExportSettings, size_hw: tuple[int, int],
    box: dict | None = None, cfg: dict | None = None, batch_size: int = 64,
) -> DataFrame:
    """(path, print_id, variant, emb): every image and its augmented variants as unit vectors."""
    tensors = I.variant_tensors(images, settings.num_augmentations, size_hw, box, cfg, settings.seed)
    shape = [3, *size_hw]
    return tensors.select(
        F.col("origin").alias("path"), parse_file_name(F.col("origin")).getField("print_id").alias("print_id"),
        "variant", I.encode(F.col("tensor"), make_model, shape, batch_size).alias("emb"),
    )


def export_rows(encoded: DataFrame, cards: DataFrame, settings: ExportSettings, root: str = "") -> DataFrame:
    """Rows of the embedding table for one mode, with image id and resolved logical id.

    ``encoded`` should be a stored table: it is read more than once.
    """
    path = relative_path(F.col("path"), root) if root else F.col("path")
    vectors = encoded.withColumn("file_path", path).withColumn(
        "image_id", image_key(F.col("print_id"), F.col("file_path"))
    )
    rows = export_records(
        vectors, "print_id", [F.col("file_path"), F.col("variant")], settings.append_individual,
        settings.append_centroid, settings.use_centroid,
    )
    rows = rows.withColumn("emb_id", embedding_key(F.col("print_id"), F.lit(settings.mode), F.col("aug_index")))
    rows = backfill_logical_id(rows.withColumn("logical_id", F.lit(None).cast("string")), cards, "emb_id", count_on=encoded)
    return rows.select(
        "emb_id", "print_id", "logical_id", "image_id", F.lit(settings.mode).alias("mode"), "aug_index",
        F.col("emb").cast("array<float>").alias("emb"), F.lit(settings.model_id).alias("model_id"),
        F.current_timestamp().alias("created_at"),
    )


def export_images(encoded: DataFrame, source: str, root: str = "") -> DataFrame:
    """Image table rows of the exported files."""
    path = relative_path(F.col("path"), root) if root else F.col("path")
    named = encoded.select("print_id", path.alias("file_path")).distinct()
    return named.select(
        image_key(F.col("print_id"), F.col("file_path")).alias("image_id"), "print_id",
        F.lit(None).cast("string").alias("logical_id"), "file_path", F.lit(source).alias("source"),
        language_from_file_name(F.col("file_path")).alias("language"), F.lit(True).alias("is_training"),
    )


def audit_export(rows: DataFrame, settings: ExportSettings) -> DataFrame:
    """Cards whose stored row count is not the expected one.

    The expected number counts one image per print, as the export switches do.
    """
    want = expected_vectors(
        1 + settings.num_augmentations, settings.append_individual, settings.append_centroid, settings.use_centroid
    )
    return export_audit(rows, "print_id", want).where(F.col("difference") != 0)


@dataclass
class ExportRun:
    images: DataFrame
    unreadable: DataFrame
    mismatches: DataFrame


def run_export(
    spark: SparkSession, folder: str, cards: DataFrame, images: DataFrame, store_path: str, settings: ExportSettings,
    make_model: Callable, size_hw: tuple[int, int], dim: int, source: str, root: str = "", box: dict | None = None,
) -> ExportRun:
    """The whole job: scan, augment, encode, store one mode, update the image table, audit.

    The store's mode is replaced; the returned image table is the given one with the exported files
    upserted.
    """
    readable, unreadable = read_images(spark, folder)
    with image_splits(spark):
        encoded = materialise(encoded_variants(readable, make_model, settings, size_hw, box), "encoded")
    rows = export_rows(encoded, cards, settings, root)
    replace_mode(rows, store_path, settings.mode, dim)
    written = read_store(spark, store_path).where(F.col("mode") == settings.mode)
    merged = upsert(images, export_images(encoded, source, root), ["print_id", "file_path"], [F.col("image_id")])
    return ExportRun(merged, unreadable, audit_export(written, settings))
