"""Catalogue ingest: raw records to card and image tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.functions.columns import IMAGE_VARIANTS, canonical_file_name
from prismcat.operators import catalogue as C
from prismcat.operators.groups import first_rows


@dataclass
class IngestResult:
    cards: DataFrame
    images: DataFrame
    statistics: DataFrame
    rejected: DataFrame


def ingest(
    raw: DataFrame, cards: DataFrame, images: DataFrame, latest: list[Column], source: str,
    languages: list[str], folder: str = "", variants: list[str] = IMAGE_VARIANTS,
) -> IngestResult:
    """One batch: filter by language and image, flatten, upsert cards and images, count.

    ``latest`` orders the batch's flat rows newest first; columns of ``raw`` that it needs beyond the
    card fields, such as a position in the file, go in as ``_order``. Rejected is every record
    without an id, unreadable ones included, whatever its language. No languages: all are allowed.
    """
    order = [c for c in ("_order",) if c in raw.columns]
    flat = C.flatten_cards(C.importable(raw, languages, variants).drop("image_uri"), keep=order)
    rejected = C.rejected_cards(raw)
    name = canonical_file_name(F.col("set_code"), F.col("collector_number"), F.col("lang"), F.col("print_id"))
    path = F.concat(F.lit(folder.rstrip("/") + "/"), name) if folder else name
    newest = first_rows(flat.withColumn("_path", path), ["print_id", "_path"], latest)
    pictures = C.image_rows(newest, F.col("_path"), source)
    return IngestResult(
        C.upsert(cards, flat, ["print_id"], latest).drop(*order),
        C.upsert(images, pictures, ["print_id", "file_path"], [F.col("image_id")]),
        C.load_statistics(cards, flat, ["print_id"], rejected), rejected,
    )


def purge_without_images(cards: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards that stay, cards that go)."""
    return C.with_children(cards, images, "print_id"), C.without_children(cards, images, "print_id")
