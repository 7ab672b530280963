"""Query photos against the embedding store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.operators import images as I
from prismcat.operators import search as S
from prismcat.operators.skew import lookup_join
from prismcat.session import materialise

# Hits per photo and similarity floor of a recognition run.
TOP_K, THRESHOLD = 3, 0.55


@dataclass
class Recognition:
    hits: DataFrame
    matches: DataFrame
    summary: DataFrame
    grades: DataFrame


def recognise(
    queries: DataFrame, stored: DataFrame, cards: DataFrame | None = None, k: int = TOP_K,
    threshold: float = THRESHOLD, failed: DataFrame | None = None, exclude_self: bool = False,
) -> Recognition:
    """Top-k search of (id, vec) queries, best match and grade per query, run summary.

    ``stored`` is (id, vec, print_id); the print's fields are attached to the hits when ``cards``
    is given. Hits are stored once because four results read them.
    """
    found = S.top_k_similar(queries.select("id", "vec"), stored.select("id", "vec"), k, threshold, exclude_self)
    found = materialise(found, "hits")
    if "print_id" in stored.columns:
        owner = stored.select(F.col("id").alias("stored_id"), "print_id")
        found = lookup_join(found, owner, ["stored_id"], F.col("query_id"))
        if cards is not None:
            found = lookup_join(found, cards, ["print_id"], F.col("query_id"))
    ids = queries.select(F.col("id").alias("query_id"))
    matches = S.best_matches(ids, found)
    return Recognition(found, matches, S.run_summary(matches, failed), S.grade_distribution(matches))


def photo_vectors(
    images: DataFrame, make_model: Callable, size_hw: tuple[int, int], roi: dict | None = None, batch_size: int = 64
) -> DataFrame:
    """Query photos to (id, vec): region of interest, tensor, encoder. Stored, as a search reads it twice."""
    cropped = I.crop_roi(images, roi) if roi else images
    tensors = I.image_tensors(cropped, size_hw)
    vec = I.encode(F.col("tensor"), make_model, [3, *size_hw], batch_size)
    return materialise(tensors.select(F.col("origin").alias("id"), vec.alias("vec")), "photos")
