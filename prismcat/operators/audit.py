"""Referential and naming audit, one row per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Child rows whose key has no parent; NULL keys do not count.

    Children are counted per key before the join, so a hot key is one row in it.
    """
    per_key = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    lost = per_key.join(known, "_k", "left_anti")
    return lost.agg(
        F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")
    )


def violations(df: DataFrame, bad: Column, rule: str) -> DataFrame:
    """Rows for which a predicate holds."""
    return df.agg(F.lit(rule).alias("rule"), F.count_if(bad).cast("bigint").alias("violations"))


def audit(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def store_audit(cards: DataFrame, images: DataFrame, emb: DataFrame, model_id: str | None = None) -> DataFrame:
    """The standard rule set over the three tables of the store."""
    own_name = F.col("file_path").endswith(F.concat(F.lit("_"), F.col("print_id").cast("string"), F.lit(".jpg")))
    rules = [
        orphans(images, "print_id", cards, "print_id", "image_without_card"),
        orphans(emb, "print_id", cards, "print_id", "embedding_without_card"),
        orphans(emb, "image_id", images, "image_id", "embedding_without_image"),
        violations(images, ~own_name, "file_name_not_ending_with_print_id"),
        violations(emb, F.coalesce("logical_id", F.lit("")) == "", "embedding_without_logical_id"),
    ]
    if model_id is not None:
        rules.append(violations(emb, ~F.col("model_id").eqNullSafe(F.lit(model_id)), "embedding_of_other_model"))
    return audit(*rules)
