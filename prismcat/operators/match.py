"""Matching by name and by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.functions.columns import base_name, blank_to_null, normal_name
from prismcat.operators.containment import contained_names
from prismcat.operators.numbering import with_global_index
from prismcat.operators.skew import lookup_join
from prismcat.session import materialise


def match_names(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(query_id, query_name) against (ref_id, ref_name): exact normalised name, else containment.

    Containment runs both ways and the smallest catalogue key wins. Query names are reduced to distinct names
    first, and catalogue names to distinct keys; ``containment`` finds names in names without comparing pairs.
    """
    q = queries.select("query_id", normal_name(F.col("query_name")).alias("q"))
    keys = (
        catalogue.select("ref_id", normal_name(F.col("ref_name")).alias("key"))
        .where(blank_to_null(F.col("key")).isNotNull())
        .groupBy("key").agg(F.min("ref_id").alias("ref_id"))
    )
    names = q.where(blank_to_null(F.col("q")).isNotNull()).select("q").distinct()
    keys = materialise(keys, "name-keys")
    names = materialise(names.join(keys.select(F.col("key").alias("q"), F.col("key").alias("exact_key")), "q", "left"), "names")
    rest = names.where(F.col("exact_key").isNull())
    near = contained_names(rest.select(F.col("q").alias("name")), keys.select(F.col("key").alias("name")))
    chosen = names.join(near.withColumnRenamed("name", "q"), "q", "left").select(
        "q", F.coalesce("exact_key", F.least("outer", "inner")).alias("key"),
        F.when(F.col("exact_key").isNotNull(), "exact").when(F.coalesce("outer", "inner").isNotNull(), "contains").alias("how"),
    )
    resolved = chosen.join(keys, "key", "left").select("q", "how", "ref_id", F.col("key").alias("ref_key"))
    return lookup_join(q, resolved, ["q"], F.col("query_id")).select(
        "query_id", "ref_id", "ref_key", F.coalesce("how", F.lit("none")).alias("how")
    )


def round_robin(queries: DataFrame, refs: DataFrame, query_id: str, ref_id: str) -> DataFrame:
    """The i-th query (in id order) gets reference ``i mod n``."""
    left = with_global_index(queries.select(query_id), [F.col(query_id)], "i")
    right = with_global_index(refs.select(ref_id), [F.col(ref_id)], "slot")
    n = refs.agg(F.count(F.lit(1))).scalar()
    # every slot serves the same number of queries, so the join is balanced by construction
    return left.withColumn("slot", F.try_mod(F.col("i"), n)).join(right, "slot", "left").select(
        query_id, "i", ref_id
    )


def resolve_paths(rows: DataFrame, listing: DataFrame, row_id: str, path: str, root: str) -> DataFrame:
    """Stored path to an existing file: absolute as is, below the root, or by base name; else NULL.

    ``listing`` has one ``path`` per existing file; both lookups are reduced to unique keys first.
    """
    by_path = listing.select(F.col("path").alias("_candidate"), F.col("path").alias("_full")).distinct()
    by_base = listing.groupBy(base_name(F.col("path")).alias("_base")).agg(F.min("path").alias("_by_base"))
    absolute = F.col(path).startswith("/") | F.col(path).rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    prefixed = F.concat(F.lit(root.rstrip("/") + "/"), F.col(path))
    keyed = rows.withColumn("_candidate", F.when(~absolute, prefixed)).withColumn(
        "_base", F.when(~absolute, base_name(F.col(path)))
    )
    found = lookup_join(keyed, by_path, ["_candidate"], F.col(row_id))
    found = lookup_join(found, by_base, ["_base"], F.col(row_id), count_on=keyed)
    return found.withColumn(
        "resolved", F.when(absolute, F.col(path)).otherwise(F.coalesce("_full", "_by_base"))
    ).drop("_candidate", "_full", "_base", "_by_base")
