"""Cluster quality: metadata sets, conflicts, flags, ranked reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.functions.columns import any_flag, first_truthy, fixed_decimals
from prismcat.operators.catalogue import attach_print_and_image
from prismcat.operators.skew import lookup_join

# Default thresholds of the two distance flags.
SPREAD_MAX = 0.90
OVERLAP = 0.60
# Which fields must agree inside a card, and which between overlapping neighbours.
INTERNAL_FIELDS = ["name", "mana_cost", "cmc", "colors", "color_identity"]
CROSS_FIELDS = ["mana_cost", "cmc", "colors", "color_identity"]
FLAGS = ["suspect_overlap", "suspect_cluster_spread", "suspect_metadata_conflict"]


def load_by_logical(
    emb: DataFrame, cards: DataFrame, images: DataFrame, mode: str, fields: list[str], row_id: str = "emb_id", **skew
) -> DataFrame:
    """Vectors of one mode with logical id, image path and their own print's metadata.

    Vectors whose print has no catalogue row keep NULL fields; ``metadata_values`` fills those from
    the other prints of the logical card instead of repeating every vector once per print.
    """
    own = cards.select("print_id", F.col("logical_id").alias("_own_logical"), *fields)
    paths = images.select("image_id", F.col("file_path").alias("image_path"))
    joined = attach_print_and_image(emb.where(F.col("mode") == mode), own, paths, row_id, **skew)
    return joined.withColumn(
        "logical_id", F.coalesce(F.col("logical_id"), F.col("_own_logical"))
    ).withColumn(
        "group_id", first_truthy(F.col("logical_id"), F.col("print_id").cast("string"))
    ).drop("_own_logical")


def metadata_values(loaded: DataFrame, cards: DataFrame, fields: list[str]) -> DataFrame:
    """G04 sets: distinct (group_id, field, value), values as text.

    A field the vector's own print lacks takes the values of all prints of its logical card. Vectors
    are reduced to the distinct (group, logical id, field, value) before anything is joined, and
    values stay one per row, so no card is ever collected into one task.
    """
    cells = F.explode(F.array(*[_cell(f) for f in fields])).alias("_c")
    card_cells = F.explode(F.array(*[_cell(f) for f in fields if f in cards.columns])).alias("_c")
    # vectors of one print share their metadata, so most rows fall away before the fields are unfolded
    members = loaded.select("group_id", "logical_id", *fields).distinct()
    own = members.select("group_id", "logical_id", cells).select("group_id", "logical_id", "_c.*").distinct()
    present = own.where(F.col("value").isNotNull()).select("group_id", "field", "value")
    lacking = own.where(F.col("value").isNull()).select("group_id", "logical_id", "field")
    siblings = (
        cards.where(F.col("logical_id").isNotNull()).select("logical_id", card_cells)
        .select("logical_id", "_c.*").where(F.col("value").isNotNull()).distinct()
    )
    borrowed = lacking.join(siblings, ["logical_id", "field"]).select("group_id", "field", "value")
    return present.unionByName(borrowed).where(
        (F.col("value") != "") | F.col("field").isin("mana_cost", "colors", "color_identity")
    ).distinct()


def _cell(field: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value"))


def metadata_summary(values: DataFrame, fields: list[str]) -> DataFrame:
    """G04 header per card: representative (smallest) value and number of values of every field.

    A plain aggregate over the distinct values: min and count are combined in the map tasks.
    """
    ranked = values.withColumn(
        "_v", F.struct(F.when(F.col("field") == "cmc", F.col("value").try_cast("double")).alias("num"), "value")
    )
    picks = []
    for f in fields:
        mine = F.col("field") == f
        best = F.min(F.when(mine, F.col("_v")))
        picks.append((best["num"] if f == "cmc" else best["value"]).alias(f))
        picks.append(F.count_if(mine).alias(f"n_{f}"))
    return ranked.groupBy("group_id").agg(*picks)


def internal_conflict(meta: DataFrame, fields: list[str] = INTERNAL_FIELDS) -> Column:
    """G10 internal: any core field with more than one value."""
    counts = [F.coalesce(meta[f"n_{f}"], F.lit(0)) for f in fields if f"n_{f}" in meta.columns]
    return any_flag(*[(c > 1).cast("int") for c in counts])


def _with_neighbour(rows: DataFrame, meta: DataFrame, key: str, columns: dict[str, str], **skew) -> DataFrame:
    """Attach the neighbour's fields; one card may be the neighbour of very many."""
    side = meta.select(F.col("group_id").alias(key), *[F.col(c).alias(n) for c, n in columns.items()])
    return lookup_join(rows, side, [key], F.col("group_id"), **skew)


def quality_table(
    spread: DataFrame,
    neighbours: DataFrame,
    meta: DataFrame,
    spread_max: float = SPREAD_MAX,
    overlap: float = OVERLAP,
    mode: str = "analysis",
) -> DataFrame:
    """One row per card with the three 0/1 flags, distances and the thresholds used.

    All inputs have one row per ``group_id``.
    """
    cross = [f for f in CROSS_FIELDS if f in meta.columns]
    flagged = meta.withColumn("_internal", internal_conflict(meta))
    joined = spread.join(neighbours, "group_id", "left").join(flagged, "group_id", "left")
    joined = _with_neighbour(
        joined, meta, "neighbour", {f: f"_nb_{f}" for f in cross}, count_on=neighbours
    )
    near = F.col("neighbour").isNotNull() & (F.col("neighbour_dist") < overlap)
    wide = (F.col("intra_mean_dist") > F.col("global_mean") + 2 * F.col("global_std")) | (
        F.col("intra_max_dist") > spread_max
    )
    differs = any_flag(*[(~F.col(f).eqNullSafe(F.col(f"_nb_{f}"))).cast("int") for f in cross]) if cross else F.lit(False)
    conflict = F.coalesce(F.col("_internal"), F.lit(False)) | (near & differs)
    return joined.select(
        "group_id", near.cast("int").alias("suspect_overlap"), wide.cast("int").alias("suspect_cluster_spread"),
        conflict.cast("int").alias("suspect_metadata_conflict"), F.col("neighbour").alias("nearest_neighbor_id"),
        F.col("neighbour_dist").alias("nearest_neighbor_dist"), "intra_mean_dist", "intra_max_dist",
        F.struct(
            *[F.struct(F.col(f).alias("value"), F.col(f"n_{f}").alias("n_values")).alias(f)
              for f in INTERNAL_FIELDS if f in meta.columns],
            F.struct(
                F.lit(float(spread_max)).alias("spread_max"), F.lit(float(overlap)).alias("overlap"),
                F.col("global_mean"), F.col("global_std"), F.lit(mode).alias("mode"),
            ).alias("thresholds"),
        ).alias("meta_info"),
    )


def flag_counts(quality: DataFrame) -> DataFrame:
    """Number of cards and of each flag (one row)."""
    return quality.agg(
        F.count(F.lit(1)).alias("cards"),
        *[F.coalesce(F.sum(f), F.lit(0)).cast("bigint").alias(f) for f in FLAGS],
    )


def suspects_only(quality: DataFrame) -> DataFrame:
    """Rows with at least one flag."""
    return quality.where(any_flag(*[F.col(f) for f in FLAGS]))


def enrich_neighbours(quality: DataFrame, meta: DataFrame, fields: list[str]) -> DataFrame:
    """The card's own display fields and its neighbour's name and image path."""
    own = quality.join(meta.select("group_id", *fields), "group_id", "left")
    shown = {"name": "neighbor_name", "image_path": "neighbor_image_path"}
    return _with_neighbour(own, meta, "nearest_neighbor_id", shown)


def spread_order() -> list[Column]:
    return [F.desc("suspect_cluster_spread"), F.desc("intra_mean_dist"), F.desc("intra_max_dist"), F.asc("group_id")]


def overlap_order() -> list[Column]:
    return [F.asc_nulls_last("nearest_neighbor_dist"), F.asc("group_id")]


def conflict_order() -> list[Column]:
    return [F.desc("suspect_overlap"), F.desc("intra_mean_dist"), F.asc("group_id")]


def top_spread(quality: DataFrame, n: int = 20) -> DataFrame:
    """Flagged first, then widest."""
    return quality.orderBy(*spread_order()).limit(n)


def top_overlap(quality: DataFrame, n: int = 20) -> DataFrame:
    """Closest neighbours first, cards without a neighbour last."""
    return quality.orderBy(*overlap_order()).limit(n)


def top_conflicts(quality: DataFrame, n: int = 20) -> DataFrame:
    """Metadata conflicts, overlapping ones first."""
    return quality.where(F.col("suspect_metadata_conflict") == 1).orderBy(*conflict_order()).limit(n)


def report_order() -> list[Column]:
    """Any flag first, then neighbour distance (0.0 is the closest), then widest."""
    flagged = any_flag(*[F.col(f) for f in FLAGS]).cast("int")
    return [
        flagged.desc(), F.asc_nulls_last("nearest_neighbor_dist"), F.desc("intra_mean_dist"), F.asc("group_id"),
    ]


def report_rows(enriched: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """The 22 text columns of the cluster report."""
    number = lambda c: fixed_decimals(F.col(c), 6, decimal_comma)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    limits = {n: F.col(f"meta_info.thresholds.{n}") for n in ("spread_max", "overlap", "global_mean", "global_std")}
    fixed = {n: fixed_decimals(c, 6, decimal_comma) for n, c in limits.items()}
    return enriched.select(
        "group_id", text("name").alias("name"), text("set_code").alias("set_code"),
        text("set_name").alias("set_name"), text("image_path").alias("image_path"),
        text("mana_cost").alias("mana_cost"), number("cmc").alias("cmc"),
        F.coalesce("colors", F.lit("[]")).alias("colors"),
        *[text(f).alias(f) for f in FLAGS], text("nearest_neighbor_id").alias("nearest_neighbor_id"),
        text("neighbor_name").alias("nearest_neighbor_name"),
        text("neighbor_image_path").alias("nearest_neighbor_image_path"),
        number("nearest_neighbor_dist").alias("nearest_neighbor_dist"),
        number("intra_mean_dist").alias("intra_mean_dist"), number("intra_max_dist").alias("intra_max_dist"),
        fixed["spread_max"].alias("spread_max_thr"), fixed["overlap"].alias("overlap_thr"),
        fixed["global_mean"].alias("global_intra_mean"), fixed["global_std"].alias("global_intra_std"),
        F.col("meta_info.thresholds.mode").alias("mode"),
    )


def summary_document(quality: DataFrame, meta: DataFrame, top_n: int = 20) -> DataFrame:
    """One row with thresholds, counts and the three top lists, ready for a JSON sink.

    Each list holds at most ``top_n`` rows, so collecting it is bounded.
    """
    names = meta.select("group_id", "name")
    neighbour_names = names.select(F.col("group_id").alias("nearest_neighbor_id"), F.col("name").alias("neighbor_name"))
    neighbour = [F.col("nearest_neighbor_id"), F.col("neighbor_name")]
    mean = F.col("intra_mean_dist")
    sections = {
        "spread": (
            top_spread, [-F.col("suspect_cluster_spread"), -mean, -F.col("intra_max_dist")],
            [mean, F.col("intra_max_dist"), F.col("suspect_cluster_spread").alias("flag")],
        ),
        "overlap": (
            top_overlap, [F.coalesce("nearest_neighbor_dist", F.lit(float("inf")))],
            [*neighbour, F.col("nearest_neighbor_dist"), F.col("suspect_overlap").alias("flag")],
        ),
        "metadata_conflicts": (
            top_conflicts, [-F.col("suspect_overlap"), -mean],
            [*neighbour, F.col("suspect_overlap").alias("overlap_flag")],
        ),
    }
    lists = {}
    for title, (pick, ascending, shown) in sections.items():
        top = pick(quality, top_n).join(names, "group_id", "left").join(neighbour_names, "nearest_neighbor_id", "left")
        top = top.withColumn("name", first_truthy(F.col("name"), F.col("group_id").cast("string")))
        place = F.struct(*ascending, F.col("group_id").alias("_g")).alias("_place")
        entries = F.array_sort(F.collect_list(F.struct(place, "group_id", "name", *shown)))
        lists[title] = top.agg(F.transform(entries, lambda e: e.dropFields("_place"))).scalar()
    head = quality.agg(
        F.first("meta_info.thresholds").alias("thresholds"),
        F.struct(
            F.count(F.lit(1)).alias("cards"),
            F.struct(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FLAGS]).alias("flags"),
        ).alias("counts"),
    )
    return head.select(
        F.col("thresholds.mode").alias("mode"), F.col("thresholds").dropFields("mode").alias("thresholds"),
        "counts", F.struct(*[lists[t].alias(t) for t in lists]).alias("top"),
    )
