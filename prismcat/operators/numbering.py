"""Exact row numbers without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismcat.session import materialise

_POSITION_BITS = 33


def _sorted_positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition and sort, tag every row with (partition, position), and store the result.

    Storing matters: the range bounds are sampled, so a second run of the same plan could cut the
    partitions elsewhere and the offsets would no longer fit.
    """
    mono = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_ix_mono", mono)
    placed = materialise(placed, "ordered")
    return placed.select(
        "*",
        F.shiftright("_ix_mono", _POSITION_BITS).cast("int").alias("_ix_part"),
        F.col("_ix_mono").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_ix_pos"),
    ).drop("_ix_mono")


def _with_running_index(placed: DataFrame, name: str) -> DataFrame:
    """Global index from (partition, position); the offset table has one row per partition."""
    sizes = placed.groupBy("_ix_part").agg(F.count(F.lit(1)).alias("_ix_rows"))
    before = Window.orderBy("_ix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_ix_part", F.coalesce(F.sum("_ix_rows").over(before), F.lit(0)).alias("_ix_offset"))
    # one row per range partition, at most spark.sql.shuffle.partitions of them
    return (
        placed.join(F.broadcast(offsets), "_ix_part")
        .withColumn(name, F.col("_ix_offset") + F.col("_ix_pos"))
        .drop("_ix_offset", "_ix_pos")
    )


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the given total order."""
    out = _with_running_index(_sorted_positions(df, order), name).drop("_ix_part")
    return out.withColumn(name, F.col(name) + start) if start else out


def with_group_index(
    df: DataFrame, group: list[str], order: list[Column], name: str = "idx", start: int = 0
) -> DataFrame:
    """Number the rows of every group in order, also when one group spans many partitions.

    A group's first global index is found from one small row per (group, partition), and joined
    back on both, so that a hot group stays spread over the partitions it was sorted into.
    """
    keys = [F.col(g) for g in group]
    numbered = _with_running_index(_sorted_positions(df, [*keys, *order]), "_ix_global")
    pieces = numbered.groupBy(*group, "_ix_part").agg(F.min("_ix_global").alias("_ix_first"))
    starts = pieces.withColumn("_ix_first", F.min("_ix_first").over(Window.partitionBy(*group)))
    renamed = starts.select(
        *[F.col(g).alias(f"_ix_s_{g}") for g in group], F.col("_ix_part").alias("_ix_s_part"), "_ix_first"
    )
    cond = F.col("_ix_part") == F.col("_ix_s_part")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_ix_s_{g}"))
    return (
        numbered.join(renamed, cond)
        .withColumn(name, F.col("_ix_global") - F.col("_ix_first") + start)
        .drop("_ix_global", "_ix_first", "_ix_part", "_ix_s_part", *[f"_ix_s_{g}" for g in group])
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (p, quantile), NULL quantiles for an empty table.

    Equal values are counted before the sort; ranks are found by running counts over the
    range-sorted values, so no task ever holds more than its own range.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("_ix_n")
    )
    placed = _sorted_positions(counts, [F.col("v")])
    within = Window.partitionBy("_ix_part").orderBy("_ix_pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("_ix_part").agg(F.sum("_ix_n").alias("_ix_rows"))
    before = Window.orderBy("_ix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_ix_part", F.coalesce(F.sum("_ix_rows").over(before), F.lit(0)).alias("_ix_offset"))
    total = counts.agg(F.sum("_ix_n")).scalar()
    # one row per range partition
    ranked = placed.join(F.broadcast(offsets), "_ix_part").select(
        "v", (F.col("_ix_offset") + F.sum("_ix_n").over(within)).alias("_upto"), "_ix_n", total.alias("_total")
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    rank = F.col("p") * (F.col("_total") - 1)
    owns = lambda r: (r >= F.col("_upto") - F.col("_ix_n")) & (r < F.col("_upto"))
    picked = ranked.select("*", wanted).select(
        "p", (rank - F.floor(rank)).alias("_share"),
        F.when(owns(F.floor(rank)), F.col("v")).alias("_low"), F.when(owns(F.ceil(rank)), F.col("v")).alias("_high"),
    ).where(F.col("_low").isNotNull() | F.col("_high").isNotNull())
    found = picked.groupBy("p").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_share").alias("_share"))
    all_p = spark.createDataFrame([(float(p),) for p in probabilities], "p double")
    return all_p.join(found, "p", "left").select(
        "p", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("quantile")
    )
