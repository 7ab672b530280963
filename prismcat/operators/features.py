"""Sampling, class indexes, triplets, losses as evaluation, PCA, scatter and histogram tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismcat.functions.columns import blank_to_null, first_truthy
from prismcat.functions.vectors import doubles, euclid
from prismcat.operators.numbering import exact_quantiles, with_global_index
from prismcat.operators.skew import MIN_HOT_ROWS, lookup_join
from prismcat.session import materialise


def fixed_sample(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if there are fewer, all if n <= 0), the same for any partitioning."""
    if n <= 0:
        return df
    return df.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), F.col(row_id)).limit(n)


def merge_listings(*listings: DataFrame) -> DataFrame:
    """SO1: union of image listings (print_id, path); duplicates stay."""
    first, *rest = listings
    out = first
    for other in rest:
        out = out.unionByName(other)
    return out


def images_per_class(listing: DataFrame) -> DataFrame:
    """Number of images per print."""
    return listing.groupBy("print_id").agg(F.count(F.lit(1)).alias("n_images"), F.min("path").alias("first_path"))


def class_index(df: DataFrame, key: str) -> DataFrame:
    """Sorted distinct keys numbered from 0."""
    return with_global_index(df.select(key).distinct(), [F.col(key)], "class_idx")


def triplets(listing: DataFrame, seed: int = 42, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """As many (anchor, positive, negative) rows as images in the listing (print_id, path).

    Picks are hashes of the triplet number, so they repeat exactly. The positive differs from the
    anchor when its class has more than one image; the negative comes from another class. Fewer than
    two classes is an error. Images are numbered once in the order of class and path, so a class is a stretch of
    numbers and an image is looked up by its number; numbers that very many triplets pick, as those of the only
    image of a class, are salted.
    """
    listing = listing.select("print_id", "path")
    images = materialise(with_global_index(listing, [F.col("print_id"), F.col("path")], "at"), "triplet-images")
    sizes = images.groupBy("print_id").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("start"))
    classes = materialise(with_global_index(sizes, [F.col("print_id")], "cls"), "triplet-classes")
    figures = classes.agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("n")).collect()[0]
    n_classes, n_images = figures["k"], figures["n"] or 0
    if n_classes < 2:
        raise ValueError("triplets need at least two classes")

    def pick(salt: str, limit: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("triplet"), F.lit(salt), F.lit(seed)), limit)

    k = F.lit(n_classes)
    base = listing.sparkSession.range(n_images).withColumnRenamed("id", "triplet")
    base = base.withColumn("a_cls", pick("class", k))
    base = base.withColumn("n_cls", (F.col("a_cls") + 1 + pick("other", k - 1)) % k)

    def add_class(df: DataFrame, prefix: str) -> DataFrame:
        side = classes.select(
            F.col("cls").alias(f"{prefix}_cls"), F.col("print_id").alias(f"{prefix}_id"),
            F.col("size").alias(f"{prefix}_size"), F.col("start").alias(f"{prefix}_start"),
        )
        return df.join(side, f"{prefix}_cls")

    rows = add_class(add_class(base, "a"), "n")
    rows = rows.withColumn("a_pos", pick("anchor", F.col("a_size")))
    step = F.when(F.col("a_size") > 1, 1 + pick("positive", F.greatest(F.col("a_size") - 1, F.lit(1)))).otherwise(0)
    rows = rows.withColumns(
        {
            "anchor_at": F.col("a_start") + F.col("a_pos"), "positive_at": F.col("a_start") + (F.col("a_pos") + step) % F.col("a_size"),
            "negative_at": F.col("n_start") + pick("negative", F.col("n_size")),
        }
    ).select("triplet", "a_id", "n_id", "a_cls", "anchor_at", "positive_at", "negative_at")
    # classes are drawn evenly, so no number is picked much more often than a class is
    crowded = 2 * n_images > min_rows * n_classes
    drawn = rows = materialise(rows, "triplet-picks") if crowded else rows
    for name in ("anchor", "positive", "negative"):
        side, key = images.select(F.col("at").alias(f"{name}_at"), F.col("path").alias(name)), [f"{name}_at"]
        rows = lookup_join(rows, side, key, F.col("triplet"), "inner", min_rows, count_on=drawn) if crowded else rows.join(side, key)
    return rows.select(
        "triplet", F.col("a_id").alias("print_id"), F.col("n_id").alias("negative_print_id"),
        "anchor", "positive", "negative", F.col("a_cls").alias("label"),
    )


def triplet_loss(rows: DataFrame, anchor: str, positive: str, negative: str, margin: float = 0.35) -> DataFrame:
    """Mean margin loss, number of triplets and share of triplets that violate the margin."""
    near, far = euclid(F.col(anchor), F.col(positive)), euclid(F.col(anchor), F.col(negative))
    loss = F.greatest(near - far + margin, F.lit(0.0))
    return rows.select(loss.alias("loss")).agg(
        F.count("loss").alias("triplets"), F.avg("loss").alias("mean_loss"),
        F.avg((F.col("loss") > 0).cast("double")).alias("active_share"),
    )


def classification_metrics(rows: DataFrame, logits: str, label: str) -> DataFrame:
    """Mean cross entropy and accuracy of a (logits, label) table; the first maximum predicts."""
    z = doubles(F.col(logits))
    top = F.array_max(z)
    total = F.aggregate(
        F.zip_with(z, F.array_repeat(top, F.size(z)), lambda x, m: F.exp(x - m)), F.lit(0.0), lambda s, x: s + x
    )
    true = F.get(z, F.col(label))
    per_row = rows.select(
        (F.log(total) + top - true).alias("ce"), (F.array_position(z, top) - 1 == F.col(label)).alias("hit")
    )
    return per_row.agg(
        F.count("ce").alias("n"), F.avg("ce").alias("mean_ce"), F.avg(F.col("hit").cast("double")).alias("accuracy")
    )


def pca_2d(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Centred vectors projected on their first two principal axes: (key, pc1, pc2).

    Fitting sums one dim x dim matrix over the tasks. The sign of each axis is fixed so that its
    largest loading is positive; with fewer dimensions or rows the missing axes are 0.
    """
    data = df.select(key, array_to_vector(doubles(F.col(vec))).alias("_v"))
    first = data.select(F.size(vector_to_array("_v")).alias("d")).head()
    if first is None or first["d"] < 2:
        only = F.get(vector_to_array(F.col("_v")), F.lit(0))
        mean = data.agg(F.avg(only)).scalar()
        return data.select(key, (only - mean).alias("pc1"), F.lit(0.0).alias("pc2"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(data).transform(data)
    model = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), [0, 1]])
    p = vector_to_array(F.col("_p"))
    return model.transform(centred).select(
        key, (p[0] * float(signs[0])).alias("pc1"), (p[1] * float(signs[1])).alias("pc2")
    )


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every column to [0, 1]; the span is at least 1e-9."""
    ends = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]
    out = df.withColumn("_e", df.agg(F.struct(*ends)).scalar())
    for c in columns:
        lo, hi = F.col(f"_e.{c}.lo"), F.col(f"_e.{c}.hi")
        out = out.withColumn(c, (F.col(c) - lo) / F.greatest(hi - lo, F.lit(1e-9)))
    return out.drop("_e")


def scatter_table(
    cents: DataFrame, key: str, vec: str, meta: DataFrame, quality: DataFrame, suspects: bool = False
) -> DataFrame:
    """One point per card with display fields, flags and the class that is drawn."""
    points = min_max(pca_2d(cents, key, vec), ["pc1", "pc2"]).withColumnsRenamed({"pc1": "x", "pc2": "y"})
    fields = meta.select(key, "name", "set_code", "set_name", "cmc", "mana_cost")
    flags = ["suspect_overlap", "suspect_cluster_spread", "suspect_metadata_conflict"]
    joined = points.join(fields, key, "left").join(quality.select(key, *flags), key, "left")
    joined = joined.withColumns({f: F.coalesce(f, F.lit(0)) for f in flags})
    drawn = (
        F.when(F.col("suspect_overlap") != 0, "overlap").when(F.col("suspect_cluster_spread") != 0, "spread")
        .when(F.col("suspect_metadata_conflict") != 0, "meta").otherwise("normal")
    )
    out = joined.select(
        key, first_truthy(F.col("name"), F.col(key).cast("string")).alias("name"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("set_code", "set_name")], "cmc",
        F.coalesce("mana_cost", F.lit("")).alias("mana_cost"), "x", "y", *flags, drawn.alias("drawn_class"),
    )
    return out.where(F.col("drawn_class") != "normal") if suspects else out


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal bins, the last one closed, empty bins kept: (bin, low, high, n).

    Without bounds the range of the data is used (one bin width of 1 around a single value);
    with bounds, values outside are dropped.
    """
    v = F.col(value)
    if low is None:
        ends = df.agg(F.struct(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi")))
        same = F.col("_e.lo") == F.col("_e.hi")
        frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"), ends.scalar().alias("_e"))
        data = df.select(v.cast("double").alias("_v"), ends.scalar().alias("_e"))
        lo = F.when(same, F.col("_e.lo") - 0.5).otherwise(F.col("_e.lo"))
        hi = F.when(same, F.col("_e.hi") + 0.5).otherwise(F.col("_e.hi"))
    else:
        frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
        data = df.select(v.cast("double").alias("_v"))
        lo, hi = F.lit(float(low)), F.lit(float(high))
    inside = data.where(F.col("_v").between(lo, hi))
    pos = F.least(F.floor((F.col("_v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("bigint")
    counts = inside.groupBy(pos.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    return frame.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high")).join(
        counts, "bin", "left"
    ).select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def box_plot(df: DataFrame, value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR) and outlier count (one row)."""
    found = {r["p"]: r["quantile"] for r in exact_quantiles(df, value, [0.25, 0.5, 0.75]).collect()}
    q1, q2, q3 = (F.lit(found[p]).cast("double") for p in (0.25, 0.5, 0.75))
    v = F.col(value).cast("double")
    reach = (q3 - q1) * whisker
    inside = v.between(q1 - reach, q3 + reach)
    return df.agg(
        F.first(q1).alias("q1"), F.first(q2).alias("median"), F.first(q3).alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(v).alias("n"),
    )


def first_paths(listing: DataFrame, key: str, path: str, m: int) -> DataFrame:
    """W13 gallery: at most m paths per card in path order (m is the report's own limit)."""
    order = Window.partitionBy(key).orderBy(path)
    usable = listing.where(blank_to_null(F.col(path)).isNotNull()).select(key, path)
    return usable.withColumn("place", F.row_number().over(order)).where(F.col("place") <= m)
