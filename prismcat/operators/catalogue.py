"""Catalogue tables: flattening, upserts, lookups, resolution of inventory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.functions.columns import (
    IMAGE_VARIANTS, PRINT_LANGUAGES, blank_to_null, first_truthy, image_uri, language_allowed, to_number,
)
from prismcat.functions.vectors import unit
from prismcat.operators.groups import first_rows
from prismcat.operators.skew import lookup_join
from prismcat.schemas import CARDS, PRICE_KEYS, image_key


def flatten_cards(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed catalogue rows from raw records; records without an id are left out.

    ``keep`` names further columns to carry along.
    """
    renamed = {"id": "print_id", "oracle_id": "logical_id", "set": "set_code"}
    plain = [c for c in raw.columns if c not in ("prices", "card_faces", "_corrupt_record")]
    return (
        raw.where(blank_to_null(F.col("id")).isNotNull())
        .select(
            *[F.col(c).alias(renamed.get(c, c)) for c in plain],
            *[to_number(F.col("prices").getItem(k)).alias(f"price_{k}") for k in PRICE_KEYS],
        )
        .select(*CARDS.fieldNames(), *(keep or []))
    )


def rejected_cards(raw: DataFrame) -> DataFrame:
    """The records ``flatten_cards`` leaves out."""
    return raw.where(blank_to_null(F.col("id")).isNull())


def importable(raw: DataFrame, languages: list[str], variants: list[str] = IMAGE_VARIANTS) -> DataFrame:
    """Records in an allowed language that have an image; adds ``image_uri``.

    No languages: all are allowed. ``variants`` are the wanted image variants, best first.
    """
    return raw.withColumn("image_uri", image_uri(F.col("image_uris"), F.col("card_faces"), variants)).where(
        language_allowed(F.col("lang"), languages) & F.col("image_uri").isNotNull()
    )


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], latest: list[Column]) -> DataFrame:
    """New snapshot of ``target`` after the batch; the last row per key wins, others stay.

    ``latest`` orders the batch newest first. Columns only the batch has are added. Both sides of
    the anti join are unique per key, so no key can be hot in it.
    """
    newest = first_rows(batch, keys, latest)
    kept = target.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def load_statistics(target: DataFrame, batch: DataFrame, keys: list[str], errors: DataFrame | None = None) -> DataFrame:
    """Rows before, rows after, new keys, updated keys, rejected rows (one row)."""
    before = target.select(*keys, F.lit(1).alias("old"), F.lit(0).alias("new"))
    arriving = batch.select(*keys, F.lit(0).alias("old"), F.lit(1).alias("new"))
    per_key = before.unionByName(arriving).groupBy(*keys).agg(
        F.sum("old").alias("old"), F.max("new").alias("new")
    )
    stats = per_key.agg(
        F.coalesce(F.sum("old"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.greatest("old", "new")), F.lit(0)).alias("rows_after"),
        F.count_if((F.col("old") == 0) & (F.col("new") > 0)).alias("rows_new"),
        F.count_if((F.col("old") > 0) & (F.col("new") > 0)).alias("rows_updated"),
    )
    if errors is None:
        return stats.withColumn("errors", F.lit(0).cast("bigint"))
    return stats.withColumn("errors", errors.agg(F.count(F.lit(1))).scalar())


def image_rows(cards: DataFrame, path: Column, source: str, training: bool = True) -> DataFrame:
    """Image table rows, one per card row."""
    return cards.select(
        image_key(F.col("print_id"), path).alias("image_id"), "print_id", "logical_id",
        path.alias("file_path"), F.lit(source).alias("source"), F.col("lang").alias("language"),
        F.lit(training).alias("is_training"),
    )


def images_per_print(images: DataFrame) -> DataFrame:
    """One row per print: smallest path and its language."""
    best = F.min(F.struct("file_path", "language")).alias("_b")
    usable = images.where(blank_to_null(F.col("file_path")).isNotNull())
    return usable.groupBy("print_id").agg(best).select(
        "print_id", F.col("_b.file_path").alias("any_path"), F.col("_b.language").alias("any_language")
    )


def attach_print_and_image(rows: DataFrame, prints: DataFrame, paths: DataFrame, row_id: str, **skew) -> DataFrame:
    """Rows with a vector, left-joined with ``prints`` on print_id and ``paths`` on image_id.

    Many vectors share a (print, image) pair, so the pairs are looked up, not the vectors: both lookups
    run on narrow distinct rows, and the vectors themselves take part in a single join.
    """
    marked = rows.withColumn("_image", F.coalesce(F.col("image_id").cast("string"), F.lit("")))
    pairs = marked.select("print_id", "_image", "image_id").distinct()
    found = lookup_join(pairs, paths, ["image_id"], F.col("print_id"), count_on=rows, **skew).drop("image_id")
    found = lookup_join(found, prints, ["print_id"], F.col("_image"), count_on=rows, **skew)
    keys = ["print_id", "_image"]
    return lookup_join(marked, found, keys, F.col(row_id), count_on=marked, **skew).drop("_image")


def embeddings_with_meta(
    emb: DataFrame, images: DataFrame, cards: DataFrame, mode: str, **skew
) -> DataFrame:
    """Vectors of one mode with their image path and their card's fields, nothing dropped.

    The mode filter reaches the partitioned scan.
    """
    paths = images.select("image_id", "file_path", F.col("language").alias("image_language"))
    meta = cards.withColumnRenamed("logical_id", "card_logical_id")
    return attach_print_and_image(emb.where(F.col("mode") == mode), meta, paths, "emb_id", **skew)


def fill_missing_images(cards: DataFrame, images: DataFrame, path: str, language: str) -> DataFrame:
    """Cards without a path get one (the smallest) from the image table, with its language."""
    joined = cards.join(images_per_print(images), "print_id", "left")
    lacking = blank_to_null(F.col(path)).isNull()
    return joined.withColumns(
        {
            path: F.when(lacking, F.col("any_path")).otherwise(F.col(path)),
            language: F.when(lacking, first_truthy(F.col(language), F.col("any_language"))).otherwise(F.col(language)),
        }
    ).drop("any_path", "any_language")


def backfill_logical_id(rows: DataFrame, cards: DataFrame, row_id: str, **skew) -> DataFrame:
    """Own logical id, else the card's, else the print id."""
    lookup = cards.select("print_id", F.col("logical_id").alias("_card_logical"))
    joined = lookup_join(rows, lookup, ["print_id"], F.col(row_id), **skew)
    return joined.withColumn(
        "logical_id",
        first_truthy(F.col("logical_id"), F.col("_card_logical"), F.col("print_id").cast("string")),
    ).drop("_card_logical")


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that have at least one child."""
    return parents.join(children.select(key).distinct(), key, "left_semi")


def without_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without a child: the purge set, or the worklist of outputs still missing."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def search_rows(joined: DataFrame) -> DataFrame:
    """One row per vector with display fields and the normalised vector."""
    text = F.col("print_id").cast("string")
    return joined.select(
        "emb_id", "print_id", first_truthy(F.col("name"), text).alias("label"),
        first_truthy(F.col("logical_id"), F.col("card_logical_id"), text).alias("logical_id"),
        F.coalesce("set_code", F.lit("")).alias("set_code"),
        F.coalesce("collector_number", F.lit("")).alias("collector_number"),
        F.coalesce("file_path", F.lit("")).alias("image_path"),
        unit(F.col("emb")).alias("emb"),
    )


# --- inventory resolution -------------------------------------------------------------------


def resolve_inventory(inventory: DataFrame, cards: DataFrame, released: list[Column], **skew) -> DataFrame:
    """Each inventory row with the catalogue print it stands for.

    The first key a row has decides: print id, logical id, (name, set), name. Every catalogue lookup
    is reduced to one print per key value beforehand, so no join multiplies rows, and the rows look
    up in a single pass over a union of the four lookups.
    """
    def lookup(tier: int, *key: Column) -> DataFrame:
        usable = cards
        for k in key:
            usable = usable.where(blank_to_null(k.cast("string")).isNotNull())
        best = usable.groupBy(_key(*key).alias("_key")).agg(
            F.min(F.struct(*released, F.col("print_id"), F.col("logical_id"))).alias("_b")
        )
        return best.select(
            F.lit(tier).alias("tier"), "_key", F.col("_b.print_id").alias("resolved_print_id"),
            F.col("_b.logical_id").alias("resolved_logical_id"),
        )

    lookups = (
        lookup(1, F.col("print_id"))
        .unionByName(lookup(2, F.col("logical_id")))
        .unionByName(lookup(3, F.col("name"), F.col("set_code")))
        .unionByName(lookup(4, F.col("name")))
    )
    has = {c: blank_to_null(F.col(c).cast("string")).isNotNull() for c in ("print_id", "logical_id", "name", "set_code")}
    tier = (
        F.when(has["print_id"], 1).when(has["logical_id"], 2)
        .when(has["name"] & has["set_code"], 3).when(has["name"], 4)
    )
    wanted = (
        F.when(F.col("tier") == 1, _key(F.col("print_id")))
        .when(F.col("tier") == 2, _key(F.col("logical_id")))
        .when(F.col("tier") == 3, _key(F.col("name"), F.col("set_code")))
        .when(F.col("tier") == 4, _key(F.col("name")))
    )
    keyed = inventory.withColumn("tier", tier).withColumn("_key", wanted)
    return lookup_join(keyed, lookups, ["tier", "_key"], F.col("row_id"), **skew).drop("_key")


def _key(*parts: Column) -> Column:
    """Several values as one text key; the separator cannot occur in them."""
    return F.concat_ws("\u0001", *[p.cast("string") for p in parts])


def expand_prints(
    resolved: DataFrame, cards: DataFrame, has_image: Column, languages: list[str] = PRINT_LANGUAGES
) -> DataFrame:
    """All prints of the requested logical cards, each (print, language) once.

    A print belongs to the first inventory row that asks for its logical card, so requests are
    reduced to one row per logical card before the join and nothing fans out.
    """
    first = resolved.where(F.col("resolved_logical_id").isNotNull()).groupBy(
        F.col("resolved_logical_id").alias("logical_id")
    ).agg(F.min("row_id").alias("row_id"))
    usable = cards.where(language_allowed(F.col("lang"), languages) & has_image)
    joined = lookup_join(usable, first, ["logical_id"], F.col("print_id"), "inner")
    return first_rows(joined, ["print_id", "lang"], [F.col("row_id")])


def prints_per_row(resolved: DataFrame, prints: DataFrame) -> DataFrame:
    """Prints kept per resolved inventory row; rows whose prints were all taken earlier count 0."""
    kept = prints.groupBy("row_id").agg(F.count(F.lit(1)).alias("kept"))
    return resolved.where(F.col("resolved_print_id").isNotNull()).select("row_id").join(
        kept, "row_id", "left"
    ).select("row_id", F.coalesce("kept", F.lit(0)).alias("kept"))


def import_totals(per_row: DataFrame) -> DataFrame:
    """Inventory rows resolved and prints kept (one row)."""
    return per_row.agg(
        F.count(F.lit(1)).alias("cards_resolved"), F.coalesce(F.sum("kept"), F.lit(0)).alias("prints_kept")
    )
