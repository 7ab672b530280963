"""Scans of bulk JSON snapshots and inventory CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismcat.functions.columns import base_name, by_alias, normal_header
from prismcat.operators.numbering import with_global_index
from prismcat.schemas import CARD_RAW
from prismcat.sources.json_arrays import read_array_elements

_CORRUPT = "_corrupt_record"


def read_cards(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """Bulk card records; text that is no card object ends up in ``_corrupt_record``.

    ``array``: one JSON array per file, however it is laid out; big files are read by many tasks.
    ``array_lines``: an array written with one object per line, as bulk dumps often are, which saves a pass.
    ``lines``: JSON lines.
    """
    schema = T.StructType([*CARD_RAW.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    if layout == "lines":
        return spark.read.schema(schema).options(**options).json(path)
    if layout == "array":
        items = read_array_elements(spark, path)
    elif layout == "array_lines":
        body = F.regexp_replace(F.trim("value"), r"^\[|,$|\]$", "")
        items = spark.read.text(path).select(body.alias("item")).where(F.col("item") != "")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return items.select(F.from_json("item", schema, options).alias("c")).select("c.*")


def broken_records(raw: DataFrame) -> DataFrame:
    """What could not be read as a card."""
    return raw.where(F.col(_CORRUPT).isNotNull())


def latest_snapshots(paths: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Per dataset type the ``{type}-{stamp}.json`` whose name sorts last.

    ``paths`` is a listing with one ``path`` per file; see ``list_files``.
    """
    name = base_name(F.col("path"))
    named = paths.select(
        F.regexp_extract(name, r"^(.+?)-[^-]*\.json$", 1).alias("type"), name.alias("file_name"), "path"
    ).where(F.col("type") != "")
    if types:
        named = named.where(F.col("type").isin(*types))
    return named.groupBy("type").agg(
        F.max(F.struct("file_name", "path")).alias("_last")
    ).select("type", F.col("_last.file_name").alias("file_name"), F.col("_last.path").alias("path"))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """File listing (path, length); the content column is not selected, so no file is opened."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory CSV with any header spelling; headers become lower_snake_case.

    ``row_id`` numbers the rows in file order. A file without rows is an error.
    """
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    placed = df.toDF(*[normal_header(c) for c in df.columns]).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("_file"), F.col("_start"), F.col("_row")]
    return with_global_index(placed, order, "row_id").drop("_file", "_start", "_row")


def inventory_rows(df: DataFrame) -> DataFrame:
    """The four request fields of an inventory, whichever alias each one goes by."""
    lower = {normal_header(c): c for c in df.columns}
    named = df.select(*[F.col(f"`{old}`").alias(new) for new, old in lower.items()])
    extra = [F.col("row_id")] if "row_id" in named.columns else []
    # fixed values: the header spellings each request field goes by
    return named.select(
        *extra,
        by_alias(named, "scryfall_id", "print_id", "id").alias("print_id"),
        by_alias(named, "oracle_id", "logical_id").alias("logical_id"),
        by_alias(named, "name", "card_name").alias("name"),
        F.lower(by_alias(named, "set", "set_code", "setcode")).alias("set_code"),
    )
