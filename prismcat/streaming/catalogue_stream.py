"""Incremental ingest: new JSON-lines dumps are folded into the catalogue as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismcat.functions.columns import IMAGE_VARIANTS
from prismcat.operators.catalogue import flatten_cards, importable
from prismcat.schemas import CARD_RAW
from prismcat.sources.keyed import BUCKETS, upsert_keyed


def card_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of raw card records from a folder of JSON-lines files."""
    return (
        spark.readStream.schema(CARD_RAW).option("maxFilesPerTrigger", files_per_batch).json(folder)
        .withColumn("_source_file", F.col("_metadata.file_path"))
        .withColumn("_source_start", F.col("_metadata.file_block_start"))
    )


def fold_into_catalogue(
    raw: DataFrame, table: str, checkpoint: str, languages: list[str], variants: list[str] = IMAGE_VARIANTS, buckets: int = BUCKETS
) -> StreamingQuery:
    """Upsert every micro-batch into the keyed table; stops when all waiting files are done.

    A batch rewrites the buckets that its cards fall into, not the catalogue. Versions follow the batch number, so a
    batch that is replayed after a failure finds its own version already written and does nothing. Within a batch
    the last file wins, and within a file the last record.
    """
    place = ("_source_file", "_source_start", "_source_row")

    def fold(batch: DataFrame, number: int) -> None:
        # a split of a file is read in order by one task
        placed = batch.withColumn("_source_row", F.monotonically_increasing_id())
        flat = flatten_cards(importable(placed, languages, variants).drop("image_uri"), keep=list(place))
        upsert_keyed(flat, table, ["print_id"], [F.desc(c) for c in place], place, number + 1, buckets)

    return (
        raw.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
