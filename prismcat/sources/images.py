"""Image folder scan."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.functions.columns import IMAGE_SUFFIXES
from prismcat.sources.files import list_files

_GLOB = "*.{" + ",".join([*IMAGE_SUFFIXES, *[s.upper() for s in IMAGE_SUFFIXES]]) + "}"
IMAGE_STRUCT = "origin string, height int, width int, nChannels int, mode int, data binary"

# Bytes of image files that one task reads for work that takes far longer than reading (augmentation, encoding).
SPLIT_BYTES = 8 << 20


@contextmanager
def image_splits(spark: SparkSession, split_bytes: int = SPLIT_BYTES) -> Iterator[None]:
    """Folder scans of the jobs run inside are dealt out by file size, ``split_bytes`` to a task, so no image is shuffled."""
    keys = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": str(split_bytes // 64)}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def only_images(listing: DataFrame) -> DataFrame:
    """The paths with an image suffix, in any case."""
    return listing.where(F.lower("path").rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + ")$"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the images directly in a folder; a missing folder is an empty listing."""
    try:
        return only_images(list_files(spark, folder).select("path"))
    except AnalysisException:
        return spark.createDataFrame([], "path string")


def read_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(decoded images, paths that could not be decoded)."""
    raw = spark.read.format("image").option("pathGlobFilter", _GLOB).load(folder).select("image.*")
    readable = F.col("height") > 0
    return raw.where(readable), raw.where(~readable).select(F.col("origin").alias("path"))
