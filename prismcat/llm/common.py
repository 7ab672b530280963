"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.session import materialise, ship_packages

ROOT = Path(__file__).resolve().parents[2]


def prepare(spark: SparkSession) -> None:
    """Ship the packages to the executors, once per application."""
    ship_packages(spark, *(p for p in (ROOT / "prismcat", ROOT / "checks") if p.exists()))


@contextmanager
def arrow_batches(spark: SparkSession, limit: str) -> Iterator[None]:
    """Python workers get batches of about ``limit`` bytes from the jobs run inside; 64 MB is Spark's own limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(df: DataFrame, label: str, key: str = "_row") -> DataFrame:
    """``df`` with a unique row key, written once: later reads see the same keys whatever is lost."""
    return materialise(df.withColumn(key, F.monotonically_increasing_id()), label)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex64(value: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
