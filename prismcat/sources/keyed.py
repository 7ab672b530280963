"""A table with one row per key in which a batch rewrites only the buckets its keys fall into.

Rows lie in ``data/version=V/bucket=B``, the bucket being a hash of the key. ``manifest/version=V`` names for every
bucket the version that holds its rows. A version counts once its manifest is complete, so a batch that fails half-way
leaves the table as it was, and one that is replayed overwrites only its own remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.operators.catalogue import upsert
from prismcat.session import materialise
from prismcat.sources.store import _children, _complete, _remove

# Buckets of a new table; a bucket should be some hundred MB, so choose more for a big one.
BUCKETS = 64


def last_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version, 0 when there is none."""
    return max(_complete(spark, f"{path}/manifest", "version"), default=0)


def _manifest(spark: SparkSession, path: str, version: int) -> tuple[int, dict[int, int]]:
    """(number of buckets, version of each bucket that has rows); at most a row per bucket."""
    rows = spark.read.parquet(f"{path}/manifest/version={version:09d}").collect()
    return rows[0]["buckets"], {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}


def _read(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/version={v:09d}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.option("mergeSchema", len(set(held.values())) > 1).parquet(*folders)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; columns that later batches added are NULL in buckets which weren't written since."""
    version = last_version(spark, path)
    held = _manifest(spark, path, version)[1] if version else {}
    if not held:
        raise FileNotFoundError(f"no rows in {path}")
    return _read(spark, path, held)


def upsert_keyed(
    batch: DataFrame, path: str, keys: list[str], latest: list[Column], drop: tuple[str, ...] = (), version: int | None = None, buckets: int = BUCKETS,
) -> int:
    """Fold a batch into the table and return the version that holds it.

    The last row per key wins (``latest`` orders newest first, ``drop`` names columns that only serve for that), others
    stay. Buckets without a key of the batch aren't read. ``version`` makes a replay safe: a version that is there
    already is not written again. ``buckets`` counts for a new table only.
    """
    spark = batch.sparkSession
    last = last_version(spark, path)
    number = last + 1 if version is None else version
    if number <= last:
        return last
    held: dict[int, int] = {}
    if last:
        buckets, held = _manifest(spark, path, last)
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int").alias("bucket")
    arriving = materialise(batch.select("*", bucket), "keyed-batch")
    touched = sorted(r["bucket"] for r in arriving.select("bucket").distinct().collect())  # at most one per bucket
    old = {b: held[b] for b in touched if b in held}
    target = _read(spark, path, old).select("*", bucket) if old else spark.createDataFrame([], arriving.drop(*drop).schema)
    merged = upsert(target, arriving, ["bucket", *keys], latest).drop(*drop)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number:09d}")
    held |= dict.fromkeys(touched, number)
    rows = [(buckets, b, v) for b, v in sorted(held.items())] or [(buckets, None, None)]
    manifest = spark.createDataFrame(rows, "buckets int, bucket int, version long").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/version={number:09d}")
    return number


def expire_versions(spark: SparkSession, path: str) -> None:
    """Remove folders that the newest version doesn't use; call it when no reader uses an older one."""
    last = last_version(spark, path)
    held = _manifest(spark, path, last)[1] if last else {}
    for version in map(int, _children(spark, f"{path}/data", "version")):
        if version <= last:
            for b in map(int, _children(spark, f"{path}/data/version={version:09d}", "bucket")):
                if held.get(b) != version:
                    _remove(spark, f"{path}/data/version={version:09d}/bucket={b}")
    for old in _complete(spark, f"{path}/manifest", "version")[:-1]:
        _remove(spark, f"{path}/manifest/version={old:09d}")
