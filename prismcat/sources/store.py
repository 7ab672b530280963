"""The embedding store and the quality table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismcat.functions.vectors import check_dim, has_dim
from prismcat.operators.catalogue import upsert


def decode_blob(blob: Column, dim: int) -> Column:
    """Little-endian float32 bytes to a vector; a wrong length is an error."""

    @F.arrow_udf("array<float>")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            known = pc.is_valid(batch).to_numpy(zero_copy_only=False)
            filled = pc.fill_null(batch, b"")
            sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False)
            wrong = sizes[known & (sizes != 4 * dim)]
            if len(wrong):
                raise ValueError(f"embedding has dimension {wrong[0] / 4:g}, expected {dim}")
            # the bytes of a batch are one stretch of memory, vector behind vector
            offsets = np.frombuffer(filled.buffers()[1], np.int32)[filled.offset : filled.offset + len(filled) + 1]
            data = filled.buffers()[2]
            flat = np.frombuffer(data[int(offsets[0]) : int(offsets[-1])], "<f4") if known.any() else np.empty(0, "<f4")
            ends = np.concatenate([[0], np.cumsum(np.where(known, dim, 0))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()), mask=pa.array(~known))

    return decode(blob)


def encode_blob(vec: Column) -> Column:
    """Vector to little-endian float32 bytes, for exchange with blob stores."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            ends = 4 * np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pc.if_else(pc.is_valid(batch), blobs, pa.scalar(None, pa.binary()))

    return encode(vec)


def dimension_rejects(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """P16 quarantine form: the rows whose vector does not have the stated dimension."""
    return df.where(~has_dim(F.col(vec), dim))


def replace_mode(df: DataFrame, path: str, mode: str, dim: int) -> None:
    """Replace every stored row of one mode, other modes stay.

    The rows go to a new version folder, which counts once it is complete: a failed write leaves the
    old rows in place. Writing zero rows clears the mode. Vectors are cast to float and checked
    against the dimension while they are written. A version is removed when a second one follows it.
    """
    emb = check_dim(F.col("emb").cast("array<float>"), dim).alias("emb")
    others = [F.col(c) for c in df.columns if c not in ("emb", "mode")]
    folder = f"{path}/mode={mode}"
    versions = _complete(df.sparkSession, folder, "version")
    number = versions[-1] + 1 if versions else 1
    df.select(*others, emb).write.mode("overwrite").parquet(f"{folder}/version={number:09d}")
    for old in versions[:-1]:
        _remove(df.sparkSession, f"{folder}/version={old:09d}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store with its ``mode`` column; a filter on it skips the other folders.

    Each mode is read with its own schema; a column that only some modes have is NULL in the others.
    """
    parts = []
    for mode in _children(spark, path, "mode"):
        versions = _complete(spark, f"{path}/mode={mode}", "version")
        if versions:
            rows = spark.read.parquet(f"{path}/mode={mode}/version={versions[-1]:09d}")
            parts.append(rows.withColumn("mode", F.lit(mode)))
    if not parts:
        raise FileNotFoundError(f"no embeddings in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's view of ``path``: (file system, path), whichever storage it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the ``key=value`` folders directly below ``path``, sorted."""
    system, at = _file_system(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{key}="))


def _complete(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers of the folders below ``path`` whose write has ended, ascending."""
    def ended(value: str) -> bool:
        system, at = _file_system(spark, f"{path}/{key}={value}/_SUCCESS")
        return system.exists(at)

    return sorted(int(v) for v in _children(spark, path, key) if ended(v))


def _remove(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def write_snapshot(df: DataFrame, path: str, snapshot: int) -> None:
    """Write one numbered snapshot; only the remains of a failed attempt are ever overwritten."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot:09d}")


def current_snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """Number and rows of the newest snapshot, None when nothing was written yet.

    Only that folder is read, under its own schema: columns that later snapshots added are there.
    """
    numbers = _complete(spark, path, "snapshot")
    if not numbers:
        return None
    return numbers[-1], spark.read.parquet(f"{path}/snapshot={numbers[-1]:09d}")


def expire_snapshots(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` snapshots; call it when no reader uses older ones."""
    if keep < 1:
        raise ValueError("keep at least one snapshot")
    for old in _complete(spark, path, "snapshot")[:-keep]:
        _remove(spark, f"{path}/snapshot={old:09d}")


def upsert_quality(quality: DataFrame, path: str, key: str = "group_id") -> DataFrame:
    """Insert or replace quality rows by key; cards that were not computed again stay.

    Readers see either the old or the new snapshot, never a table that is being rewritten.
    """
    spark = quality.sparkSession
    found = current_snapshot(spark, path)
    if found is None:
        number, merged = 1, quality
    else:
        number, merged = found[0] + 1, upsert(found[1], quality, [key], [F.col(key)])
    write_snapshot(merged, path, number)
    return current_snapshot(spark, path)[1]


def read_quality(df: DataFrame, info: str, schema: str | T.StructType, key: str = "group_id") -> DataFrame:
    """Quality rows with their JSON text parsed; broken or missing text gives an empty struct."""
    return df.withColumn(info, F.coalesce(F.from_json(F.col(info), schema), F.from_json(F.lit("{}"), schema))).orderBy(key)
