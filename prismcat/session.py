"""Shared-folder handling: where intermediate tables go so that lineage can be cut safely."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
# Folders of local sessions that name none, by application id.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder of its own.
    """
    named = spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _own_dirs.setdefault(app, _own_dirs.get(app) or tempfile.mkdtemp(prefix="prismcat-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; never reused, so a retry cannot read half a table."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several jobs, or where row order / partition ids must not change
    when an executor is lost. Parquet keeps column pruning and gives Catalyst real sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_packages(spark: SparkSession, *packages: str | Path) -> None:
    """Make package folders importable in the Python workers, once per application.

    The same as submitting them with ``--py-files``: Spark copies the archive from the driver to
    every executor.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="prismcat-py-")) / "prismcat_packages.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for folder in map(Path, packages):
            for file in sorted(folder.rglob("*.py")):
                out.write(file, Path(folder.name) / file.relative_to(folder))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
