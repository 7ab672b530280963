"""Report sinks: CSV, JSON summary, aligned TSV pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.functions.columns import fixed_decimals, tsv_text
from prismcat.operators.numbering import with_global_index

# Metadata columns of the projector export, in file order.
TSV_COLUMNS = ["name", "set_code", "collector_number", "print_id"]


def write_csv_report(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    """The report rows with a header and the chosen delimiter."""
    rows.write.mode("overwrite").option("header", True).option("sep", delimiter).option("emptyValue", "").csv(path)


def write_json_summary(document: DataFrame, path: str) -> None:
    """The one-row summary as a JSON document."""
    document.coalesce(1).write.mode("overwrite").json(path)


def projector_lines(rows: DataFrame, order: list, vec: str = "emb", limit: int | None = None) -> DataFrame:
    """One row per vector with its line number and both text lines; NULL vectors are left out."""
    usable = rows.where(F.col(vec).isNotNull())
    if limit:
        usable = usable.orderBy(*order).limit(limit)
    numbered = with_global_index(usable, order, "line")
    numbers = F.transform(F.col(vec).cast("array<double>"), lambda x: fixed_decimals(x, 8))
    return numbered.select(
        "line", F.array_join(numbers, "\t").alias("vector_line"),
        F.concat_ws("\t", *[tsv_text(F.col(c).cast("string")) for c in TSV_COLUMNS]).alias("metadata_line"),
    )


def write_projector(lines: DataFrame, folder: str) -> None:
    """Text folders ``file=vectors`` and ``file=metadata``, the latter with a header line.

    One job writes both: a task holds a range of line numbers and writes its lines to either file, so parts of one
    number hold the same lines, and both files count together or not at all. In part order the lines align.
    """
    header = lines.sparkSession.createDataFrame([(-1, "metadata", "\t".join(TSV_COLUMNS))], "line bigint, file string, value string")
    twin = F.explode(F.array(*[
        F.struct(F.lit(name).alias("file"), F.col(column).alias("value")) for name, column in (("vectors", "vector_line"), ("metadata", "metadata_line"))
    ]))
    both = lines.select("line", twin.alias("t")).select("line", "t.*").unionByName(header)
    ordered = both.repartitionByRange("line").sortWithinPartitions("file", "line")
    ordered.select("file", "value").write.mode("overwrite").partitionBy("file").text(folder)


def read_projector(spark: SparkSession, folder: str) -> DataFrame:
    """(line, vector_line, metadata_line) of two files written by ``write_projector``, matched line by line.

    The header is line -1 and has no vector; a line that only one file has is NULL in the other.
    """

    def numbered(name: str, start: int) -> DataFrame:
        placed = spark.read.text(f"{folder}/file={name}").select(
            F.col("value").alias(f"{name}_value"), F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("_part"),
            F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"),
        )
        order = [F.col("_part"), F.col("_start"), F.col("_row")]
        return with_global_index(placed, order, "line", start).drop("_part", "_start", "_row")

    both = numbered("vectors", 0).join(numbered("metadata", -1), "line", "full")
    return both.select("line", F.col("vectors_value").alias("vector_line"), F.col("metadata_value").alias("metadata_line"))
