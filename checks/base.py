"""Registration and the catalogue views over the test tables.

Column lists are shared text: Spark runs them through ``selectExpr``, the SQL check as a CTE.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.operators.groups import centroids
from prismcat.session import materialise, ship_packages

_ROOT = Path(__file__).resolve().parents[1]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator id, with the SQL that must give the same rows."""

    def register(fn):
        assert name not in QUERIES, name

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_packages(spark, _ROOT / "prismcat", _ROOT / "checks")
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


EMB = """vec_id AS emb_id, CAST(label*5 + vec_id%5 AS BIGINT) AS print_id,
 CASE WHEN vec_id%11=0 THEN NULL ELSE 'L' || CAST(label AS VARCHAR(20)) END AS logical_id,
 'L' || CAST(label AS VARCHAR(20)) AS group_id,
 CAST((label*5 + vec_id%5)*10 + vec_id%7 + 1 AS BIGINT) AS image_id,
 'analysis' AS mode, CAST(floor(vec_id/5) AS INT) AS aug_index, embedding AS emb"""

CARDS = """p_partkey AS print_id, 'L' || CAST(CAST(floor(p_partkey/5) AS BIGINT) AS VARCHAR(20)) AS logical_id,
 'N' || CAST(CAST(floor(p_partkey/5) AS BIGINT) AS VARCHAR(20)) || CASE WHEN p_partkey%17=0 THEN '_alt' ELSE '' END AS name,
 p_brand AS set_code, p_type AS type_line, 'Set ' || p_brand AS set_name, p_name AS oracle_text,
 CAST(p_partkey%300 AS VARCHAR(20)) AS collector_number,
 CASE p_partkey%3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang,
 CASE WHEN p_partkey%13=0 THEN NULL ELSE 'M' || CAST(CAST(floor(p_partkey/5) AS BIGINT)%3 AS VARCHAR(20)) END AS mana_cost,
 CAST(CAST(floor(p_partkey/5) AS BIGINT)%4 AS DOUBLE) AS cmc, p_retailprice AS price,
 '["C' || CAST(CAST(floor(p_partkey/5) AS BIGINT)%2 AS VARCHAR(20)) || '"]' AS colors,
 '["I' || CAST(CAST(floor(p_partkey/5) AS BIGINT)%3 AS VARCHAR(20)) || '"]' AS color_identity,
 CASE WHEN p_size%10=0 THEN NULL ELSE 'img/' || CAST(p_partkey AS VARCHAR(20)) || '.jpg' END AS image_uri"""

IMAGES = """CAST(l_partkey*10 + l_linenumber AS BIGINT) AS image_id, l_partkey AS print_id,
 'img/' || CAST(l_partkey AS VARCHAR(20)) || '_' || CAST(l_linenumber AS VARCHAR(20)) || '.jpg' AS file_path,
 CASE l_linenumber%2 WHEN 0 THEN 'en' ELSE 'de' END AS language"""

# CTEs for the SQL side.
V_EMB = f"v_emb AS (SELECT {EMB} FROM embeddings)"
V_CARDS = f"v_cards AS (SELECT {CARDS} FROM part)"
V_IMAGES = f"v_images AS (SELECT DISTINCT {IMAGES} FROM lineitem)"
# unit vectors, and L2-normalised centroids of them by print and by group, as lists
V_UNIT = V_EMB + """, v_unit AS (SELECT * EXCLUDE (emb), list_transform(emb::DOUBLE[], lambda x:
 x / greatest(sqrt(list_dot_product(emb::DOUBLE[], emb::DOUBLE[])), 1e-12)) AS u FROM v_emb)"""


def v_cent(key: str) -> str:
    """CTE v_cent(g, c, n): centroids by ``key``."""
    return V_UNIT + f""", v_dims AS (SELECT {key} AS g, i, avg(u[i]) v, count(*) n FROM v_unit, range(1, 65) t(i) GROUP BY ALL),
 v_mean AS (SELECT g, list(v ORDER BY i) m, min(n) n FROM v_dims GROUP BY g),
 v_cent AS (SELECT g, n, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS c FROM v_mean)"""


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(*_columns(EMB))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*_columns(CARDS))


def images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*_columns(IMAGES)).distinct()


def _columns(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def cents(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return materialise(centroids(emb(spark, sf), key, normalise_rows=True), f"cent-{key}")


def r6(column: str) -> Column:
    """Rounded output column under its own name."""
    return F.round(F.col(column), 6).alias(column)


def pixel_images(spark: SparkSession, sf: str) -> DataFrame:
    """One 8 x 8 colour image per stored vector, in the image source's layout.

    Dimension p gives the blue byte of pixel p, dimensions p+21 and p+42 (mod 64) green and red.
    """
    level = "cast(floor((greatest(-0.5D, least(0.5D, cast(e as double))) + 0.5D) * 255) as int)"
    # dealt out before there are pixels, as a folder scan deals out files
    t = table(spark, sf, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id").selectExpr(
        "vec_id", "label", f"transform(embedding, e -> {level}) AS v"
    )
    shifted = t.select(
        "vec_id", "label", "v", F.expr("concat(slice(v, 22, 43), slice(v, 1, 21))").alias("v21"),
        F.expr("concat(slice(v, 43, 22), slice(v, 1, 42))").alias("v42"),
    )
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    pixels = F.transform(
        F.arrays_zip("v", "v21", "v42"), lambda p: F.concat(two(p["v"]), two(p["v21"]), two(p["v42"]))
    )
    return shifted.select(
        F.expr("'img/S' || label || '_' || vec_id || '_en_P' || (label * 5 + vec_id % 5) || '.png'").alias("origin"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
        F.unhex(F.array_join(pixels, "")).alias("data"),
    )


# pixel table of the same images for the SQL side: (vec_id, y, x, b, g, r)
V_PIXELS = """v_lv AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda e:
 CAST(floor((greatest(-0.5, least(0.5, e)) + 0.5) * 255) AS INT)) AS v FROM embeddings),
 v_px AS (SELECT vec_id, label, p // 8 AS y, p % 8 AS x, v[p + 1] / 255.0 AS b, v[(p + 21) % 64 + 1] / 255.0 AS g,
 v[(p + 42) % 64 + 1] / 255.0 AS r FROM v_lv, range(0, 64) t(p))"""
ORIGIN_SQL = "'img/S' || label || '_' || vec_id || '_en_P' || (label * 5 + vec_id % 5) || '.png'"


def sql6(expr: str, name: str) -> str:
    """Rounded SQL output column; adding 0.0 turns a negative zero into zero."""
    return f"(round({expr}, 6) + 0.0) AS {name}"
