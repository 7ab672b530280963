"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more rows than one piece should, and is cut into pieces of that many.
MIN_HOT_ROWS = 200_000
# Most hot keys that are looked for; the others are below 1/MAX_HOT of the rows. A broadcast row for each (16 bytes).
MAX_HOT = 50_000
# Counters of the frequent-items sketch; its error stays well below 1/MAX_HOT of the rows.
_TRACKED = 500_000


def key_hash(keys: list[str]) -> Column:
    """Hash of a join key; NULLs hash like any other value."""
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = MIN_HOT_ROWS) -> dict[int, int]:
    """Hash of every hot key -> number of pieces to split it into, of about ``min_rows`` each.

    One pass over the key columns with a frequent-items sketch: tasks send their counters, no key is
    shuffled, and at most MAX_HOT entries come back. Finding one key too many or too few changes the
    balance of a join, never its result.
    """
    found = df.select(key_hash(keys).alias("_h")).agg(F.expr(f"approx_top_k(_h, {MAX_HOT}, {_TRACKED})").alias("top")).select(
        F.filter("top", lambda t: t["count"] > min_rows).alias("top")
    ).head()
    return {r["item"]: -(-r["count"] // min_rows) for r in found["top"] or []}


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: Column,
    how: str = "left",
    min_rows: int = MIN_HOT_ROWS,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of a large table with a table that has one row per key.

    Hot keys of ``facts`` (NULL included) are cut into pieces by the hash of ``spread_by``; the
    matching lookup rows are repeated once per piece. Without hot keys it is a plain join, which
    Catalyst turns into a broadcast join when the lookup side is small. ``count_on`` names a cheaper
    table with the same key distribution to look for hot keys in (say, the scan below a join).
    """
    # both sides must hash alike, so the keys get one type
    lookup = lookup.withColumns({k: F.col(k).cast(facts.schema[k].dataType) for k in keys})
    hot = hot_keys(facts if count_on is None else count_on, keys, min_rows)
    if not hot:
        return facts.join(lookup, keys, how)
    # at most MAX_HOT rows; the helper columns have names that neither side has, as keys may be called anything
    of, item, parts, salt = (_unused(name, facts, lookup) for name in ("_of", "_hot", "_pieces", "_salt"))
    pieces = F.broadcast(facts.sparkSession.createDataFrame(list(hot.items()), f"{item} bigint, {parts} int"))

    def with_pieces(side: DataFrame) -> DataFrame:
        return side.withColumn(of, key_hash(keys)).join(pieces, F.col(of) == F.col(item), "left").withColumn(parts, F.coalesce(parts, F.lit(1)))

    left = with_pieces(facts).withColumn(salt, F.pmod(F.xxhash64(spread_by), F.col(parts)).cast("int")).drop(of, item, parts)
    right = with_pieces(lookup).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(of, item, parts)
    return left.join(right, [*keys, salt], how).drop(salt)


def _unused(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no table has such a column; Spark doesn't tell upper from lower case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
