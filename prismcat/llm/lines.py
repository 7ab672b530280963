"""Line dedup on content-defined passages of lines.

A rolling hash runs over the hashes of every two neighbouring lines that aren't blank, so a seed depends on its
own lines only and insertions elsewhere don't move it. Seeds that occur more than once in the corpus are
fetched, compared byte by byte, and joined into runs; all places of a passage are removed but for the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import unused
from prismcat.session import materialise

_KEY = ["_id", "_sha"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _seeds(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every two neighbouring lines that aren't blank: ``first`` line, ``n_lines`` with the blank ones between, hash ``h``."""
    full = r"filter(transform(lines, (x, i) -> struct(i, if(x rlike '\\S', xxhash64(x), NULL) AS h)), f -> f.h IS NOT NULL)"
    hashed = docs.select(F.col(id_col).alias("_id"), _sha(F.col(text_col)).alias("_sha"), _lines(F.col(text_col)).alias("lines"))
    hashed = hashed.select(*_KEY, F.expr(full).alias("full"))
    rolled = "struct(a.i AS first, b.i - a.i + 1 AS n_lines, xxhash64(a.h, b.h) AS h)"
    pairs = f"zip_with(slice(full, 1, greatest(size(full) - 1, 0)), slice(full, 2, greatest(size(full) - 1, 0)), (a, b) -> {rolled})"
    return hashed.select(*_KEY, F.explode(F.expr(pairs)).alias("s")).select(*_KEY, "s.*")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Removals (``_id``, ``_sha``, ``removed``: line ranges, which may overlap) and the documents that had candidates (``_id``, ``_sha``, ``lines``)."""
    seeds = materialise(_seeds(docs, id_col, text_col), "line-seeds")
    same = ["h", "n_lines"]
    repeated = materialise(seeds.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "line-repeated")
    wanted = materialise(seeds.join(repeated.hint("merge"), same), "line-wanted")
    # a document is one row here: equal id and text; its candidates are at most its lines
    lists = wanted.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "n_lines", "h")).alias("wanted"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_sha", _sha(F.col("_text")))
    found = texts.alias("t").join(lists.hint("merge").alias("l"), F.col("t._sha").eqNullSafe(F.col("l._sha")) & F.col("t._id").eqNullSafe(F.col("l._id")))
    fetched = materialise(found.select("t._id", "t._sha", _lines(F.col("_text")).alias("lines"), "wanted").dropDuplicates(_KEY), "line-fetched")
    passage = "transform(wanted, w -> struct(w.first, w.n_lines, w.h, array_join(slice(lines, w.first + 1, w.n_lines), '\n') AS passage))"
    members = fetched.select(*_KEY, F.explode(F.expr(passage)).alias("w")).select(*_KEY, "w.*")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_sha", "first")
    firsts = materialise(members.groupBy("h", "passage").agg(F.min(place).alias("kept")), "line-firsts")
    # the join compares the passages' bytes; Spark splits the side of a very frequent one
    extra = members.join(firsts.hint("merge"), ["h", "passage"]).filter(~place.eqNullSafe(F.col("kept")))
    extra = materialise(extra.select(*_KEY, "first", "n_lines"), "line-extra")
    return extra.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "n_lines")).alias("removed")), fetched


def _left(lines: Column, removed: Column) -> Column:
    """The lines outside the removed ranges."""
    gone = F.flatten(F.transform(removed, lambda r: F.sequence(r["first"], r["first"] + r["n_lines"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(stay, lambda i: F.get(lines, i))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_removed`` (lines), ``kept_sha256`` of what is left.

    Of any two or more lines that stand together elsewhere, blank ones not counted, the place with the
    smallest id stays (NULL ids last). Where passages overlap, each is judged by itself, so the first place of
    one can lose lines to another that stands before it; the first place of a line never goes. Rows equal in id
    and text are one document and judged alike. NULL text counts as empty, which is one blank line; blank lines
    go only between lines that go. Other columns don't matter.
    """
    removals, fetched = repeated_passages(docs, id_col, text_col)
    cut = fetched.join(removals, F.expr("true") & fetched["_sha"].eqNullSafe(removals["_sha"]) & fetched["_id"].eqNullSafe(removals["_id"]))
    rest = _left(fetched["lines"], F.col("removed"))
    changed = materialise(cut.select(fetched["_id"].alias("c_id"), fetched["_sha"].alias("c_sha"), F.size(rest).alias("n_left"), F.sha2(F.array_join(rest, "\n").cast("binary"), 256).alias("kept")), "line-changed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), _sha(text).alias("_sha"), F.size(_lines(text)).alias("n_lines"))
    out = base.join(changed.hint("merge"), F.col("_sha").eqNullSafe(F.col("c_sha")) & F.col("_id").eqNullSafe(F.col("c_id")), "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.col("n_lines") - F.col("n_left"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept", F.lower(F.hex("_sha"))).alias("kept_sha256"),
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False,
) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; rows without one stay exactly as they are.

    With ``drop_emptied``, rows whose last line that isn't blank was removed go.
    """
    cut_id, cut_sha, cut_lines, was_cut = (unused(docs, c) for c in ("_cut_id", "_cut_sha", "_cut_lines", "_cut"))
    removals, _ = repeated_passages(docs, id_col, text_col)
    removals = removals.select(F.col("_id").alias(cut_id), F.col("_sha").alias(cut_sha), F.col("removed").alias(cut_lines))
    joined = docs.join(removals.hint("merge"), _sha(F.col(text_col)).eqNullSafe(F.col(cut_sha)) & F.col(id_col).eqNullSafe(F.col(cut_id)), "left")
    cut = F.col(cut_lines).isNotNull()
    text = F.when(cut, F.array_join(_left(_lines(F.col(text_col)), F.col(cut_lines)), "\n")).otherwise(F.col(text_col))
    out = joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), cut.alias(was_cut))
    if drop_emptied:
        out = out.filter(~F.col(was_cut) | (F.trim(F.regexp_replace(F.col(text_col), r"\s+", " ")) != ""))
    return out.drop(was_cut)
