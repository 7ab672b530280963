"""Benchmark decontamination with a broadcast hash set of normalised benchmark n-grams.

Words are cut and hashed inside the JVM. Every window of a document is hashed and looked up in the
set of the benchmark's windows; hits are verified word by word. Only hits are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm.common import lower_ascii, numbered, unused
from prismcat.operators.skew import lookup_join
from prismcat.session import materialise

WINDOW = 10
# Most windows, and bytes of their rows, that one round broadcasts.
ROUND_WINDOWS = 1_000_000
ROUND_BYTES = 256 << 20
# Words of a long document that are scanned in one row.
STRETCH = 4096
# The complement of [\x00-\x2F\x3A-\x60\x7B-\x7F], as ranges: Java reads these ten times as fast as the negated class.
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
# The same words where A-Z are not lower-cased yet.
_CASED = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, runs of letters, digits and everything beyond ASCII."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def benchmark_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (number ``w``, hash ``h``, length ``n``, words ``gram``), and the items (``w``, ``item``) they are from.

    A window that very many items share is one row of the first table and spread rows of the second.
    """
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    grams = F.explode(F.expr("transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))"))
    placed = materialise(items.select("item", "n", grams.alias("gram")).distinct(), "leak-grams")
    windows = numbered(placed.select(F.xxhash64("gram").alias("h"), "n", "gram").distinct(), "leak-windows", "w")
    owned = lookup_join(placed.filter("item IS NOT NULL"), windows.select("w", "n", "gram"), ["n", "gram"], F.col("item"), "inner")
    return windows, materialise(owned.select("w", "item"), "leak-owners")


def _round_hits(texts: DataFrame, windows: DataFrame, lengths: list[int], text_col: str, stretch: int) -> DataFrame:
    """Verified hits of one round's windows, found where the texts lie."""
    reach = stretch + max(lengths) - 1
    cut = texts.select("_row", words(F.col(text_col)).alias("words")).select(
        "_row", F.posexplode(F.expr(f"transform(sequence(0, greatest(size(words) - 1, 0), {stretch}), s -> slice(words, s + 1, {reach}))")).alias("part", "s")
    )
    sized = cut.select("*", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("length")).filter("size(s) >= length")
    starts = f"sequence(1, least(size(s) - length + 1, {stretch}))"
    probes = sized.select("_row", "part", "s", "length", F.posexplode(F.expr(f"transform({starts}, i -> xxhash64(slice(s, i, length)))")).alias("i", "h"))
    # no equalities, so that the join's key is the hash alone and words are compared for its hits only
    same = "n <= length AND n >= length AND forall(zip_with(gram, slice(s, i + 1, length), (a, b) -> a <=> b), x -> x)"
    found = probes.join(F.broadcast(windows), "h").filter(same)
    return found.select("_row", (F.col("part").cast("long") * stretch + F.col("i")).alias("at"), "n", "w")


def find_hits(
    texts: DataFrame, windows: DataFrame, text_col: str = "_text", stretch: int = STRETCH,
    round_windows: int = ROUND_WINDOWS, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``_row``, ``at`` (word position from 0), ``n``, ``w`` (number of the window) of each verified window in ``texts``.

    The windows come in rounds of at most about ``round_windows`` and ``round_bytes``, each broadcast by itself,
    so no word of a text is ever shuffled whatever the benchmark's size; a round's hits are written before the next.
    Long documents are scanned in stretches that overlap by one word less than the longest window;
    a window belongs to the stretch it starts in.
    """
    weight = F.expr("aggregate(gram, 64L, (b, x) -> b + octet_length(x) + 16)")
    size = windows.agg(F.collect_set("n").alias("lengths"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("b")).head()
    if not size.n:
        return texts.sparkSession.createDataFrame([], "_row long, at long, n int, w long")
    rounds = max(math.ceil(size.n / round_windows), math.ceil(size.b / round_bytes))
    parts = (windows.filter(F.pmod(F.xxhash64("w"), F.lit(rounds)) == r) for r in range(rounds))
    # at most WINDOW different lengths
    hits = [materialise(_round_hits(texts, part, size.lengths, text_col, stretch), "leak-hits") for part in parts]
    return reduce(DataFrame.unionByName, hits)


def covered_words(hits: DataFrame) -> DataFrame:
    """Words inside any hit, per ``_row``: window ends run along the sorted starts, nothing is gathered."""
    starts = hits.groupBy("_row", "at").agg((F.col("at") + F.max("n")).alias("end"))
    before = Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.col("at"))), F.lit(0))
    return starts.select("_row", fresh.alias("fresh")).groupBy("_row").agg(F.sum("fresh").cast("long").alias("n_hit"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    NULL and empty texts have no words and no hits; an item without words is left out, one of fewer words
    than a window is a window of its own. Items of one id count once; an item without id marks words but
    is not counted. Repeated rows are documents of their own. Other columns don't matter.
    """
    texts = numbered(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .withColumn("n_words", F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(_CASED)).cast("long")),
        "leak-texts",
    )
    windows, owners = benchmark_windows(benchmark, item_col, item_text, window)
    hits = find_hits(texts, windows)
    met = hits.select("_row", "w").distinct()
    items = lookup_join(met, owners, ["w"], F.col("_row"), "inner").select("_row", "item").distinct().groupBy("_row").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item").cast("string"))), ",").alias("list")
    )
    found = materialise(covered_words(hits).join(items, "_row", "left"), "leak-found")
    out = texts.select("_row", "_id", "n_words").join(found, "_row", "left")
    return out.select(
        F.col("_id").alias(id_col), "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, remove: str = "documents",
) -> DataFrame:
    """``docs`` without contaminated rows, or (``remove="spans"``) with the hit words cut out of their texts.

    Separators stay. Rows without a hit stay exactly as they are.
    """
    key, spans_col, pattern = (unused(docs, c) for c in ("_row", "_spans", "_pattern"))
    kept_docs = numbered(docs, "leak-docs", key)
    windows, _ = benchmark_windows(benchmark, item_col, item_text, window)
    hits = find_hits(kept_docs.select(F.col(key).alias("_row"), F.col(text_col).alias("_text")), windows).withColumnRenamed("_row", key)
    if remove == "documents":
        return kept_docs.join(hits.select(key).distinct(), key, "left_anti").select(*docs.columns)
    spans = hits.groupBy(key).agg(F.collect_set(F.struct("at", "n")).alias(spans_col))
    text = f"coalesce(`{text_col}`, '')"
    kept = F.expr(
        f"array_join(transform(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (sep, w) -> struct(sep, w)),"
        f" (p, i) -> if(exists({spans_col}, s -> i >= s.at AND i < s.at + s.n), coalesce(p.sep, ''), concat(p.sep, coalesce(p.w, '')))), '')"
    )
    out = kept_docs.join(spans, key, "left").withColumn(pattern, F.lit(_CASED))
    return out.withColumn(text_col, F.when(F.col(spans_col).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
