"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes as they are, but for white space. Its n-gram counts are summed over all tasks and
joined, sharded by context, with the counts of their contexts; lower orders count continuations. It is fitted on three
quarters of all trusted documents and grows with the different strings of five bytes in them only, so that documents are
scored where they are. A document is rejected when its perplexity is above the quantile of the other quarter in its language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismcat.llm.common import arrow_batches, prepare, unused
from prismcat.session import materialise

ORDER = 5
SYMBOLS = 256
QUANTILE = 0.98
# Ids that are broadcast to pick the documents of the fit, at most; more are joined by a shuffle.
_FEW_IDS = 4_000_000
# Languages with fewer trusted documents outside the fit are judged by the quantile of all languages together.
MIN_TRUSTED = 30
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_STRETCH = 1 << 20
# n-grams that a task counts at once, and bins of a perplexity's logarithm.
_AT_ONCE = 1 << 21
_BINS = 1000
# Texts that a Python worker gets at once: 10,000 rows would hold some 20 MB of text several times over.
_BATCH = "2m"


def ngram_codes(text: bytes, order: int = ORDER) -> Iterator[np.ndarray]:
    """Codes of all n-grams that end at a byte of ``text`` (white space runs are one), in stretches."""
    carry = np.full(order - 1, 32, np.int64)
    for at in range(0, len(text), _STRETCH):
        symbols = np.concatenate([carry, np.frombuffer(_SPACES.sub(b" ", text[at : at + _STRETCH]), np.uint8)]).astype(np.int64)
        codes = symbols[order - 1 :].copy()
        for k in range(1, order):
            codes += symbols[order - 1 - k : len(symbols) - k] * SYMBOLS**k
        carry = symbols[len(symbols) - order + 1 :]
        yield codes


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["gram", "c"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task, in parts."""
    parts, held = [], 0
    for batch in batches:
        for text in batch.column("_text").to_pylist():
            for codes in ngram_codes(text or b""):
                parts.append(codes)
                held += len(codes)
                if held >= _AT_ONCE:
                    yield _counted(parts)
                    parts, held = [], 0
    if parts:
        yield _counted(parts)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> list[tuple[pd.DataFrame, pd.DataFrame]]:
    """Per order from 1: discounted shares of the seen n-grams (gram, share) and back-off weights (ctx, gamma).

    ``counts`` (gram, c) has a row for each different string of ``order`` bytes.
    """
    levels = []
    for k in range(order, 0, -1):
        n = [counts.filter(F.col("c") == i).count() for i in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        discount = [min(i, max(0.1, i - (i + 1) * y * n[i] / max(1, n[i - 1]))) for i in (1, 2, 3)]
        d = F.when(F.col("c") == 1, discount[0]).when(F.col("c") == 2, discount[1]).otherwise(discount[2])
        grams = counts.withColumn("ctx", F.expr(f"gram div {SYMBOLS}"))
        contexts = grams.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(d).alias("freed"))
        shares = grams.join(contexts, "ctx").select("gram", ((F.col("c") - d) / F.col("total")).alias("share"))
        contexts = contexts.select("ctx", (F.col("freed") / F.col("total")).alias("gamma"))
        levels.append((shares.toArrow().to_pandas(), contexts.toArrow().to_pandas()))
        if k > 1:  # continuations: how many different symbols come before
            counts = materialise(counts.groupBy(F.expr(f"gram % {SYMBOLS ** (k - 1)}").alias("gram")).agg(F.count(F.lit(1)).alias("c")), "quality-continuations")
    return levels[::-1]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` would stand in sorted ``keys``, and whether it does."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def log_probabilities(levels: list[tuple[pd.DataFrame, pd.DataFrame]]) -> list[tuple[np.ndarray, ...]]:
    """Per order from 1: sorted seen n-grams, log probabilities of their last symbols, sorted contexts, log back-off weights."""
    out, below = [], None
    for k, (shares, contexts) in enumerate(levels, 1):
        shares, contexts = shares.sort_values("gram"), contexts.sort_values("ctx")
        grams, ctx, gamma = shares["gram"].to_numpy(np.int64), contexts["ctx"].to_numpy(np.int64), contexts["gamma"].to_numpy(float)
        lower = 1.0 / SYMBOLS if k == 1 else below[_find(out[-1][0], grams % SYMBOLS ** (k - 1))[0]]
        below = shares["share"].to_numpy(float) + gamma[_find(ctx, grams // SYMBOLS)[0]] * lower
        out.append((grams, np.log(below), ctx, np.log(gamma)))
    return out


def log_likelihood(codes: np.ndarray, model: list[tuple[np.ndarray, ...]]) -> float:
    """Natural log probability of the last symbols of n-grams of the highest order."""
    total, left = 0.0, codes
    for k in range(len(model), 0, -1):
        grams, logs, ctx, gammas = model[k - 1]
        left = left % SYMBOLS**k
        at, seen = _find(grams, left)
        total += float(logs[at[seen]].sum())
        left = left[~seen]
        at, seen = _find(ctx, left // SYMBOLS)
        total += float(gammas[at[seen]].sum())
    return total - len(left) * float(np.log(SYMBOLS))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled as good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select(F.col(id_col).alias("_trusted")).dropna().distinct()


def trusted_sample(labels: DataFrame, id_col: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Ids that the model is fitted on: three quarters of the trusted ones, by a hash of the id; a ``limit`` leaves out more of them."""
    fit = trusted_ids(labels, id_col).filter(F.pmod(F.xxhash64("_trusted"), F.lit(4)) != 0)
    return fit if limit is None else fit.orderBy(F.xxhash64("_trusted"), "_trusted").limit(limit)


def perplexity_model(trusted: DataFrame) -> Callable[[Column], Column]:
    """Perplexity of a text column under a model of ``trusted`` texts (_text); NaN for texts without a symbol."""
    spark = trusted.sparkSession
    counted = trusted.select(F.coalesce("_text", F.lit("")).cast("binary").alias("_text")).mapInArrow(_count, "gram long, c long")
    counts = materialise(counted.groupBy("gram").agg(F.sum("c").alias("c")), "quality-counts")
    model = spark.sparkContext.broadcast(log_probabilities(kneser_ney(counts)))

    @F.pandas_udf("double")
    def perplexity(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), np.nan)
        for i, text in enumerate(texts):
            total, n = 0.0, 0
            for codes in ngram_codes((text or "").encode()):
                total += log_likelihood(codes, model.value)
                n += len(codes)
            if n:
                out[i] = np.exp(-total / n)
        return pd.Series(out)

    return lambda text: F.nanvl(perplexity(text), F.lit(None).cast("double"))


def quantiles(known: DataFrame, quantile: float) -> DataFrame:
    """``_of``, ``_q`` (exact, interpolated) and ``_n`` of the values ``_p`` of each ``_of``.

    Bins are counted; only the values of the bins that hold the quantile's ranks are sorted.
    """
    known = known.withColumn("_bin", F.floor(F.log("_p") * _BINS))
    bins = materialise(known.groupBy("_of", "_bin").agg(F.count(F.lit(1)).alias("n")), "quality-bins")
    of = Window.partitionBy("_of")
    before = of.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of).alias("_n"))
    placed = placed.withColumn("at", (F.col("_n") - 1) * F.lit(quantile))
    placed = placed.filter("before <= ceil(at) AND before + n > floor(at)").drop("n")
    rank = F.row_number().over(of.orderBy("_p")) - 1 + F.min("before").over(of)
    ranked = known.join(placed, ["_of", "_bin"]).withColumn("rank", rank)
    ends = ranked.groupBy("_of", "_n", "at").agg(F.max(F.expr("if(rank = floor(at), _p, NULL)")).alias("low"), F.max(F.expr("if(rank = ceil(at), _p, NULL)")).alias("high"))
    return ends.select("_of", F.expr("low + (high - low) * (at - floor(at))").alias("_q"), "_n")


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE, max_trusted: int | None = None, whole: bool = True,
) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with perplexity, threshold and whether it stays, and the names of these three columns.

    Without ``whole`` the rows have the id only, and are scored once.
    """
    prepare(docs.sparkSession)
    sample = materialise(trusted_sample(labels, limit=max_trusted), "quality-sample")
    of_fit = F.broadcast(sample) if sample.count() <= _FEW_IDS else sample
    fit = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(of_fit, F.col("_id") == F.col("_trusted"), "left_semi")
    with arrow_batches(docs.sparkSession, _BATCH):
        perplexity = perplexity_model(fit)
    names = tuple(unused(docs, c) for c in ("perplexity", "threshold", "keep"))
    of, q, empty = unused(docs, "_of"), unused(docs, "_q"), unused(docs, "_empty")
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    blank = F.length(F.coalesce(F.col(text_col), F.lit(""))) == 0
    with arrow_batches(docs.sparkSession, _BATCH):
        narrow = materialise(docs.select(F.col(id_col), lang.alias(of), blank.alias(empty), perplexity(F.col(text_col)).alias(names[0])), "quality-scores")
    # the quantiles are taken from all trusted documents that the model hasn't seen
    unseen = trusted_ids(labels).join(sample, "_trusted", "left_anti")
    known = narrow.select(F.col(id_col).alias("_id"), F.col(of).alias("_of"), F.col(names[0]).alias("_p")).filter("_p IS NOT NULL")
    known = materialise(known.join(unseen, F.col("_id") == F.col("_trusted"), "left_semi").select("_of", "_p"), "quality-known")
    overall = quantiles(known.select(F.lit("").alias("_of"), "_p"), quantile).first()
    overall = None if overall is None else overall["_q"]
    per_lang = materialise(quantiles(known, quantile).filter(F.col("_n") >= MIN_TRUSTED).select(F.col("_of").alias(of), F.col("_q").alias(q)), "quality-quantiles")
    scored = narrow
    if whole:
        scored = docs.select("*", lang.alias(of), blank.alias(empty), perplexity(F.col(text_col)).alias(names[0]))
    if overall is None:
        scored = scored.withColumn(names[0], F.lit(None).cast("double"))
    scored = scored.join(F.broadcast(per_lang), of, "left")  # a row for each language
    scored = scored.withColumn(names[1], F.coalesce(q, F.lit(overall).cast("double")))
    scored = scored.withColumn(names[2], ~F.col(empty) & F.coalesce(F.col(names[0]) <= F.col(names[1]), F.lit(True)))
    return scored.drop(of, q, empty), names


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: id, ``perplexity``, ``threshold``, ``keep``.

    Empty and NULL texts have no perplexity and are rejected. Without trusted documents to take a quantile
    from every other text stays. NULL is a language of its own. Rows with the same id are judged each by its own text; ties with
    the threshold stay; other columns don't matter.
    """
    scored, names = score(docs, labels, id_col, whole=False, **options)
    return scored.select(F.col(id_col), *(F.col(n).alias(a) for n, a in zip(names, ("perplexity", "threshold", "keep"), strict=True)))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged."""
    scored, names = score(docs, labels, **options)
    return scored.filter(F.col(names[2])).select(*docs.columns)
