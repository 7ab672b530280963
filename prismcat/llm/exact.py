"""Exact dedup by composable polynomial fingerprints.

A text is cut into segments. Each segment is hashed as a polynomial in its bytes modulo two primes; the
hash of a document is the sum of its segments' hashes, each shifted by the number of bytes that follow
it, so segments of a huge document are hashed in different tasks and meet in an ordinary sum. Rows of
equal length and fingerprint are then compared with their group's representative, segment by segment;
whatever differs forms new groups until none does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import numbered, prepare
from prismcat.session import materialise

MODULI = (2147483647, 2147483629)
BASES = (1_000_003, 998_244_353)
SEGMENT = 1 << 16
_CHUNK = 1024


def _powers(base: int, modulus: int, step: int, n: int) -> np.ndarray:
    """base**(step*i) mod modulus for i = 0 .. n-1."""
    factor, out, value = pow(base, step, modulus), np.empty(n, np.int64), 1
    for i in range(n):
        out[i] = value
        value = value * factor % modulus
    return out


def segment_hashes(segments: list[bytes], moduli: tuple[int, ...] = MODULI) -> np.ndarray:
    """(len(segments), len(moduli)) polynomial hashes; an empty segment has 0.

    Segments are padded with leading zero bytes, which add nothing, to whole chunks; all chunks of a
    batch are hashed by one matrix product (exact: below 2**53) and combined per segment.
    """
    out = np.zeros((len(segments), len(moduli)), np.int64)
    n_chunks = np.array([-(-len(s) // _CHUNK) for s in segments], np.int64)
    weights = np.stack([_powers(b, p, 1, _CHUNK)[::-1] for b, p in zip(BASES, moduli, strict=False)], 1).astype(np.float64)
    shifts = [_powers(b, p, _CHUNK, int(n_chunks.max(initial=1)) or 1) for b, p in zip(BASES, moduli, strict=False)]
    first = 0
    while first < len(segments):
        last, size = first, 0
        while last < len(segments) and (size == 0 or size + n_chunks[last] <= 4096):
            size += int(n_chunks[last])
            last += 1
        if size:
            block = b"".join(bytes(-len(s) % _CHUNK) + s for s in segments[first:last])
            chunks = (np.frombuffer(block, np.uint8).reshape(-1, _CHUNK).astype(np.float64) @ weights).astype(np.int64)
            counts = n_chunks[first:last]
            filled = np.flatnonzero(counts)
            counts = counts[filled]
            starts = np.cumsum(counts) - counts
            after = np.repeat(starts + counts - 1, counts) - np.arange(size)  # chunks that follow in the segment
            for j, p in enumerate(moduli):
                out[first + filled, j] = np.add.reduceat(chunks[:, j] % p * shifts[j][after] % p, starts) % p
        first = last
    return out


def _hash_batches(moduli: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = segment_hashes(batch.column("bytes").to_pylist(), moduli)
            after = batch.column("after").to_pylist()
            parts = [
                np.array([h * pow(BASES[j], a, p) % p for h, a in zip(hashes[:, j].tolist(), after, strict=True)], np.int64)
                for j, p in enumerate(moduli)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *map(pa.array, parts)], ["_row", "h1", "h2"])

    return run


def _segments(texts: DataFrame, segment: int, *keep: str) -> DataFrame:
    """One row per segment: ``seg``, its ``bytes`` and how many bytes come ``after`` it; empty texts have one."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(segment).cast("long"))
    cut = texts.select(*keep, "n_bytes", "_bytes", F.posexplode(starts).alias("seg", "start"))
    return cut.select(
        *keep, "seg",
        F.expr(f"substring(_bytes, cast(start as int) + 1, {segment})").alias("bytes"),
        F.greatest(F.col("n_bytes") - F.col("start") - segment, F.lit(0)).alias("after"),
    )


def fingerprints(texts: DataFrame, segment: int = SEGMENT, moduli: tuple[int, ...] = MODULI) -> DataFrame:
    """``_row``, ``h1``, ``h2`` of each row of ``texts`` (_row, _bytes, n_bytes).

    Segments of texts with more than one are dealt out to all tasks before they are hashed.
    """
    single = _segments(texts.filter(F.col("n_bytes") <= segment), segment, "_row")
    several = _segments(texts.filter(F.col("n_bytes") > segment), segment, "_row").repartition("_row", "seg")
    hashed = single.unionByName(several).select("_row", "bytes", "after").mapInArrow(
        _hash_batches(moduli), "_row long, h1 long, h2 long"
    )
    return hashed.groupBy("_row").agg(*(F.pmod(F.sum(h), F.lit(p)).alias(h) for h, p in zip(("h1", "h2"), moduli, strict=True)))


def _differing(members: DataFrame, texts: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """Members (with ``_keep``) that equal their representative, and those that don't."""
    # the same join at every size: members are too many to broadcast on large tables
    fetched = materialise(texts.select("_row", "_bytes").join(members.hint("merge"), "_row"), "exact-members")
    pieces = _segments(fetched, segment, "_row", "_keep")
    kept = pieces.filter(F.col("_row") == F.col("_keep")).select("_keep", "seg", F.col("bytes").alias("kept_bytes"))
    compared = pieces.join(kept, ["_keep", "seg"]).groupBy("_row").agg(F.min((F.col("bytes") == F.col("kept_bytes")).cast("int")).alias("equal"))
    judged = materialise(members.join(compared, "_row"), "exact-judged")
    return judged.filter("equal = 1").drop("equal"), judged.filter("equal = 0").drop("equal", "_keep", "keep_id")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
    segment: int = SEGMENT, moduli: tuple[int, int] = MODULI,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal (normalised) texts the row with the largest id stays; NULL ids come last, and of rows
    repeated with one id one stays. NULL text counts as empty, empty texts equal each other. Other
    columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    texts = numbered(
        docs.select(F.col(id_col).alias("_id"), text.cast("binary").alias("_bytes"))
        .select("_id", "_bytes", F.octet_length("_bytes").cast("long").alias("n_bytes"), F.sha2("_bytes", 256).alias("text_sha256")),
        "exact-texts",
    )
    facts = materialise(texts.drop("_bytes").join(fingerprints(texts, segment, moduli), "_row"), "exact-facts")
    rest, confirmed = facts.drop("text_sha256"), []
    key = ["n_bytes", "h1", "h2"]
    while True:
        groups = rest.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_id", "_row")).alias("top"))
        groups = groups.filter("n > 1" if not confirmed else "n > 0").select(*key, F.col("top._row").alias("_keep"), F.col("top._id").alias("keep_id"))
        # written first, so that the join below reads two plain shuffles, of which Spark splits the skewed side
        groups = materialise(groups, "exact-groups")
        equal, rest = _differing(materialise(rest.join(groups, key), "exact-grouped"), texts, segment)
        confirmed.append(equal.select("_row", "_keep", "keep_id"))
        if rest.isEmpty():
            break
    same = confirmed[0]
    for more in confirmed[1:]:
        same = same.unionByName(more)
    sizes = same.groupBy("_keep").agg(F.count(F.lit(1)).alias("group_size"))
    same = materialise(same.join(sizes, "_keep"), "exact-same")
    out = facts.select("_row", F.col("_id"), "text_sha256").join(same, "_row", "left")
    alone = F.col("_keep").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("_keep") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )
