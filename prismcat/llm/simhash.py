"""SimHash near-dedup with a generalised pigeonhole search.

Correlated fingerprint bits are grouped into the same part. For every distinct fingerprint, dynamic
programming deals max_bits + 1 units out to the parts (a part with u units is probed within u - 1 bits,
none: not at all) so that estimated probes and candidates are fewest; two fingerprints within max_bits
then agree with one part's radius. Parts are looked up in shards of bounded size, candidates are verified
by their distance, and a shard emits a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import numbered, prepare, unused
from prismcat.llm.components import components
from prismcat.session import materialise

# Seeds of the searched fingerprint and of the one that confirms a candidate.
SEEDS = (42, 43)
# Distinct fingerprints of one shard, about; shards of over four times as many are split.
SHARD = 1 << 14
_STRETCH = 1 << 20
_PAIRS = 1 << 20
# A candidate's cost against that of a probe.
_CANDIDATE = 0.1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _stretches(text: bytes, size: int, overlap: int) -> Iterator[tuple[list[bytes], bool]]:
    """Words of ``text`` in stretches that share ``overlap`` words, and whether it is the first."""
    words: list[bytes] = []
    at, first = 0, True
    while at < len(text):
        found = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        words += text[at:end].split()
        yield words, first
        words, at, first = words[len(words) - overlap :] if overlap and len(words) > overlap else list(words) if overlap else [], end, False


def shingle_hashes(text: bytes, n: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all n-word shingles, in stretches of a long text; fewer words are one shingle, none give nothing."""
    seen = 0
    last: list[bytes] = []
    for words, _ in _stretches(text.lower(), _STRETCH, n - 1):
        last = words
        if len(words) < n:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        bounds = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in bounds), np.uint64, len(words) - n + 1)
        seen += len(hashes)
        yield hashes
    if not seen and last:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), seed)], np.uint64)


def fingerprint(text: bytes, n: int, seed: int = SEEDS[0]) -> int:
    """A bit is 1 if set in over half of the shingle hashes; signed, as Spark keeps it."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, n, seed):
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def _fingerprint_batches(n: int, confirm: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("_text").to_pylist()]
            first = pa.array([fingerprint(t, n) for t in texts], pa.int64())
            second = pa.array([fingerprint(t, n, SEEDS[1]) for t in texts], pa.int64()) if confirm else pa.array([0] * len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), first, second], ["_id", "fp", "fp2"])

    return run


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each value, packed from bit 0 on."""
    out = np.zeros(len(values), np.uint64)
    for place, bit in enumerate(bits):
        out |= (values >> np.uint64(bit) & np.uint64(1)) << np.uint64(place)
    return out


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, summed over a task."""
    total = np.zeros((64, 64))
    for batch in batches:
        x = _bits(_column(batch, "fp")).astype(np.float32)
        total += x.T @ x
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j].astype(np.int64))], ["k", "n"])


def group_bits(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of almost equal size, each grown by the bit that correlates most with it."""
    p = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs(together / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    free, groups = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group: list[int] = []
        while len(group) < size:
            gain = linked[np.ix_(free, group or free)].sum(1)
            group.append(free.pop(int(gain.argmax())))
        groups.append(group)
    return groups


def _chunks(part: list[int]) -> list[list[int]]:
    return [part[i : i + 8] for i in range(0, len(part), 8)]


def _histograms(chunks: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(chunks), 256), np.int64)
        for batch in batches:
            values = _column(batch, "fp").view(np.uint64)
            for c, bits in enumerate(chunks):
                total[c] += np.bincount(_gather(values, bits).astype(np.int64), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "n"])

    return run


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def choose_parts(total: int, max_bits: int) -> int:
    """Number of parts of least estimated cost for evenly spread fingerprints and evenly dealt units."""
    costs = {}
    for m in range(1, max_bits + 2):
        units = [(max_bits + 1) // m + (k < (max_bits + 1) % m) for k in range(m)]
        costs[m] = sum(_ball(64 // m, u - 1) * (1 + _CANDIDATE * total / 2 ** (64 // m)) for u in units if u)
    return min(costs, key=costs.get)


def allocate(values: np.ndarray, parts: list[list[int]], histograms: np.ndarray, total: int, max_bits: int) -> np.ndarray:
    """Radius of every part for every fingerprint (-1: not probed), of least estimated probes and candidates."""
    apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    units, c = max_bits + 1, 0
    cost = np.zeros((len(parts), units + 1, len(values)))
    for i, part in enumerate(parts):
        near = np.zeros((max_bits + 1, len(values)))
        near[0] = 1.0  # shares of the fingerprints at each distance, chunks taken as independent
        for bits in _chunks(part):
            share = np.stack([(histograms[c] * (apart == d)).sum(1) / max(total, 1) for d in range(max_bits + 1)])
            own = share[:, _gather(values, bits).astype(np.int64)]
            near = np.stack([sum(near[d - e] * own[e] for e in range(d + 1)) for d in range(max_bits + 1)])
            c += 1
        within = np.cumsum(near, 0) * total
        for u in range(1, units + 1):
            cost[i, u] = _ball(len(part), min(u - 1, len(part))) + _CANDIDATE * within[u - 1]
    best = np.full((units + 1, len(values)), np.inf)
    best[0], choices = 0.0, []
    for i in range(len(parts)):
        options = np.full((units + 1, units + 1, len(values)), np.inf)
        for have in range(units + 1):
            for u in range(have + 1):
                options[have, u] = best[have - u] + cost[i, u]
        choices.append(options.argmin(1))
        best = options.min(1)
    radius, left, rows = np.zeros((len(parts), len(values)), np.int64), np.full(len(values), units), np.arange(len(values))
    for i in reversed(range(len(parts))):
        u = choices[i][left, rows]
        radius[i], left = u - 1, left - u
    return radius


def _masks(bits: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), weight)], np.uint64)


def _router(parts: list[list[int]], histograms: np.ndarray, total: int, max_bits: int, prefix: int) -> Callable:
    """Rows for the shards: each fingerprint in its own shard of every part, and where its probes go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                values = _column(batch, "fp").view(np.uint64)
                radius = allocate(values, parts, histograms, total, max_bits)
                for i, part in enumerate(parts):
                    home = _gather(values, part[:prefix])
                    for weight in range(min(prefix, max_bits) + 1):
                        rows = np.flatnonzero(radius[i] >= weight) if weight else np.arange(len(values))
                        if not len(rows):
                            break
                        masks = _masks(prefix, weight)
                        at_rows = np.repeat(rows, len(masks))
                        key = (home[at_rows] ^ np.tile(masks, len(rows))).astype(np.int64) | (i << 48)
                        left = np.where(radius[i][at_rows] >= 0, radius[i][at_rows] - weight, -1)
                        take = pa.array(at_rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), *(batch.column(c).take(take) for c in ("node", "fp", "fp2")), pa.array(left.astype(np.int32)), pa.array([weight == 0] * len(at_rows))],
                            ["key", "node", "fp", "fp2", "left", "data"],
                        )

    return run


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-label components after links a - b have been added."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(again := labels[labels], labels):
            labels = again


def _link_shard(parts: list[list[int]], prefix: int, max_bits: int, confirm_bits: int | None) -> Callable:
    """Spanning forest of the links that one shard finds."""

    def run(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(_column(table, "node"), return_inverse=True)
        fp, fp2 = _column(table, "fp").view(np.uint64), _column(table, "fp2").view(np.uint64)
        left, data = _column(table, "left"), _column(table, "data")
        bits = parts[int(table.column("key")[0].as_py()) >> 48][prefix:]
        low = _gather(fp, bits)
        stored = np.flatnonzero(data)
        stored = stored[np.argsort(low[stored], kind="stable")]
        keys = low[stored]
        labels = np.arange(len(nodes))
        for weight in range(max(int(left.max(initial=-1)), -1) + 1):
            asking = np.flatnonzero(left >= weight)
            for mask in _masks(len(bits), weight):
                probe = low[asking] ^ mask
                lo, hi = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
                hit = np.flatnonzero(hi > lo)
                done = 0
                sizes = (hi - lo)[hit]
                ends = np.cumsum(sizes)
                while done < len(hit):
                    base = ends[done - 1] if done else 0
                    stop = max(done + 1, int(np.searchsorted(ends, base + _PAIRS, "right")))
                    n = sizes[done:stop]
                    q = np.repeat(asking[hit[done:stop]], n)
                    s = stored[np.repeat(lo[hit[done:stop]] - (ends[done:stop] - n - base), n) + np.arange(n.sum())]
                    apart = np.bitwise_count(fp[q] ^ fp[s])
                    good = apart <= max_bits
                    if confirm_bits is not None:
                        good &= apart + np.bitwise_count(fp2[q] ^ fp2[s]) <= confirm_bits
                    labels = _merge(labels, at[q[good]], at[s[good]])
                    done = stop
        moved = np.flatnonzero(labels != np.arange(len(nodes)))
        return pa.table({"a": nodes[moved], "b": nodes[labels[moved]]})

    return run


def _sums(df: DataFrame, run: Callable, size: int) -> np.ndarray:
    """Counts by position, summed over all tasks; at most ``size`` numbers reach the driver."""
    out = np.zeros(size, np.int64)
    for k, n in df.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    return out


def link_fingerprints(distinct: DataFrame, max_bits: int, confirm_bits: int | None = None, shard: int = SHARD) -> DataFrame:
    """Links ``a``, ``b`` that connect the same nodes of ``distinct`` (node, fp, fp2) as all pairs within ``max_bits``.

    With ``confirm_bits``, a pair also needs that few differing bits over both fingerprints.
    """
    total = distinct.count()
    if total < 2:
        return distinct.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    parts_wanted = choose_parts(total, max_bits)
    i, j = np.triu_indices(64)
    together = np.zeros((64, 64))
    together[i, j] = _sums(distinct.select("fp"), _together, 64 * 64).reshape(64, 64)[i, j]
    parts = group_bits(np.maximum(together, together.T), total, parts_wanted)
    chunks = [c for part in parts for c in _chunks(part)]
    histograms = _sums(distinct.select("fp"), _histograms(chunks), len(chunks) * 256).reshape(len(chunks), 256)
    prefix = min(max(0, math.ceil(math.log2(total / shard))), min(map(len, parts)) - 1)
    routed = distinct.mapInArrow(_router(parts, histograms, total, max_bits, prefix), "key long, node long, fp long, fp2 long, left int, data boolean")
    crowded = distinct.select(F.explode(F.array(*(
        sum((F.getbit(F.col("fp"), F.lit(bit)).cast("long") * (1 << place) for place, bit in enumerate(part[:prefix])), F.lit(k << 48))
        for k, part in enumerate(parts)
    ))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * shard)
    crowded = crowded.select("key", F.ceil(F.col("n") / shard).cast("int").alias("tiles"))
    routed = routed.join(crowded, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # a stored fingerprint lies in one tile of a crowded shard, its probes go to all of them
    routed = routed.withColumn("home", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).select("*", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"))
    routed = routed.withColumn("data", F.col("data") & (F.col("home") == F.col("tile"))).filter("data OR left >= 0").drop("tiles", "home")
    return routed.groupBy("key", "tile").applyInArrow(_link_shard(parts, prefix, max_bits, confirm_bits), "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2,
    confirm_bits: int | None = None, shard: int = SHARD,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (hex), ``component_id``: the smallest id it reaches by links.

    NULL and empty texts have fingerprint zero and link like any other; texts of fewer words than a
    shingle are one shingle. Rows with the same id are rows of their own; a component without an id has
    NULL. Other columns don't matter. Copies share a fingerprint and are searched once.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    prints = materialise(
        texts.mapInArrow(_fingerprint_batches(shingle, confirm_bits is not None), f"_id {kind}, fp long, fp2 long"), "simhash-prints"
    )
    distinct = numbered(prints.groupBy("fp", "fp2").agg(F.min("_id").alias("low")), "simhash-distinct", "node")
    links = link_fingerprints(distinct.select("node", "fp", "fp2"), max_bits, confirm_bits, shard)
    joined = distinct.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = materialise(joined, "simhash-nodes")
    lowest = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = materialise(joined.join(lowest, "component").select("fp", "fp2", "component_id"), "simhash-classes")
    out = prints.join(classes, ["fp", "fp2"])
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(
    docs: DataFrame, text_col: str = "text", shingle: int = 5, max_bits: int = 8, similarity: float = 0.8, shard: int = SHARD,
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the first in the table as it is read.

    Rows link if their fingerprints differ in at most ``max_bits`` of 64 bits and, over two independent
    fingerprints, in no more bits than texts whose shingle sets have a Jaccard similarity of ``similarity``
    differ in on average. Rows without words are copies of each other.
    """
    key = unused(docs, "_row")
    rows = numbered(docs, "simhash-docs", key)
    cosine = 2 * similarity / (1 + similarity)
    confirm = int(128 * math.acos(cosine) / math.pi)
    groups = simhash_groups(rows.select(key, text_col), key, text_col, shingle, max_bits, confirm, shard)
    return rows.join(groups.filter(F.col(key) == F.col("component_id")).select(key), key, "left_semi").select(*docs.columns)
