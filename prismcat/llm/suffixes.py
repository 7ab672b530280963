"""Substring dedup on a sharded, enhanced suffix array.

A least-hashed 20-gram of each 50-byte window names its shard, so all places of a window meet in one shard;
consecutive windows of one name travel as one run of bytes. Names seen once are dropped first. A shard sorts the
suffixes of its runs, and a stack scan over their common prefixes yields the intervals of the prefix tree. An
interval whose places are preceded by different bytes is a maximal repeat group: all its places are covered, but
for those in its smallest document. Texts stay in a table bucketed by block and are never shuffled. Of equal texts only
the first takes part: later ones are removed whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.llm.common import arrow_batches, prepare
from prismcat.session import materialise, scratch_path

LENGTH, GRAM = 50, 20
# Bytes in a block, about. A block sends one row to each shard that it has names of, so larger blocks send fewer rows.
BLOCK = 1 << 20
# Documents in a block at most.
DOCS = 1 << 14
# Texts given to a Python worker at a time; a longer row comes alone.
BATCH = "2m"
# Bytes of input to a shard, about; bytes of a suffix that are compared; steps after which a run starts anew.
SHARD, _DEPTH, _EDGE = 1 << 21, 96, 40
_PIECE = 1 << 15  # suffixes that are sorted at a time, but for those of one window
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NO_ID = (1 << 63) - 1
# What a shard sends back for a run of a block: its number, covered offset and length, smallest document.
_FOUND = np.dtype([("number", "<i4"), ("offset", "<i4"), ("length", "<i4"), ("smallest", "<i8")])


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit polynomial hash of every ``length`` bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = np.full(len(data), _BASE, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumprod(powers, out=powers)
    powers *= data.astype(np.uint64) + np.uint64(1)
    np.cumsum(powers, out=sums[1:])
    inverse = np.full(n, _INVERSE, np.uint64)
    inverse[0] = 1
    del powers
    h = sums[length:] - sums[:-length]
    del sums
    h *= np.cumprod(inverse, out=inverse)
    del inverse
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def window_runs(data: np.ndarray, sizes: np.ndarray, skip: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one name: name, document number, start and end byte in the block.

    Documents numbered in ``skip`` give none.
    """
    least = _window_hashes(data, GRAM)
    span = LENGTH - GRAM + 1
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    good = np.arange(len(least)) + LENGTH <= ends[doc] if len(least) else np.empty(0, bool)
    if skip:
        wanted = np.ones(len(sizes), bool)
        wanted[skip] = False
        good &= wanted[doc]
    opens = good.copy()
    opens[1:] &= ~good[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(opens)
    closes = good.copy()
    closes[:-1] &= ~good[1:] | opens[1:]
    last = np.flatnonzero(closes)
    return least[start] * np.uint64(0xBF58476D1CE4E5B9), doc[start], start, last + LENGTH


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[bytes] = []
    digests: list[bytes] = []

    def out() -> pa.RecordBatch:
        sizes = [len(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([digests], pa.list_(pa.binary())), pa.array([b"".join(texts)], pa.binary())],
            ["ids", "sizes", "digests", "data"],
        )

    size = 0
    for batch in batches:
        for number, text, digest in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "_digest")), strict=True):
            if texts and (size + len(text) > BLOCK or len(texts) >= DOCS):
                yield out()
                ids, texts, digests, size = [], [], [], 0
            ids.append(number)
            texts.append(text)
            digests.append(digest)
            size += len(text)
    if texts:
        yield out()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_shard(home: np.ndarray) -> dict[int, np.ndarray]:
    """Positions of each shard, in order."""
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    return {int(home[at[0]]): at for at in np.split(order, cuts)} if len(home) else {}


def _short(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(32)).astype(np.uint32)


def _names(shards: int) -> Callable:
    """The different names of each block, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            names = np.unique(window_runs(np.frombuffer(row["data"], np.uint8), np.array(row["sizes"], np.int64), row["copies"])[0])
            home = (names % np.uint64(shards)).astype(np.int64)
            parts = _by_shard(home)
            used, packed = list(parts), [_short(names[at]).tobytes() for at in parts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([row["block"]] * len(used), pa.int64()), pa.array(packed, pa.binary())], ["shard", "block", "names"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For every block, which of its names another block has too."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("names").to_pylist()]
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    flags = np.split(counts[inverse] > 1, np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


class _Runs:
    """Runs of a block whose names are repeated, equal ones together, numbered within their shard."""

    def __init__(self, row: dict, shards: int):
        data = np.frombuffer(row["data"], np.uint8)
        names, doc, start, end = window_runs(data, np.array(row["sizes"], np.int64), row["copies"])
        different, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
        home = (different % np.uint64(shards)).astype(np.int64)
        wanted = counts > 1
        places = _by_shard(home)
        for shard, flags in sorted((f["shard"], f["flags"]) for f in row["flags"] or []):
            at = places[shard]
            wanted[at] |= np.unpackbits(np.frombuffer(flags, np.uint8), count=len(at)).astype(bool)
        keep = np.flatnonzero(wanted[inverse])
        self.doc, self.start, self.end = doc[keep], start[keep], end[keep]
        self.ids = np.array([_NO_ID if i is None else i for i in row["ids"]], np.int64)[self.doc]
        self.home = home[inverse[keep]]
        self.places = _by_shard(self.home)
        self.number = np.empty(len(keep), np.int64)
        self.texts: dict[int, dict[bytes, int]] = {}
        raw = row["data"]
        for i, (shard, a, b) in enumerate(zip(self.home.tolist(), self.start.tolist(), self.end.tolist(), strict=True)):
            known = self.texts.setdefault(shard, {})
            self.number[i] = known.setdefault(raw[a:b], len(known))


def _send(shards: int) -> Callable:
    """Each block's different repeated runs with the smallest and largest document they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            runs = _Runs(row, shards)
            out: tuple[list, ...] = ([], [], [], [], [])
            for shard, texts in runs.texts.items():
                at = runs.places[shard]
                low, high = np.full(len(texts), _NO_ID), np.full(len(texts), -_NO_ID)
                np.minimum.at(low, runs.number[at], runs.ids[at])
                np.maximum.at(high, runs.number[at], runs.ids[at])
                for column, value in zip(out, (shard, row["block"], list(texts), low, high), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["shard", "block", "runs", "low", "high"])

    return run


def repeat_groups(texts: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of maximal repeat groups in different ``texts``: text, offset, length, smallest document of the group.

    ``low`` and ``high`` are the smallest and largest document of each text. Only places in a later document count,
    and groups that start before the text's own first document: later ones add nothing to the text as a whole.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join([*texts, bytes(_DEPTH)]), np.uint8)
    at = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = at[text] + offset
    own = np.flatnonzero(low < high)
    out = [(own, np.zeros(len(own), np.int64), sizes[own], low[own])]
    if len(place):
        # windows that stand alone or can be extended to the left at every place need not be sorted; equal
        # hashes of different windows would only keep more of them
        hashes = _window_hashes(data, LENGTH)[place]
        order = np.argsort(hashes)
        heads = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        edge = offset % _EDGE == 0
        before = data[np.maximum(place - 1, 0)].astype(np.int64)
        smallest, largest = np.where(edge, -1, before), np.where(edge, 256, before)
        diverse = np.minimum.reduceat(smallest[order], heads) < np.maximum.reduceat(largest[order], heads)
        several = np.diff(np.r_[heads, len(order)]) > 1
        counts = np.diff(np.r_[heads, len(order)])
        kept = order[np.repeat(diverse & several, counts)]
        del hashes, order, before
        # an interval lies within one window's suffixes, so pieces of whole windows are sorted one by one
        ends = np.cumsum(counts[diverse & several])
        cuts = ends[np.flatnonzero(np.diff(ends // _PIECE, prepend=0))]
        for piece in np.split(kept, cuts):
            out.extend(_tree(data, place, text, offset, sizes, smallest, largest, low, piece))
    whole = tuple(np.concatenate(c) for c in zip(*out, strict=True))
    later = whole[3] < high[whole[0]]
    return tuple(c[later] for c in whole)


def _tree(data, place, text, offset, sizes, smallest, largest, low, kept) -> Iterator[tuple[np.ndarray, ...]]:
    """Stack scan over the sorted suffixes ``kept``: left-diverse intervals of at least LENGTH common bytes."""
    if not len(kept):
        return
    suffixes = np.lib.stride_tricks.sliding_window_view(data, _DEPTH)[place[kept]].copy()
    # one more than each byte: no byte is zero, and 255 never occurs in UTF-8
    rest = np.minimum(_DEPTH, sizes[text[kept]] - offset[kept])
    keys = suffixes
    keys += np.uint8(1)
    for a in range(0, len(kept), _PIECE):
        keys[a : a + _PIECE][np.arange(_DEPTH) >= rest[a : a + _PIECE, None]] = 0
    order = np.argsort(keys.view(f"S{_DEPTH}").ravel(), kind="stable")
    keys, kept, rest = keys[order], kept[order], rest[order]
    common = np.empty(len(kept) - 1, np.int64)
    for a in range(0, len(common), _PIECE):
        differ = keys[a + 1 : a + _PIECE + 1] != keys[a : a + _PIECE][: len(common) - a]
        common[a : a + _PIECE] = np.where(differ.any(1), differ.argmax(1), _DEPTH)
    del keys, suffixes
    common = np.minimum(common, np.minimum(rest[1:], rest[:-1])).tolist()
    lows, small, large = low[text[kept]].tolist(), smallest[kept].tolist(), largest[kept].tolist()
    found: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []  # common prefix, first suffix, smallest document, smallest and largest byte before
    for i in range(1, len(kept) + 1):
        depth = common[i - 1] if i <= len(common) else 0
        node = [depth, i - 1, lows[i - 1], small[i - 1], large[i - 1]]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            node = [depth, top[1], min(top[2], node[2]), min(top[3], node[3]), max(top[4], node[4])]
            if node[3] < node[4]:
                found.append((top[1], i, top[0], node[2]))
        if depth < LENGTH:
            continue
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            top[2:] = [min(top[2], node[2]), min(top[3], node[3]), max(top[4], node[4])]
        else:
            stack.append(node)
    # all places of a suffix's intervals start with it, so the longest one that an earlier document has covers the rest
    own = low[text[kept]]
    length, least = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
    for first, stop, depth, document in sorted(found, key=lambda f: f[2]):
        earlier = own[first:stop] > document
        length[first:stop][earlier] = depth
        least[first:stop][earlier] = document
    at = np.flatnonzero(length)
    yield text[kept[at]], offset[kept[at]], length[at], least[at]


def _union(run: np.ndarray, offset: np.ndarray, length: np.ndarray, smallest: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same cover in fewer spans: spans of one run and smallest document are joined where they meet.

    A span whose smallest document is below ``low``, the run's own, holds at all its places; others inside it go.
    """
    smallest = np.where(smallest < low[run], -_NO_ID, smallest)
    order = np.lexsort((offset, smallest, run))
    run, offset, end, smallest = run[order], offset[order], (offset + length)[order], smallest[order]
    fresh = np.r_[True, (run[1:] != run[:-1]) | (smallest[1:] != smallest[:-1])][: len(run)]
    lane = np.cumsum(fresh) << 32  # keeps the ends of one group below the offsets of the next
    reach = np.maximum.accumulate(lane + end)
    first = np.flatnonzero(np.r_[True, (lane + offset)[1:] > reach[:-1]][: len(run)])
    if not len(first):
        return run, offset, end, smallest
    end = (reach - lane)[np.r_[first[1:] - 1, len(run) - 1]]
    run, offset, smallest = run[first], offset[first], smallest[first]
    whole = smallest == -_NO_ID
    starts, ends = (run[whole] << 32) + offset[whole], (run[whole] << 32) + end[whole]
    at = np.searchsorted(starts, (run << 32) + offset, "right") - 1
    inside = (at >= 0) & ~whole
    inside[inside] = ends[at[inside]] >= ((run << 32) + end)[inside]
    keep = ~inside
    return run[keep], offset[keep], (end - offset)[keep], smallest[keep]


def _judge(table: pa.Table) -> pa.Table:
    """Repeat groups of a shard, sent back to the blocks that have places of them."""
    known: dict[bytes, int] = {}
    blocks, numbers, texts, lows, highs = [], [], [], [], []
    for block, runs, low, high in zip(*(table.column(c).to_pylist() for c in ("block", "runs", "low", "high")), strict=True):
        blocks += [block] * len(runs)
        numbers += range(len(runs))
        texts += [known.setdefault(r, len(known)) for r in runs]
        lows += low
        highs += high
    text, high = np.array(texts, np.int64), np.array(highs, np.int64)
    least, most = np.full(len(known), _NO_ID), np.full(len(known), -_NO_ID)
    np.minimum.at(least, text, np.array(lows, np.int64))
    np.maximum.at(most, text, high)
    which, offset, length, smallest = _union(*repeat_groups(list(known), least, most), least)
    order = np.argsort(text, kind="stable")
    counts = np.bincount(text, minlength=len(known))
    firsts = np.cumsum(counts) - counts
    n = counts[which]
    back = order[np.repeat(firsts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    rows = np.repeat(np.arange(len(which)), n)
    later = smallest[rows] < high[back]
    back, rows = back[later], rows[later]
    back, offset, length, smallest = _union(back, offset[rows], length[rows], smallest[rows], np.array(lows, np.int64))
    block = np.array(blocks, np.int64)[back]
    by_block = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(block[by_block]) != 0]) if len(block) else np.empty(0, np.int64)
    number = np.array(numbers, np.int64)[back]
    packed = np.empty(len(block), _FOUND)
    for name, column in zip(_FOUND.names, (number, offset, length, smallest), strict=True):
        packed[name] = column[by_block]
    parts = [p.tobytes() for p in np.split(packed, cuts[1:])] if len(cuts) else []
    shard = table.column("shard")[0].as_py()
    return pa.table({"block": pa.array(block[by_block][cuts], pa.int64()), "shard": pa.array([shard] * len(cuts), pa.int64()), "found": pa.array(parts, pa.binary())})


def _remove(shards: int) -> Callable:
    """Removed and kept bytes of every document of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, sizes = np.frombuffer(row["data"], np.uint8), np.array(row["sizes"], np.int64)
            cover = np.zeros(len(data) + 1, np.int64)
            runs = _Runs(row, shards) if row["found"] else None
            for shard, packed in sorted((f["shard"], f["found"]) for f in row["found"] or []):
                number, offset, length, smallest = (np.frombuffer(packed, _FOUND)[c].astype(np.int64) for c in _FOUND.names)
                at = runs.places[shard]
                at = at[np.argsort(runs.number[at], kind="stable")]
                counts = np.bincount(runs.number[at], minlength=len(runs.texts[shard]))
                firsts = np.cumsum(counts) - counts
                n = counts[number]
                place = at[np.repeat(firsts[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                which = np.repeat(np.arange(len(number)), n)
                later = runs.ids[place] > smallest[which]
                a = runs.start[place[later]] + offset[which[later]]
                np.add.at(cover, a, 1)
                np.add.at(cover, a + length[which[later]], -1)
            gone = np.cumsum(cover[:-1]) > 0
            edges = np.r_[0, np.cumsum(sizes)]
            for copy in row["copies"] or []:
                gone[edges[copy] : edges[copy + 1]] = True
            rows, at = [], 0
            for number, size in zip(row["ids"], sizes.tolist(), strict=True):
                mask = gone[at : at + size]
                spans = int(mask[:1].sum() + np.count_nonzero(mask[1:] & ~mask[:-1]))
                rows.append((number, size, int(mask.sum()), spans, hashlib.sha256(data[at : at + size][~mask].tobytes()).hexdigest()))
                at += size
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Removed is each byte of a 50-byte string that also starts in a document with a smaller id. NULL and empty
    texts have no bytes; a NULL id is larger than any other. Rows with one id remove nothing from each other.
    Other columns don't matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    with arrow_batches(spark, BATCH):
        return _suffix_dedup(spark, docs, id_col, text_col, shard)


def _suffix_dedup(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, shard: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("_digest"))
    schema = "ids array<long>, sizes array<long>, digests array<binary>, data binary"
    made = texts.mapInArrow(_blocks, schema).withColumn("block", F.monotonically_increasing_id())
    stem, tables = f"suffix_{uuid.uuid4().hex}", []
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_block(df: DataFrame, label: str) -> DataFrame:
        # bucketed by block, so that what belongs to a block is joined without moving texts
        tables.append(f"{stem}_{label}")
        df.write.option("path", scratch_path(spark, f"suffix-{label}")).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    blocks = by_block(made, "blocks")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    shards = max(16, total // shard)
    blocks = blocks.join(by_block(_copies(blocks), "copies").hint("merge"), "block", "left")
    names = blocks.mapInArrow(_names(shards), "shard long, block long, names binary")
    flags = names.groupBy("shard").applyInArrow(_repeated, "block long, shard long, flags binary")
    flags = by_block(flags.groupBy("block").agg(F.collect_list(F.struct("shard", "flags")).alias("flags")), "flags")
    flagged = blocks.join(flags.hint("merge"), "block", "left")
    sent = flagged.mapInArrow(_send(shards), "shard long, block long, runs array<binary>, low array<long>, high array<long>")
    found = sent.groupBy("shard").applyInArrow(_judge, "block long, shard long, found binary")
    found = by_block(found.groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("found")), "found")
    judged = flagged.join(found.hint("merge"), "block", "left")
    out = judged.mapInArrow(_remove(shards), "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = materialise(out, "suffix-dedup")
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
    return out.withColumnRenamed("_id", id_col)


def _copies(blocks: DataFrame) -> DataFrame:
    """By block, positions of documents whose whole text, of LENGTH bytes or more, is in a smaller document too."""
    one = F.explode(F.arrays_zip("ids", "sizes", "digests", F.sequence(F.lit(0), F.size("ids") - 1).alias("position")))
    rows = blocks.select("block", one.alias("d")).where(f"d.sizes >= {LENGTH}").select(
        "block", "d.position", "d.digests", F.coalesce("d.ids", F.lit(_NO_ID)).alias("id")
    )
    firsts = rows.groupBy("digests").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # a text of very many copies is split by adaptive execution: the first side is one row
    later = rows.join(firsts.hint("merge"), "digests").where("id > first")
    return later.groupBy("block").agg(F.collect_list("position").alias("copies"))
