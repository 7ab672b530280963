"""Periodic runs: stretches of words that repeat themselves with a short period, found and collapsed.

A run's Lyndon root starts where the next smaller suffix (in the words' order or its reverse) stands one period
later. So every position gives two candidates, and each is extended in both directions by longest common
extensions: constant-time lowest common ancestors on the Euler tours of two Ukkonen suffix trees, one of the
document and one of its reversal.

Only words that a run could cover enter the trees: a run of four periods and six words repeats each of its
trigrams three times at least. Stretches without such trigrams shrink to one separator that stands nowhere else,
which changes no run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import prepare

# Least length of a run in words, and in periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
_BLOCK = 32
# ASCII blanks that part words, as one blank.
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers from 0 whose last one stands nowhere else.

    ``depths`` are string depths along the Euler tour, ``place[i]`` is where the leaf of suffix ``i`` first stands
    in it, ``rank[i]`` the suffix's place in lexicographic order.
    """

    def __init__(self, seq: list[int]):
        n, width = len(seq), max(seq) + 1
        begin, end, link, kids = [0], [0], [0], {}
        node = edge = length = rest = 0
        for i, c in enumerate(seq):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = i
                key = node * width + seq[edge]
                child = kids.get(key)
                if child is None:
                    kids[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    start = begin[child]
                    span = end[child] - start
                    if length >= span:  # never on a leaf's edge, which ends behind the sequence
                        node, edge, length = child, edge + span, length - span
                        continue
                    if seq[start + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(begin)
                    kids[key] = split
                    begin += (start, i)
                    end += (start + length, n)
                    link += (0, 0)
                    kids[split * width + c] = split + 1
                    begin[child] = start + length
                    kids[split * width + seq[start + length]] = child
                    if last:
                        link[last] = split
                    last = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self._walk(n, width, begin, end, kids)

    def _walk(self, n: int, width: int, begin: list[int], end: list[int], kids: dict[int, int]) -> None:
        keys = np.fromiter(kids.keys(), np.int64, len(kids))
        order = np.argsort(keys)
        children = np.fromiter(kids.values(), np.int64, len(kids))[order].tolist()
        at = np.searchsorted(keys[order] // width, np.arange(len(begin) + 1))
        upcoming, stop = at[:-1].tolist(), at[1:].tolist()
        depth, tour, place, leaves, stack = [0] * len(begin), [], [0] * n, [], [0]
        while stack:
            v = stack[-1]
            tour.append(depth[v])
            k = upcoming[v]
            if k == stop[v]:
                stack.pop()
                continue
            upcoming[v] = k + 1
            c = children[k]
            reached = depth[v] + end[c] - begin[c]
            if upcoming[c] == stop[c]:
                place[n - reached] = len(tour)
                leaves.append(n - reached)
                tour.append(reached)
            else:
                depth[c] = reached
                stack.append(c)
        self.place = np.array(place)
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.depths = RangeMin(np.array(tour, np.int32))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extensions to the right of different places: depths of the leaves' lowest common ancestors."""
        a, b = self.place[i], self.place[j]
        return self.depths.query(np.minimum(a, b), np.maximum(a, b))


class RangeMin:
    """Least value between two places, in constant time and linear room: a sparse table over blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // _BLOCK)
        self.values = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        grid = self.values.reshape(blocks, _BLOCK)
        self.left = np.minimum.accumulate(grid, axis=1).ravel()
        self.right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(1)]
        while 2 << len(self.table) - 1 <= blocks:
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def query(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least values of ``[low, high]``."""
        a, b = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.right[low], self.left[high])
        between = b - a - 1
        for k, table in enumerate(self.table):
            use = np.flatnonzero((between >> k) == 1)
            if len(use):
                out[use] = np.minimum(out[use], np.minimum(table[a[use] + 1], table[b[use] - (1 << k)]))
        same = np.flatnonzero(a == b)
        if len(same):
            x, y = low[same], high[same]
            least = self.values[x]
            for step in range(1, int((y - x).max()) + 1):
                least = np.minimum(least, self.values[np.minimum(x + step, y)])
            out[same] = least
        return out


def _next_where(rank: list[int], greater: bool) -> list[int]:
    """The next place of a smaller (or greater) suffix, -1 where there is none."""
    out, stack = [-1] * len(rank), []
    for i, r in enumerate(rank):
        while stack and (rank[stack[-1]] < r) == greater:
            out[stack.pop()] = i
        stack.append(i)
    return out


def all_runs(seq: list[int], least_words: int = 2, least_periods: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal repetitions of that size, by start and period; at least two periods."""
    if not seq:
        return []
    shifted = [x + 1 for x in seq]
    size = len(shifted)
    forward = SuffixTree([*shifted, 0])
    rank = forward.rank.tolist()
    nexts = np.array([_next_where(rank, greater) for greater in (False, True)])
    i = np.tile(np.arange(size + 1), 2)
    j = nexts.ravel()
    known = (j >= 0) & (j < size)
    i, j = i[known], j[known]
    if not len(i):
        return []
    period = j - i
    right = forward.common(i, j)
    del forward
    backward = SuffixTree([*shifted[::-1], 0])
    left = backward.common(size - i, size - j)  # suffix size - i of the reversal starts with the word before i
    start, length = i - left, period + left + right
    fits = (length >= least_words) & (length >= least_periods * period)
    return sorted(set(zip(start[fits].tolist(), length[fits].tolist(), period[fits].tolist(), strict=True)), key=lambda r: (r[0], r[2]))


def _coverable(words: np.ndarray) -> np.ndarray:
    """Start and end of the stretches of trigrams that stand at least three times, in words; sorted."""
    _, word = np.unique(words, return_inverse=True)
    pair = word[:-1] * (word.max() + 1) + word[1:]
    _, pair = np.unique(pair, return_inverse=True)
    triple = pair[:-1] * (pair.max() + 1) + pair[1:]
    _, which, n = np.unique(triple, return_inverse=True, return_counts=True)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (n[which] >= 3).view(np.int8), [0]])))
    return edges.reshape(-1, 2) + [0, 2]


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of word numbers, by start and period."""
    if least_words < 6 or least_periods < 4:
        return all_runs(words.tolist(), least_words, least_periods)
    if len(words) < least_words:
        return []
    stretches = [(a, b) for a, b in _coverable(words).tolist() if b - a >= least_words]
    if not stretches:
        return []
    seq, origin, separator = [], [], int(words.max()) + 1
    for a, b in stretches:
        seq += words[a:b].tolist()
        seq.append(separator)
        origin += range(a, b + 1)
        separator += 1
    return [(origin[s], length, period) for s, length, period in all_runs(seq, least_words, least_periods)]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stands outside all runs or in the first period of every one that covers it."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def planted(words: list, row_id: object) -> list:
    """The test rule: a tenth of the ids, by crc32, end in a repetition; an id of None is written as an empty text."""
    h = zlib.crc32(("" if row_id is None else str(row_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _scan(plant: bool, least_words: int, least_periods: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def row(row_id: object, text: str | None) -> tuple:
        words = (text or "").encode().translate(_BLANKS).split(b" ")
        words = [w for w in words if w]
        if plant:
            words = planted(words, row_id)
        numbers: dict[bytes, int] = {}
        runs = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), least_words, least_periods)
        if runs:
            kept = kept_words(len(words), runs).tolist()
            words = [w for w, k in zip(words, kept, strict=True) if k]
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(words).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(i, t) for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), strict=True)]
            runs, texts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(runs, run_type), pa.array(texts, pa.string())], ["_id", "runs", "collapsed"])

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, plant: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``runs`` (start, length and period in words, by start and period), ``collapsed`` text.

    A run can't be extended with its smallest period and has ``least_words`` words and ``least_periods`` periods at
    least (2 at the lowest). The collapsed text has the words left, joined by one space, when every run is cut to
    its first period. NULL and empty texts, and those of blanks only, have no words, no runs and an empty collapsed
    text. Rows are judged each by itself, so repeated rows give equal rows; other columns don't matter. A document
    is held whole by a task. ``plant`` writes repetitions into a tenth of the texts first (``planted``).
    """
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    columns = f"_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return texts.mapInArrow(_scan(plant, least_words, least_periods), columns).withColumnRenamed("_id", id_col)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("minus"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed")
    digest = lambda text: F.sha2(F.encode(text, "utf-8"), 256)
    return top.select(
        id_col, "n_runs", (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.minus")).alias("period"),
        F.expr("1000 * top.length div -top.minus").alias("exponent_milli"),
        digest(F.col("lines")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
