"""One big JSON array per file, read by as many tasks as the file has splits.

The file is scanned as text whose lines end at a closing brace, which Spark splits at any byte. Whether a split starts
inside a string, and how deep, follows from the splits before it: a first pass counts each split's quotes and brackets
under both assumptions, running sums over the splits of a file tell which one holds. A second pass cuts the elements
at the commas of the outermost level; what lies across splits is put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismcat.session import materialise

_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = (ord(c) for c in "\"\\,[]")
# Splits that a task reads one after the other, at most, where there are more than four a core.
_SPLITS_PER_TASK = 128
_NESTING = np.zeros(256, np.int8)
_NESTING[[ord("["), ord("{")]], _NESTING[[ord("]"), ord("}")]] = 1, -1


def _quotes(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a quote that no backslash escapes; 1 or 0."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _BACKSLASH, at, -1))
    escaped = np.zeros(len(data), bool)
    escaped[1:] = (at - plain)[:-1] % 2 == 1
    return ((data == _QUOTE) & ~escaped).astype(np.int64)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((file, start, *others), bytes) of every run of lines of one split, in order; the braces are put back."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in batch.schema.names]
        lines, held, key = columns[0], [], None
        for line, *own in zip(lines, *columns[1:], strict=True):
            if own != key and held:
                yield tuple(key), ("}".join(held) + "}").encode()
                held = []
            key = own
            held.append(line)
        if held:
            yield tuple(key), ("}".join(held) + "}").encode()


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of lines: quotes, the change of depth if it starts outside or inside a string, and whether an array starts the file."""
    rows = []
    for order, ((file, start), text) in enumerate(_splits(batches)):
        data = np.frombuffer(text, np.uint8)
        quotes = _quotes(data)
        inside = (np.cumsum(quotes) - quotes) % 2
        change = _NESTING[data]
        first = start == 0 and (not rows or rows[-1][:2] != (file, start)) and text.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"[")
        rows.append((file, start, order, int(quotes.sum()) % 2, int(change[inside == 0].sum()), int(change[inside == 1].sum()), first))
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = (pa.string(), *[pa.int64()] * 5, pa.bool_())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "start", "part", "odd", "outside", "inside", "is_array"]
    )


class _Cutter:
    """Elements of one split, whose state at its start is known."""

    def __init__(self, inside: int, depth: int):
        self.inside, self.depth = inside, depth
        self.open = depth > 0  # an element is going on
        self.cut = False  # a comma or bracket of the outermost level was seen
        self.held: list[bytes] = []
        self.head: bytes | None = None

    def feed(self, text: bytes) -> Iterator[bytes]:
        """Whole elements; the first one of a split that starts within the array is kept as its head."""
        data = np.frombuffer(text, np.uint8)
        quotes = _quotes(data)
        outside = (np.cumsum(quotes) - quotes + self.inside) % 2 == 0
        change = np.where(outside, _NESTING[data], 0)
        after = self.depth + np.cumsum(change)
        comma = outside & (data == _COMMA) & (after == 1)
        opens, closes = outside & (data == _OPEN) & (after == 1), outside & (data == _CLOSE) & (after == 0)
        at = 0
        for i in np.flatnonzero(comma | opens | closes).tolist():
            if self.open:
                whole = b"".join([*self.held, text[at:i]])
                if not self.cut:
                    self.head = whole
                else:
                    yield whole
            self.held, at, self.cut, self.open = [], i + 1, True, not closes[i]
        if self.open:
            self.held.append(text[at:])
        self.depth = int(after[-1]) if len(after) else self.depth
        self.inside = (self.inside + int(quotes.sum())) % 2


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, piece, item): whole elements have piece 0, a split's head 1, what goes on behind it 2."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("piece", pa.int32()), ("item", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def rest(key: tuple, cutter: _Cutter) -> list[tuple]:
        tail = b"".join(cutter.held)
        if not cutter.cut:  # the whole split lies in one element, or outside the array
            return [(*key, 1, tail.decode())] if cutter.open else []
        head = [(*key, 1, cutter.head.decode())] if cutter.head is not None else []
        return [*head, (*key, 2, tail.decode() if cutter.open else None)]

    current, cutter = None, None
    for (file, start, inside, depth), text in _splits(batches):
        if (file, start) != current:
            if cutter is not None:
                yield batch(rest(current, cutter))
            current, cutter = (file, start), _Cutter(inside, depth)
        yield batch([(file, start, 0, e.decode()) for e in cutter.feed(text)])
    if cutter is not None:
        yield batch(rest(current, cutter))


def _grouped(text: DataFrame) -> DataFrame:
    """The same splits, several in a task where there are more than four a core: a task and its files cost more than a small split."""
    splits, wide = text.rdd.getNumPartitions(), 4 * text.sparkSession.sparkContext.defaultParallelism
    return text.coalesce(max(1, min(splits, max(wide, -(-splits // _SPLITS_PER_TASK)))))


def read_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(item): the text of every element of the JSON array that each file holds, as it stands.

    A file that doesn't start with an array has no elements, text behind the array is left out, and an array that
    isn't closed ends with its file. Files are split as ``spark.sql.files.maxPartitionBytes`` says; an element may span splits.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    text = _grouped(text)
    figures = text.mapInArrow(_figures, "file string, start bigint, part bigint, odd bigint, outside bigint, inside bigint, is_array boolean")
    figures = materialise(figures, "json-splits")  # a row for each batch of lines, without their text
    before = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    known = figures.withColumn("is_array", F.bool_or("is_array").over(whole)).where("is_array").withColumn("begins", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("begins") == 0, F.col("outside")).otherwise(F.col("inside"))).over(before), F.lit(0)))
    states = known.groupBy("file", "start").agg(F.min(F.struct("part", "begins", "depth")).alias("s"))
    states = materialise(states.select("file", "start", F.col("s.begins").alias("begins"), F.col("s.depth").alias("depth")), "json-states")
    # one row per split (of 128 MB, say); the join keeps the order of the lines, as the scanned side isn't shuffled
    placed = text.join(F.broadcast(states), ["file", "start"]).select("value", "file", "start", "begins", "depth")
    found = materialise(placed.mapInArrow(_elements, "file string, start bigint, piece int, item string"), "json-elements")
    # a head belongs to the last split before it that has something going on
    parts = found.where("piece > 0")
    order = Window.partitionBy("file").orderBy("start", "piece")
    parts = parts.withColumn("of", F.max(F.when(F.col("piece") == 2, F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.sort_array(F.collect_list(F.struct("start", "piece", F.coalesce("item", F.lit("")).alias("item"))))
    joined = parts.groupBy("file", "of").agg(F.array_join(F.transform(pieces, lambda p: p["item"]), "").alias("item"))
    items = found.where("piece = 0").select("item").unionByName(joined.select("item"))
    trimmed = F.regexp_replace("item", r"^\s+|\s+$", "")
    return items.select(trimmed.alias("item")).where(F.col("item") != "")
