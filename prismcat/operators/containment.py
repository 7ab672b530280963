"""Which names stand inside which others, without comparing pairs of names.

Patterns are dealt to shards by one gram of theirs, their anchor; a text goes to the shards that hold an anchor it
has itself, as it must to contain a pattern. A task builds one automaton from a shard's patterns and reads the shard's
texts through it, character by character. Patterns and texts only ever meet in the automaton's states, and what is
wanted of all that meet, the smallest name, is handed along its failure links, so the work and the rows that come out are
linear in the names however many of them lie in each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prismcat.session import materialise

GRAM = 3
# Characters of the patterns of one automaton (some 100 bytes each).
SHARD_CHARS = 250_000
# Grams that a task sends at once.
_GRAM_ROWS = 100_000


class NameAutomaton:
    """Aho-Corasick automaton of distinct patterns given in ascending order."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.next: list[dict[str, int]] = [{}]
        ends = []
        for pattern in patterns:
            state = 0
            for c in pattern:
                step = self.next[state].get(c)
                if step is None:
                    step = self.next[state][c] = len(self.next)
                    self.next.append({})
                state = step
            ends.append(state)
        self.fail = [0] * len(self.next)
        self.order: list[int] = list(self.next[0].values())
        for state in self.order:  # grows while it is read: breadth first
            for c, step in self.next[state].items():
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[step] = self.next[back].get(c, 0)
                self.order.append(step)
        none = len(patterns)
        # number of the smallest pattern that ends in a state
        self.smallest = [none] * len(self.next)
        for number, state in enumerate(ends):
            self.smallest[state] = number
        for state in self.order:
            self.smallest[state] = min(self.smallest[state], self.smallest[self.fail[state]])
        self.ends = ends
        self.seen: list[str | None] = [None] * len(self.next)

    def _states(self, text: str) -> Iterator[int]:
        state = 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            yield state

    def smallest_inside(self, text: str) -> str | None:
        """The smallest pattern that the text contains."""
        best = min((self.smallest[s] for s in self._states(text)), default=len(self.patterns))
        return self.patterns[best] if best < len(self.patterns) else None

    def see(self, text: str) -> None:
        """Remember the text in every state it passes; texts come in ascending order."""
        for state in self._states(text):
            if self.seen[state] is None:
                self.seen[state] = text

    def smallest_around(self) -> Iterator[tuple[str, str]]:
        """(pattern, smallest text seen that contains it)."""
        for state in reversed(self.order):
            text, back = self.seen[state], self.fail[state]
            if text is not None and (self.seen[back] is None or text < self.seen[back]):
                self.seen[back] = text
        for pattern, state in zip(self.patterns, self.ends, strict=True):
            if self.seen[state] is not None:
                yield pattern, self.seen[state]


def grams(name: str, size: int) -> set[str]:
    return {name[i : i + size] for i in range(len(name) - size + 1)}


def anchor(name: str) -> str:
    """The gram of a pattern that its texts are looked up by; the whole of a shorter one."""
    return min(grams(name, min(GRAM, len(name))), key=lambda g: (zlib.crc32(g.encode()), g))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchor(name) for name in batch.column("name").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["key", "name", "row", "gram"])


def _text_grams(sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["way", "row", "gram"])

        for batch in batches:
            for way, row, name in zip(*(batch.column(c).to_pylist() for c in ("way", "row", "name")), strict=True):
                rows.extend((way, row, g) for size in sizes for g in grams(name, size))
                if len(rows) >= _GRAM_ROWS:
                    yield flush()
        yield flush()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (way, shard, text, name) to (way, name, other)."""
    schema = pa.schema([("way", pa.string()), ("name", pa.string()), ("other", pa.string())])

    def finish() -> Iterator[pa.RecordBatch]:
        if current is not None and current[0] == "around" and automaton is not None:
            found.extend(automaton.smallest_around())
        if found:
            names, others = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([current[0]] * len(found)), pa.array(names), pa.array(others)], schema=schema)

    current, automaton, patterns, found = None, None, [], []
    for batch in batches:
        for way, shard, text, name in zip(*(batch.column(c).to_pylist() for c in ("way", "shard", "text", "name")), strict=True):
            if (way, shard) != current:
                yield from finish()
                current, automaton, patterns, found = (way, shard), None, [], []
            if not text:
                patterns.append(name)
                continue
            if automaton is None:
                automaton = NameAutomaton(patterns)
            if way == "around":
                automaton.see(name)
            elif (inside := automaton.smallest_inside(name)) is not None:
                found.append((name, inside))
    yield from finish()


def contained_names(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(name, inner, outer): for each of ``names`` the smallest of ``keys`` it contains and the smallest that contains it.

    Both inputs are one column of distinct, non-empty texts, called ``name``. Names with neither have no row.
    """
    seen = Observation()
    both = names.select(F.lit(False).alias("key"), "name").unionByName(keys.select(F.lit(True).alias("key"), "name"))
    both = both.withColumn("row", F.monotonically_increasing_id())
    figures = [F.sum(F.length("name")).alias("chars"), *(F.count_if(F.length("gram") == size).alias(f"n{size}") for size in range(1, GRAM + 1))]
    both = both.mapInArrow(_anchors, "key boolean, name string, row bigint, gram string").observe(seen, *figures)
    both = materialise(both, "names-and-keys")
    shards = max(1, -(-(seen.get["chars"] or 0) // SHARD_CHARS))
    sizes = [size for size in range(1, GRAM + 1) if seen.get[f"n{size}"]]
    # every name is a pattern one way and a text the other
    patterns = both.select(F.when(F.col("key"), "inside").otherwise("around").alias("way"), "name", "gram")
    texts = both.select(F.when(F.col("key"), "around").otherwise("inside").alias("way"), "row", "name")
    # patterns of a common anchor are cut into pieces, and a text that has it goes to all of them
    anchors = materialise(
        patterns.groupBy("way", "gram").agg(F.ceil(F.sum(F.length("name")) / SHARD_CHARS).cast("int").alias("pieces")), "anchors"
    )
    shard = lambda piece: F.pmod(F.xxhash64("gram", piece), F.lit(shards)).cast("int").alias("shard")
    piece = F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int")
    placed = patterns.join(anchors, ["way", "gram"]).select("way", shard(piece), F.lit(False).alias("text"), "name")
    asked = texts.mapInArrow(_text_grams(sizes), "way string, row bigint, gram string").join(anchors, ["way", "gram"])
    asked = asked.select("way", "row", "gram", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"))
    routes = asked.select("way", "row", shard(F.col("piece"))).distinct()
    routed = texts.join(routes, ["way", "row"]).select("way", "shard", F.lit(True).alias("text"), "name")
    order = ["way", "shard", "text", "name"]
    stream = placed.unionByName(routed).repartition("way", "shard").sortWithinPartitions(*order).select(*order)
    found = stream.mapInArrow(_match, "way string, name string, other string")
    return found.groupBy("name").agg(
        F.min(F.when(F.col("way") == "inside", F.col("other"))).alias("inner"), F.min(F.when(F.col("way") == "around", F.col("other"))).alias("outer")
    )
