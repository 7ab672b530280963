"""Fill-in-middle: texts cut at two unit boundaries, their parts put in another order between markers.

The characters of several texts are read as a sequence of character classes, and a wavelet matrix over it tells
how many characters of a class stand before a place (rank) and where the k-th of them stands (select). Boundaries
before a place are a sum of ranks; a cut is a select where one class ends a unit, a bisection on that sum where
several do. No text is ever split into its units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import prepare, unused

OTHER, NEWLINE, BLANK, STOP, DIGIT, UPPER, LOWER, MARK = range(8)
_LEVELS = 3
# Classes whose characters end a unit.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, BLANK)}
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
# Characters that share a wavelet matrix; a longer text has one of its own.
_SHARE = 1 << 21


def _class_table() -> np.ndarray:
    table = np.full(128, OTHER, np.uint8)
    codes = np.arange(128)
    for low, high, kind in ((33, 126, MARK), (ord("0"), ord("9"), DIGIT), (ord("A"), ord("Z"), UPPER), (ord("a"), ord("z"), LOWER)):
        table[(codes >= low) & (codes <= high)] = kind
    table[[ord(c) for c in " \t\x0b\x0c\r"]] = BLANK
    table[[ord(c) for c in ".!?"]] = STOP
    table[ord("\n")] = NEWLINE
    return table


_TABLE = _class_table()
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
# Ones among the first k bits of a byte, and where its k-th one or zero stands.
_ONES_BEFORE = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(_ONES, axis=1, dtype=np.int64)], axis=1)
_NTH = {bit: np.argsort(_ONES != bit, axis=1, kind="stable") for bit in (0, 1)}


def classes(text: str) -> np.ndarray:
    """The class of every code point; those beyond ASCII are ``OTHER``."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], OTHER).astype(np.uint8)


class Bits:
    """A bit vector with rank and select: packed bits and the ones before every byte."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.concatenate([np.packbits(bits), np.zeros(1, np.uint8)])
        ones = _ONES_BEFORE[self.packed, 8]
        self.ones = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        return self.ones[at >> 3] + _ONES_BEFORE[self.packed[at >> 3], at & 7]

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one or zero, from 0."""
        before = self.ones if bit else 8 * np.arange(len(self.ones)) - self.ones
        byte = np.searchsorted(before, k, side="right") - 1
        return 8 * byte + _NTH[bit][self.packed[byte], k - before[byte]]


class WaveletMatrix:
    """Rank and select of class values below ``2 ** levels``, all for arrays of queries."""

    def __init__(self, values: np.ndarray, levels: int = _LEVELS):
        self.size, self.levels = len(values), []
        for level in reversed(range(levels)):
            bits = (values >> level) & 1
            self.levels.append((level, Bits(bits)))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def _down(self, value: int, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.rank(at)
            at = bits.zeros + ones if value >> level & 1 else at - ones
        return at

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How many characters of a class stand before each place."""
        return self._down(value, at) - self._down(value, np.zeros(1, np.int64))

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Where the k-th character of a class stands, from 0."""
        at = self._down(value, np.zeros(1, np.int64)) + k
        for level, bits in reversed(self.levels):
            at = bits.select(1, at - bits.zeros) if value >> level & 1 else bits.select(0, at)
        return at


class Boundaries:
    """Units of texts that stand one after another: text ``t`` is ``[starts[t], ends[t])``."""

    def __init__(self, texts: list[str], enders: tuple[int, ...]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        values = classes("".join(texts))
        self.matrix, self.enders = WaveletMatrix(values), enders
        self.before = self.count(self.starts)
        self.closed = self.count(self.ends) - self.before
        last = values[np.maximum(self.ends - 1, 0)] if len(values) else np.zeros(len(texts), np.uint8)
        # characters after the last boundary are a unit too
        self.units = self.closed + ((sizes > 0) & ~np.isin(last, enders))

    def count(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, at) for c in self.enders)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Length of each text's first ``k`` units."""
        out = np.where(k == 0, 0, self.ends - self.starts)
        inner = np.flatnonzero((k > 0) & (k <= self.closed))
        wanted = self.before[inner] + k[inner]
        if len(self.enders) == 1:
            ends = self.matrix.select(self.enders[0], wanted - 1) + 1 if len(inner) else wanted
        else:
            low, ends = self.starts[inner], self.ends[inner]
            while (low < ends).any():  # the first place with that many boundaries before it
                middle = (low + ends) // 2
                enough = self.count(middle) >= wanted
                low, ends = np.where(enough, low, np.minimum(middle + 1, ends)), np.where(enough, middle, ends)
        out[inner] = ends - self.starts[inner]
        return out


def draws(row_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 that depend on the id alone; an id of None is written as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def _shares(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > _SHARE:
            yield slice(start, at)
            start, size = at, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))


def _transform(unit: str, markers: tuple[str, str, str], seed: int, fim_share: int, spm_share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    p, s, m = markers

    def rows(ids: list, texts: list[str]) -> Iterator[tuple]:
        bounds = Boundaries(texts, UNITS[unit])
        drawn = [draws(i, seed) for i in ids]
        picked = np.array([d[:2] for d in drawn], np.int64).reshape(-1, 2) % (bounds.units + 1)[:, None]
        first, second = (bounds.cut(k).tolist() for k in (picked.min(1), picked.max(1)))
        for text, n, a, b, (_, _, h3, h4) in zip(texts, bounds.units.tolist(), first, second, drawn, strict=True):
            if not text or h3 % 100 >= fim_share or any(x in text for x in markers):
                yield n, "plain", None, None, text
            elif h4 % 100 < spm_share:
                yield n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
            else:
                yield n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("_id"), [t or "" for t in batch.column("_text").to_pylist()]
            for share in _shares(texts):
                columns = zip(*rows(ids[share.start : share.stop].to_pylist(), texts[share]), strict=True)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids[share.start : share.stop], *arrays], ["_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", markers: tuple[str, str, str] = MARKERS,
    seed: int = SEED, fim_share: int = 100, spm_share: int = 50,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` text.

    ``unit`` is "line", "sentence" or "word"; a unit reaches up to and with the character that ends it, and what
    follows the last such character is one more. Both cuts and the form are drawn from the id and the seed, so
    rows of one id and text give equal rows. ``fim_share`` and ``spm_share`` are in per cent. Texts that hold a
    marker, NULL (as empty) and empty texts stay plain: the output is the text, both lengths are NULL. A text
    with one unit can have empty parts. An id of NULL draws like an empty text. Other columns don't matter.
    """
    if any(x[:1] in x[1:] for x in markers) or len({x[:1] for x in markers}) > 1 or len(set(markers)) < 3 or not all(markers):
        raise ValueError("markers must differ and share a first character that is nowhere else in them")
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    columns = f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return texts.mapInArrow(_transform(unit, markers, seed, fim_share, spm_share), columns).withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of that form was made from."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in markers), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def restore(made: DataFrame, text_col: str = "text", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``made`` (with ``output`` and ``form``) and the texts it came from as another column."""
    return made.withColumn(unused(made, text_col), restored(F.col("output"), F.col("form"), markers))


def middle_digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The outputs and the texts rebuilt from them as digests."""
    digest = lambda text: F.sha2(F.encode(text, "utf-8"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))
