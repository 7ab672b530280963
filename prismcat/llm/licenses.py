"""Licence scan by template markup: wordings with optional and replaceable regions, compiled into token automata.

An automaton has one state for each word of its template, kept as bits of a number. Optional regions are jumps over
their states, replaceable ones a row of states that any word passes; a step for a set of states and a word is worked
out once and then looked up. A text is accepted where every mandatory word stands as the template has it. An
automaton runs only in texts that hold its key, the longest stretch of words which every accepted text must have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import prepare
from prismcat.llm.license_texts import PHRASES, templates

# Score of a text that names a licence without the wording of any template.
PHRASE_SCORE = 0.5
# Bytes of words in lower case, all other ASCII as a blank; bytes beyond ASCII belong to words.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_MARK = re.compile(r"\[\[|\]\]|<<(\w+)(?::(\d+)-(\d+)|=([^>]*))>>")


def words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only): runs of ASCII letters and digits and of everything beyond ASCII."""
    return (text or "").encode().translate(_TO_WORDS).split()


class Automaton:
    """The token automaton of one template."""

    def __init__(self, markup: str):
        self._literal: dict[bytes, int] = {}
        self._any = 0
        self._jumps: list[tuple[int, int]] = []
        # mandatory words before each state
        self.mandatory = [0]
        self.key: list[bytes] = []
        self._compile(markup)
        self.last = len(self.mandatory) - 1
        self._after = self._closures()
        self.start = self._after[0]
        self._steps: dict[tuple[int, bytes | None], int] = {}
        self.openers = {w for w, states in self._literal.items() if states & self.start}
        if self.start & (self._any | 1 << self.last) or not self.key:
            raise ValueError("a template starts with a given word and has a mandatory one")

    def _compile(self, markup: str) -> None:
        open_at: list[int] = []
        stretch: list[bytes] = []

        def state(mandatory: bool) -> int:
            here = len(self.mandatory) - 1
            self.mandatory.append(self.mandatory[-1] + mandatory)
            return here

        def end_stretch() -> None:
            if len(stretch) > len(self.key):
                self.key = stretch.copy()
            stretch.clear()

        at = 0
        for mark in [*_MARK.finditer(markup), None]:
            for word in words(markup[at : mark.start() if mark else len(markup)]):
                self._literal[word] = self._literal.get(word, 0) | 1 << state(not open_at)
                if not open_at:
                    stretch.append(word)
            if mark is None:
                break
            at = mark.end()
            end_stretch()
            if mark[0] == "[[":
                open_at.append(len(self.mandatory) - 1)
            elif mark[0] == "]]":
                self._jumps.append((open_at.pop(), len(self.mandatory) - 1))
            elif mark[4]:
                here = state(not open_at)
                for choice in mark[4].split("|"):
                    (word,) = words(choice)
                    self._literal[word] = self._literal.get(word, 0) | 1 << here
            else:
                low, high = int(mark[2]), int(mark[3])
                first = [state(False) for _ in range(high)]
                end = len(self.mandatory) - 1
                for here in first:
                    self._any |= 1 << here
                    if here - first[0] >= low:
                        self._jumps.append((here, end))
        end_stretch()
        if open_at:
            raise ValueError("an optional region isn't closed")

    def _closures(self) -> list[int]:
        """States reached from each state without a word, itself included; jumps lead forward only."""
        after = [1 << s for s in range(self.last + 1)]
        to: dict[int, list[int]] = {}
        for a, b in self._jumps:
            to.setdefault(a, []).append(b)
        for s in range(self.last, -1, -1):
            for b in to.get(s, ()):
                after[s] |= after[b]
        return after

    def step(self, states: int, word: bytes) -> int:
        """States after a word."""
        given = self._literal.get(word)
        key = (states, word if given else None)
        out = self._steps.get(key)
        if out is None:
            moved, out = (states & ((given or 0) | self._any)) << 1, 0
            while moved:
                low = moved & -moved
                out |= self._after[low.bit_length() - 1]
                moved ^= low
            self._steps[key] = out
        return out

    def run(self, text: list[bytes], at: int) -> tuple[int | None, int]:
        """End of the longest accepted wording that starts at ``at``, and the most mandatory words read from there."""
        states, end, best, final = self.start, None, 0, 1 << self.last
        for i in range(at, len(text)):
            states = self.step(states, text[i])
            if not states:
                break
            best = max(best, self.mandatory[states.bit_length() - 1])
            if states & final:
                end = i + 1
        return end, best

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], float]:
        """Accepted wordings, leftmost longest, and the largest share of mandatory words read from any place."""
        spans, share, at = [], 0.0, 0
        while at < len(text):
            if text[at] in self.openers:
                end, read = self.run(text, at)
                share = max(share, read / self.mandatory[-1])
                if end is not None:
                    spans.append((at, end))
                    at = end
                    continue
            at += 1
        return spans, share


class Scanner:
    """All templates by their keys, and the plain phrases."""

    def __init__(self, wordings: list[tuple[str, str]], phrases: dict[str, str]):
        self.by_key: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, markup in wordings:
            automaton = Automaton(markup)
            self.by_key.setdefault(_padded(automaton.key), []).append((label, automaton))
        self.phrases = [(_padded(words(p)), label) for p, label in phrases.items()]

    def places(self, joined: bytes) -> list[tuple[int, str]]:
        """(byte, label) of each place of a phrase."""
        out = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = joined.find(phrase, at + 1)
        return out

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
        parts = words(text)
        joined = _padded(parts)
        places = self.places(joined)
        first = last = None
        if places:  # a place has one blank before each word before it
            starts = [at for at, _ in places]
            first, last = joined.count(b" ", 0, min(starts)), joined.count(b" ", 0, max(starts))
        base = {label for _, label in places}
        found, share = [], 0.0
        for key, wordings in self.by_key.items():
            if key in joined:
                for label, automaton in wordings:
                    spans, read = automaton.find(parts)
                    found += [(start, end, label) for start, end in spans]
                    share = max(share, read)
        score = 1.0 if found else max(share, PHRASE_SCORE if base else 0.0)
        matches = [{"label": label, "first": start, "last": end - 1} for start, end, label in sorted(found)]
        labels = ",".join(sorted(base | {label for _, _, label in found}))
        return len(parts), len(places), first, last, ",".join(sorted(base)), labels, score, matches


def _padded(parts: list[bytes]) -> bytes:
    return b" " + b" ".join(parts) + b" "


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _MATCHES)
_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


def _scan(wordings: list[tuple[str, str]], phrases: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings, phrases)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column("_text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *map(pa.array, columns, _TYPES)], ["_id", *_NAMES])

    return run


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wordings: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``matches``.

    Base columns tell where the words of a phrase stand one after another, overlaps counted. ``matches`` has label,
    first and last word of every place that a template's automaton accepts, by first word; of one template the
    leftmost longest that don't overlap. ``labels`` has the labels of both. ``score`` is 1 where a template is
    accepted, else the largest share of mandatory words that an automaton reads from one place in a text with its
    key, and at least ``PHRASE_SCORE`` where a phrase stands. NULL and empty texts have no words, empty labels, no
    matches and score 0. Rows are judged each by itself; ids may be NULL or repeated; other columns don't matter.
    """
    prepare(docs.sparkSession)
    wordings = templates() if wordings is None else wordings
    phrases = PHRASES if phrases is None else phrases
    Scanner(wordings, phrases)  # a wrong template is an error before any job
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    columns = (
        f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " matches array<struct<label: string, first: long, last: long>>"
    )
    return texts.mapInArrow(_scan(wordings, phrases), columns).withColumnRenamed("_id", id_col)
