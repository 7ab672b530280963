"""Language-model scoring with a hidden Markov model over word classes.

Words are counted over all training documents. Very frequent words are classes of their own, the others
share classes by their ending: P(text) = P(classes) * product of P(word | class). Baum-Welch passes sum
expected counts over all tasks; the scaled forward recursion gives the exact likelihood. Documents run side by side,
token by token; long ones in segments, whose transfer matrices join them with their neighbours, so that segments of a
document see exactly what an unbroken recursion would. Counts of rare words are joined, not broadcast.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import numbered, prepare
from prismcat.session import materialise

STATES = 4
PASSES = 6
# Most words with a class of their own, classes by ending, and words whose counts go to every task.
OWN, ENDINGS, HEAD = 1024, 1024, 1 << 17
END = b"\n"
_SEGMENT, _TOKENS, _FLUSH = 64, 1 << 19, 300_000
# Sequences up to each of these lengths run token by token, many of like length at a time; longer ones in segments.
_LENGTHS = (1024, 16_384)
_ADD = 0.01


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and one end."""
    return [*(text or b"").lower().split(), END]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in batch.column("_text").to_pylist():
            counts.update(tokens(text))
            if len(counts) > _FLUSH:
                yield out()
                counts.clear()
    yield out()


class Classes:
    """Classes of words and what is known of frequent words; bounded by OWN, ENDINGS and HEAD."""

    def __init__(self, head: list[tuple[bytes, int]], own: int, endings: dict[int, tuple[int, int]]):
        self.index = {word: i for i, (word, _) in enumerate(head)}
        self.own = own
        self.size = own + ENDINGS
        counts = np.array([c for _, c in head], np.float64)
        self.log_count = np.log10(counts + 1)
        self.norm = np.zeros(self.size)
        self.weight = np.zeros(self.size)
        self.weight[:own] = counts[:own]
        for e in range(ENDINGS):
            total, kinds = endings.get(e, (0, 0))
            self.norm[own + e] = math.log10(total + kinds + 1)
            self.weight[own + e] = total
        self.cls = np.array([i if i < own else self.ending(w) for i, (w, _) in enumerate(head)], np.int64)

    def ending(self, word: bytes) -> int:
        return self.own + zlib.crc32(word[-3:]) % ENDINGS


def _encode(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Classes = model.value
        get = known.index.get
        for batch in batches:
            rows = []
            for text in batch.column("_text").to_pylist():
                words = tokens(text)
                at = np.array(list(map(get, words, repeat(-1))), np.int64)
                frequent = at >= 0
                classes = np.empty(len(words), np.uint16)
                classes[frequent] = known.cls[at[frequent]]
                rare = [words[i] for i in np.flatnonzero(~frequent).tolist()]
                classes[~frequent] = [known.ending(w) for w in rare]
                counted = known.log_count[at[frequent]]
                shared = at[frequent] >= known.own
                word_sum = counted[shared].sum() - known.norm[classes[classes >= known.own]].sum()
                rows.append((len(words), classes.tobytes(), int(frequent.sum()), float(counted.sum()), float(word_sum), rare))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["_id", "held_out", "n_tokens", "classes", "n_known", "base_sum", "word_sum", "rare"],
            )

    return run


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.of_class = np.ascontiguousarray(emit.T)  # (class, state)

    @classmethod
    def first(cls, weight: np.ndarray, states: int, seed: int = 7) -> Hmm:
        """Shares of the classes, shaken a little differently for every state."""
        rng = np.random.default_rng(seed)
        emit = (weight + _ADD) * rng.uniform(0.5, 1.5, (states, len(weight)))
        move = np.full((states, states), 0.1 / max(states - 1, 1)) + (0.9 - 0.1 / max(states - 1, 1)) * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, flat: np.ndarray, states: int) -> Hmm:
        start, move, emit = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(states, -1)
        norm = lambda x: (x + _ADD) / (x + _ADD).sum(-1, keepdims=True)
        return cls(norm(start), norm(move), norm(emit))


class _Rows:
    """Sequences worked on side by side, the longest first; all that belongs to one position lies together."""

    def __init__(self, model: Hmm, sequences: list[np.ndarray]):
        self.model = model
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences that reach a position
        self.offset = np.cumsum(self.active) - self.active
        position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.x = np.empty(len(position), np.int64)
        self.x[self.offset[position] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate([sequences[i] for i in self.order])
        self.row = np.arange(len(self.x)) - np.repeat(self.offset, self.active)

    def forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State shares after each token, its scale, and the emissions divided by the scales."""
        emitted = self.model.of_class[self.x]
        shares, scales, ones = np.empty_like(emitted), np.empty(len(self.x)), np.ones(len(self.model.start))
        now = np.broadcast_to(self.model.start, (self.active[0], len(ones)))
        for t, (at, n) in enumerate(zip(self.offset.tolist(), self.active.tolist(), strict=True)):
            step = (now[:n] @ self.model.move if t else now) * emitted[at : at + n]
            scale = step @ ones
            step /= scale[:, None]
            shares[at : at + n], scales[at : at + n], now = step, scale, step
        emitted /= scales[:, None]
        return shares, scales, emitted

    def log_likelihood(self) -> np.ndarray:
        """Of each sequence, in the order given."""
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.row, np.log(self.forward()[1]), len(self.order))
        return out

    def expected(self) -> np.ndarray:
        """Expected counts of starts, transitions and emissions, flat."""
        shares, _, emitted = self.forward()
        size = self.model.emit.shape[1]
        behind, back = np.ones_like(shares), self.model.move.T.copy()
        for t in reversed(range(1, len(self.active))):
            at, n, before = self.offset[t], self.active[t], self.offset[t - 1]
            came = emitted[at : at + n]
            came *= behind[at : at + n]
            behind[before : before + n] = came @ back
        first = self.active[0]
        previous = np.repeat(self.offset[:-1], self.active[1:]) + self.row[first:]
        move = shares[previous].T @ emitted[first:] * self.model.move
        shares *= behind
        emit = [np.bincount(self.x, shares[:, s], size) for s in range(shares.shape[1])]
        return np.concatenate([shares[:first].sum(0), move.ravel(), *emit])


class _Batch:
    """Long sequences cut into segments that are worked on side by side."""

    def __init__(self, model: Hmm, sequences: list[np.ndarray]):
        self.model = model
        lengths = np.array([len(s) for s in sequences])
        self.pieces = -(-lengths // _SEGMENT)
        self.first = np.cumsum(self.pieces) - self.pieces
        n = int(self.pieces.sum())
        at = np.arange(_SEGMENT)
        sizes = np.full(n, _SEGMENT)
        sizes[self.first + self.pieces - 1] = lengths - (self.pieces - 1) * _SEGMENT
        self.live = at[:, None] < sizes  # (position, segment)
        self.x = np.zeros((n, _SEGMENT), np.int64)
        self.x[self.live.T] = np.concatenate(sequences)
        self.x = self.x.T.copy()
        self.opening = np.zeros(n, bool)
        self.opening[self.first] = True
        self.e = model.of_class[self.x]  # (position, segment, state)
        self.order = np.argsort(-self.pieces, kind="stable")

    def transfer(self) -> tuple[np.ndarray, np.ndarray]:
        """Product of all steps of each segment, scaled, and the logarithms of the scales."""
        k, n = len(self.model.start), self.x.shape[1]
        p = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        logs = np.zeros(n)
        for t in range(_SEGMENT):
            on = slice(None) if self.live[t].all() else np.flatnonzero(self.live[t])
            if t and not isinstance(on, slice) and not len(on):
                break
            step = p[on]
            moved = (step.reshape(-1, k) @ self.model.move).reshape(step.shape)
            if t == 0:
                moved = np.where(self.opening[:, None, None], step, moved) if isinstance(on, slice) else np.where(self.opening[on][:, None, None], step, moved)
            moved *= self.e[t][on][:, None, :]
            if t % 4 == 3 or t == _SEGMENT - 1:
                scale = moved.max((1, 2))
                moved /= scale[:, None, None]
                logs[on] += np.log(scale)
            p[on] = moved
        return p, logs

    def _active(self, r: int) -> np.ndarray:
        """Sequences with a segment number ``r``."""
        return self.order[: int(np.searchsorted(-self.pieces[self.order], -r, "left"))]

    def chain(self, p: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State shares before each segment, and the log-likelihood of each sequence."""
        k = len(self.model.start)
        now = np.broadcast_to(self.model.start, (len(self.pieces), k)).copy()
        total, before = np.zeros(len(self.pieces)), np.empty((p.shape[0], k))
        for r in range(int(self.pieces.max())):
            on = self._active(r)
            seg = self.first[on] + r
            before[seg] = now[on]
            moved = np.einsum("ni,nij->nj", now[on], p[seg])
            scale = moved.sum(1)
            now[on] = moved / scale[:, None]
            total[on] += np.log(scale) + logs[seg]
        return before, total

    def log_likelihood(self) -> np.ndarray:
        """Of each sequence."""
        return self.chain(*self.transfer())[1]

    def after(self, p: np.ndarray) -> np.ndarray:
        """Backward message behind each segment."""
        k = len(self.model.start)
        now, out = np.ones((len(self.pieces), k)), np.empty((p.shape[0], k))
        for r in reversed(range(int(self.pieces.max()))):
            on = self._active(r)
            seg = self.first[on] + r
            out[seg] = now[on]
            moved = np.einsum("nij,nj->ni", p[seg], now[on])
            now[on] = moved / moved.sum(1, keepdims=True)
        return out

    def expected(self) -> np.ndarray:
        """Expected counts of starts, transitions and emissions, flat."""
        k, n, size = len(self.model.start), self.x.shape[1], self.model.emit.shape[1]
        p, logs = self.transfer()
        before, _ = self.chain(p, logs)
        beta = self.after(p)
        alpha = np.empty((_SEGMENT, n, k))
        now = before.copy()
        for t in range(_SEGMENT):
            step = now @ self.model.move
            if t == 0:
                step[self.opening] = now[self.opening]
            step *= self.e[t]
            step /= step.sum(1, keepdims=True)
            now = np.where(self.live[t][:, None], step, now)
            alpha[t] = now
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
        for t in reversed(range(_SEGMENT)):
            live = np.flatnonzero(self.live[t])
            if not len(live):
                continue
            a, b = alpha[t][live], beta[live]
            share = a * b
            share /= share.sum(1, keepdims=True)
            for s in range(k):
                emit[s] += np.bincount(self.x[t][live], share[:, s], size)
            came = self.e[t][live] * b
            previous = alpha[t - 1][live] if t else before[live]
            inner = np.ones(len(live), bool) if t else ~self.opening[live]
            pulled = came @ self.model.move.T
            weight = previous[inner] / (previous[inner] * pulled[inner]).sum(1, keepdims=True)
            move += weight.T @ came[inner] * self.model.move
            if t == 0:
                start += share[~inner].sum(0)
            pulled /= pulled.sum(1, keepdims=True)
            beta[live] = pulled
        return np.concatenate([start, move.ravel(), emit.ravel()])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row keys and class sequences of like length, a bounded number of tokens at a time (a longer sequence comes alone)."""
    held: list[tuple[list[int], list[np.ndarray]]] = [([], []) for _ in range(len(_LENGTHS) + 1)]
    sizes = [0] * len(held)
    for batch in batches:
        for key, raw in zip(batch.column("_row").to_pylist(), batch.column("classes").to_pylist(), strict=True):
            sequence = np.frombuffer(raw, np.uint16)
            kind = bisect_left(_LENGTHS, len(sequence))
            if held[kind][0] and sizes[kind] + len(sequence) > _TOKENS:
                yield held[kind]
                held[kind], sizes[kind] = ([], []), 0
            held[kind][0].append(key)
            held[kind][1].append(sequence)
            sizes[kind] += len(sequence)
    yield from (group for group in held if group[0])


def _by_length(sequences: list[np.ndarray]) -> Iterator[tuple[type, list[int]]]:
    """The way to work on them and which of the sequences go that way."""
    long = [i for i, s in enumerate(sequences) if len(s) > _LENGTHS[-1]]
    for kind, part in ((_Rows, [i for i, s in enumerate(sequences) if len(s) <= _LENGTHS[-1]]), (_Batch, long)):
        if part:
            yield kind, part


def _expect(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, sequences in _groups(batches):
            for kind, part in _by_length(sequences):
                counts = kind(model.value, [sequences[i] for i in part]).expected()
                total = counts if total is None else total + counts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    return run


def sequence_log10(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each class sequence."""
    out = np.empty(len(sequences))
    for kind, part in _by_length(sequences):
        out[part] = kind(model, [sequences[i] for i in part]).log_likelihood()
    return out / math.log(10)


def _likelihood(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sequences in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sequence_log10(model.value, sequences))], ["_row", "hmm"])

    return run


def word_classes(vocabulary: DataFrame, own: int = OWN, head: int = HEAD) -> tuple[Classes, int]:
    """Classes of ``vocabulary`` (word, c), and the least count of a word that every task knows."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = vocabulary.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()

    def least(most: int) -> int:
        so_far, value = 0, 1 << 62
        for row in levels:  # a few hundred levels
            so_far += row.n
            if so_far > most:
                break
            value = row.least
        return value

    own_least, head_least = least(own), least(head)
    known = [(bytes(r.word), r.c) for r in vocabulary.filter(F.col("c") >= head_least).collect()]  # at most HEAD words
    known.sort(key=lambda x: (-x[1], x[0]))
    ending = F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(ENDINGS))
    rest = vocabulary.filter(F.col("c") < own_least).groupBy(ending.alias("e")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return Classes(known, sum(c >= own_least for _, c in known), {r.e: (r.total, r.kinds) for r in rest.collect()}), head_least


def train(coded: DataFrame, classes: Classes, states: int = STATES, passes: int = PASSES) -> Hmm:
    """Baum-Welch over all rows of ``coded`` (_row, classes)."""
    spark = coded.sparkSession
    model = Hmm.first(classes.weight, states)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)
        sums = coded.mapInArrow(_expect(shared), "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
        if not sums:
            break
        flat = np.zeros(states + states**2 + states * classes.size)
        for k, n in sums:
            flat[k] = n
        model = Hmm.from_counts(flat, states)
    return model


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES,
    folds: int = 7, held_fold: int = 2, own: int = OWN, head: int = HEAD,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    NULL and empty texts are one end token. Documents whose crc32 of the id falls in the held fold are not
    learnt from; a NULL id counts as an empty one. Repeated rows are learnt from and scored each. Other
    columns don't matter. Without training tokens both scores rest on empty counts.
    """
    spark = docs.sparkSession
    prepare(spark)
    number = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(
        F.col(id_col).alias("_id"), (F.pmod(F.crc32(number), F.lit(folds)) == held_fold).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
    )
    counted = texts.filter("NOT held_out").select("_text").mapInArrow(_count_words, "word binary, c long")
    vocabulary = materialise(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    classes, head_least = word_classes(vocabulary, own, head)
    known = spark.sparkContext.broadcast(classes)
    kind = texts.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, held_out boolean, n_tokens long, classes binary, n_known long, base_sum double, word_sum double, rare array<binary>"
    coded = numbered(texts.mapInArrow(_encode(known), schema), "coded")
    model = spark.sparkContext.broadcast(train(coded.filter("NOT held_out").select("_row", "classes"), classes, states, passes))
    likelihood = coded.select("_row", "classes").mapInArrow(_likelihood(model), "_row long, hmm double")
    rare = coded.select("_row", F.explode("rare").alias("word"))
    found = rare.join(vocabulary.filter(F.col("c") < head_least).hint("merge"), "word")
    found = found.groupBy("_row").agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("c") + 1)).alias("rare_sum"))
    out = coded.drop("classes", "rare").join(likelihood, "_row").join(found, "_row", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_sum") + rare_sum - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"),
        (F.col("hmm") + F.col("word_sum") + rare_sum).alias("score"),
    )
