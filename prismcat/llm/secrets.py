"""Secret scan: fixed patterns, and Markov models of random strings and ordinary identifiers.

Two character Markov chains are trained on labelled samples: random strings over the alphabets that keys are written
in, and identifiers put together from words of the corpus. A long token outside the patterns' spans is
reported when its log-likelihood ratio between the chains passes a cut that is set on samples held out. Only a bounded
sample of words reaches the driver; every text is scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcat.llm.common import prepare

# The patterns, and the least lengths of what they find.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, so shorter ones needn't be visited
KINDS = ("assign", "access", "hex", "random")
_ASSIGN_LEAST, _ACCESS_LEAST = 12, 18

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Distinct words of the corpus that identifiers are made of, the first by hash; labelled samples of each kind.
VOCABULARY = 20_000
SAMPLES = 20_000
# Every fifth sample is held out. The cut keeps this share of held-out secrets of the shortest length,
# but lets at most that share of held-out identifiers pass.
RECALL = 0.95
FALSE_POSITIVES = 0.0005
_SHORTEST = 16
# Alphabets that keys are written in.
ALPHABETS = (
    string.ascii_letters + string.digits,
    string.ascii_letters + string.digits + "+/",
    string.ascii_letters + string.digits + "-_",
    string.ascii_lowercase + string.digits,
    string.ascii_uppercase + string.digits,
    "0123456789ABCDEF",
    string.ascii_letters,
)
# Weight of a character's own frequency against the transitions counted.
_BACK_OFF = 8.0
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_STATES = len(_CHARS) + 2  # start, any other
_STATE = np.full(256, _STATES - 1, np.int64)
_STATE[np.frombuffer(_CHARS.encode(), np.uint8)] = 1 + np.arange(len(_CHARS))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in order."""
    spans = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= _ASSIGN_LEAST:
            spans.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, _ACCESS, _ACCESS_LEAST), (2, _HEX, 0)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def other_tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Long tokens that no span touches."""
    at = 0
    ends = sorted((s, e) for s, _, e in spans)
    for m in TOKEN.finditer(text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if not any(s < m.end() and e > m.start() for s, e in ends[at : at + len(KINDS)]):
            yield m


def transitions(token: str) -> np.ndarray:
    """Codes of the chain's steps through ``token``, from the start state on."""
    states = np.concatenate([[0], _STATE[np.frombuffer(token.encode("ascii"), np.uint8)]])
    return states[:-1] * _STATES + states[1:]


def random_sample(rng: random.Random, alphabet: str, longest: int = 64) -> str:
    """A labelled secret: 16 or more characters, each drawn alike."""
    return "".join(rng.choices(alphabet, k=rng.randint(_SHORTEST, longest)))


def identifier_sample(rng: random.Random, words: list[str]) -> str:
    """A labelled identifier of 16 characters or more, in one of the usual ways of writing them."""
    drawn = rng.choices(words, k=rng.randint(2, 6))
    style = rng.randrange(10)
    if style == 0:  # rulers
        return rng.choice("-=_+/" * 4 + string.ascii_letters + string.digits) * rng.randint(16, 64)
    if style == 1:  # dates with a name
        drawn = [drawn[0], f"{rng.randint(1990, 2039)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", *drawn[1:]]
    elif style == 2:  # versions and numbers
        drawn = [drawn[0], str(rng.randint(0, 10 ** rng.randint(1, 4))), *drawn[1:]]
    elif style == 3:
        drawn = [w.upper() for w in drawn]
    elif style in (4, 5):
        drawn = [w.upper() if rng.random() < 0.2 else w.capitalize() for w in drawn]
    elif style == 6:
        drawn = [drawn[0], *(w.capitalize() for w in drawn[1:])]
    token = rng.choice(("_", "-", "/", "", "")).join(drawn)
    while len(token) < _SHORTEST:
        token += rng.choice(words)
    return token


def train(words: list[str], samples: int = SAMPLES, seed: int = 0) -> tuple[np.ndarray, float]:
    """Log-likelihood ratio of every transition, and the least ratio of a token that is reported.

    The cut is the highest that keeps RECALL of the held-out secrets, raised until no more than FALSE_POSITIVES of
    the held-out identifiers pass, and never below zero. Without words nothing can be told apart and nothing is reported.
    """
    if not words:
        return np.zeros(_STATES * _STATES), np.inf
    rng = random.Random(seed)
    counts = np.zeros((2, _STATES * _STATES))
    held_out = []
    for i in range(samples):
        alphabet, apart = ALPHABETS[i % len(ALPHABETS)], i % 5 == 4
        pair = transitions(random_sample(rng, alphabet, _SHORTEST if apart else 64)), transitions(identifier_sample(rng, words))
        if apart:
            held_out.append(pair)
        else:
            for kind, steps in enumerate(pair):
                np.add.at(counts[kind], steps, 1)
    ratio = log_ratio(counts)
    secrets, names = ([ratio[steps].sum() for steps in side] for side in zip(*held_out, strict=True))
    return ratio, max(0.0, float(np.quantile(secrets, 1 - RECALL)), float(np.quantile(names, 1 - FALSE_POSITIVES)))


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> list[str]:
    """Words of 2 to 12 letters that stand twice or more anywhere in ``texts``, the first ``size`` by hash."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(r"\b[a-z]{2,12}\b"), F.lit(0))).alias("word"))
    often = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return [r.word for r in often.orderBy(F.xxhash64("word"), "word").limit(size).collect()]


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, random against ordinary, of every transition.

    Each chain backs off to how frequent a character is in its samples, so that characters which
    ordinary tokens hardly have speak for themselves.
    """
    grid = counts.reshape(2, _STATES, _STATES).astype(float)
    single = grid.sum(1) + 1.0
    single /= single.sum(1, keepdims=True)
    chains = (grid + _BACK_OFF * single[:, None, :]) / (grid.sum(2, keepdims=True) + _BACK_OFF)
    logs = np.log(chains)
    return (logs[0] - logs[1]).ravel()


def random_tokens(text: str, spans: list[tuple[int, int, int]], ratio: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    out = []
    for m in other_tokens(text, spans):
        if float(ratio[transitions(m[0])].sum()) > least:
            out.append((m.start(), len(KINDS) - 1, m.end()))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _scan(ratio: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("_text").to_pylist():
                spans = pattern_spans(text or "")
                found = random_tokens(text or "", spans, ratio, least)
                kinds = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                rows.append((*kinds, len(found), hashlib.sha256(_join(spans).encode()).hexdigest(), _join(spans + found)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``, ``spans``.

    Spans are kind:start:end in code points, end exclusive, by start and kind. NULL and empty texts have
    none. Rows are judged each by itself, so repeated rows give repeated results; other columns don't
    matter. A corpus without repeated words has no random spans: identifiers can't be learnt from it.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ratio, least = train(vocabulary(texts))
    kind = texts.schema["_id"].dataType.simpleString()
    columns = f"_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return texts.mapInArrow(_scan(ratio, least), columns).withColumnRenamed("_id", id_col)
