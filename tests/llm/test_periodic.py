"""Periodic runs against brute force over all periods, and the edge cases of the docstring."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from prismcat.llm import periodic
from prismcat.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, collapsed string, _id string, _text string"


def brute_runs(seq, least_words=6, least_periods=4):
    n, found = len(seq), {}
    for q in range(1, n // max(least_periods, 1) + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and seq[i] == seq[i + q]:
                i += 1
            length = i + q - start
            # a period below q of a stretch of two periods divides q, so it was found before
            if length >= 2 * q and not any(s <= start and s + k >= start + length and q % p == 0 for (s, k), p in found.items()):
                found[start, length] = q
    return sorted(((s, k, q) for (s, k), q in found.items() if k >= max(least_words, least_periods * q)), key=lambda r: (r[0], r[2]))


def brute_row(row_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if plant:
        h, n = zlib.crc32(("" if row_id is None else str(row_id)).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(kept)))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_all_runs(letters):
    rng = random.Random(letters)
    for size in [0, 1, 2, 3, *range(4, 60, 3), 300]:
        seq = [rng.randrange(letters) for _ in range(size)]
        assert periodic.all_runs(seq) == brute_runs(seq, 2, 2)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.all_runs(b) == brute_runs(b, 2, 2)
    assert periodic.runs_of(np.array(b * 4)) == brute_runs(b * 4)


def test_runs_behind_the_trigram_filter():
    rng = random.Random(9)
    for _ in range(300):
        seq = []
        while len(seq) < rng.randrange(10, 120):
            root = [rng.randrange(4) for _ in range(rng.randint(1, 5))]
            seq += (root * rng.randint(1, 7))[: rng.randint(1, 30)] if rng.random() < 0.6 else [rng.randrange(50) for _ in range(rng.randint(1, 9))]
        assert periodic.runs_of(np.array(seq)) == brute_runs(seq)


def test_extensions():
    rng = random.Random(3)
    seq = [rng.randrange(3) for _ in range(400)]
    tree = periodic.SuffixTree([*(x + 1 for x in seq), 0])
    suffixes = sorted(range(401), key=lambda i: [x + 1 for x in seq[i:]])
    assert np.argsort(tree.rank).tolist() == suffixes
    i, j = np.array([(a, b) for a in range(0, 400, 7) for b in range(a + 1, 400, 5)]).T
    want = [next((k for k in range(400 - b) if seq[a + k] != seq[b + k]), 400 - b) for a, b in zip(i, j, strict=True)]
    assert tree.common(i, j).tolist() == want


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r.doc_id: tuple(r[c] for c in names) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == {i: brute_row(i, t, True) for i, t in rows}
    assert any(r[0] for r in got.values())


def test_edges(spark):
    long = " ".join("ab"[i % 3 % 2] for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x y x y x y x y z"), (7, long), (8, "ü  " * 6 + "漢 字")]
    docs = spark.createDataFrame([(i, t, "c", "c", "c", "c") for i, t in rows], SCHEMA)
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=lambda r: (r[0] is None, r[0]))
    assert got == [
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (5, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "a"), (7, [(0, 60_000, 3)], "a b a"),
        (8, [(0, 6, 1)], "ü  漢 字"), (None, [(0, 8, 2)], "x y z"),
    ]
    digests = {r.doc_id: r for r in periodic.run_digests(out).collect()}
    assert (digests[1].n_runs, digests[1].start, digests[1].period, digests[1].exponent_milli) == (0, None, None, None)
    assert (digests[7].n_runs, digests[7].length, digests[7].exponent_milli) == (1, 60_000, 20_000_000)
    assert digests[1].runs_sha256 == digests[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_longest_run_of_equals(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b c c c c c c d e e e e e")], "doc_id long, text string")
    row = periodic.run_digests(periodic.periodic_runs(docs)).first()
    assert (row.n_runs, row.start, row.length, row.period) == (2, 0, 6, 1)


def test_empty_table_and_string_ids(spark):
    assert periodic.run_digests(periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    got = periodic.periodic_runs(spark.createDataFrame([("k", "a b " * 4)], "name string, body string"), "name", "body", plant=True).first()
    assert got.name == "k"


def test_least_sizes(spark):
    docs = spark.createDataFrame([(1, "a b a b x x")], "doc_id long, text string")
    got = periodic.periodic_runs(docs, least_words=2, least_periods=2).first().runs
    assert [tuple(r) for r in got] == [(0, 4, 2), (4, 2, 1)]
    with pytest.raises(ValueError, match="two periods"):
        periodic.periodic_runs(docs, least_periods=1)
