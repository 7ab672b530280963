"""Names inside names: automaton and shards against comparing all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from prismcat.operators import containment as C
from prismcat.operators.match import match_names


def brute(names, keys):
    out = {}
    for n in names:
        inner, outer = min((k for k in keys if k in n), default=None), min((k for k in keys if n in k), default=None)
        if inner or outer:
            out[n] = (inner, outer)
    return out


def column(spark, values):
    return spark.createDataFrame([(v,) for v in sorted(values)], "name string")


def words(rng, letters, n, longest):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)}


def test_automaton():
    rng = random.Random(2)
    for _ in range(40):
        patterns, texts = sorted(words(rng, "abü", 30, 5)), sorted(words(rng, "abüc", 30, 12))
        automaton = C.NameAutomaton(patterns)
        assert [automaton.smallest_inside(t) for t in texts] == [min((p for p in patterns if p in t), default=None) for t in texts]
        for t in texts:
            automaton.see(t)
        want = {p: min((t for t in texts if p in t), default=None) for p in patterns}
        assert dict(automaton.smallest_around()) == {p: t for p, t in want.items() if t}


def test_anchor_is_in_every_text_around():
    rng = random.Random(3)
    for name in words(rng, "abc", 200, 9):
        size = min(C.GRAM, len(name))
        assert C.anchor(name) in C.grams("xy" + name + "z", size)


@pytest.mark.parametrize("shard_chars", [5, 60, 250_000])
def test_shards_agree_with_pairs(spark, monkeypatch, shard_chars):
    monkeypatch.setattr(C, "SHARD_CHARS", shard_chars)
    rng = random.Random(4)
    names, keys = words(rng, "abc", 60, 7), words(rng, "abc", 60, 7) | {"aaaa" + "b" * i for i in range(30)}  # one anchor shared by many
    names -= keys
    got = {r["name"]: (r["inner"], r["outer"]) for r in C.contained_names(column(spark, names), column(spark, keys)).collect()}
    assert got == brute(names, keys)


def test_long_names_in_linear_time():
    """Every prefix of a long name is a pattern, so 1,200 of them end in it and hold each other."""
    name = "".join(random.Random(5).choice("ab") for _ in range(1200))
    start = time.perf_counter()
    automaton = C.NameAutomaton(sorted(name[:i] for i in range(1, 1201)))
    automaton.see(name)
    assert len(dict(automaton.smallest_around())) == 1200
    assert automaton.smallest_inside(name * 50) == min(name[:i] for i in range(1, 1201))
    assert time.perf_counter() - start < 2.0


def test_match_of_a_long_name(spark):
    long = "".join(random.Random(6).choice("abcdefgh ") for _ in range(1200)).strip()
    queries = spark.createDataFrame([(1, long), (2, "x" + long), (3, long[100:900]), (4, ""), (5, None), (6, long[100:900])], "query_id int, query_name string")
    refs = spark.createDataFrame([(1, long), (2, "zz"), (3, None), (4, "")], "ref_id int, ref_name string")
    match_names(queries, refs).count()  # warm
    start = time.perf_counter()
    got = {r["query_id"]: (r["ref_id"], r["how"]) for r in match_names(queries, refs).collect()}
    assert got == {1: (1, "exact"), 2: (1, "contains"), 3: (1, "contains"), 4: (None, "none"), 5: (None, "none"), 6: (1, "contains")}
    assert time.perf_counter() - start < 30


def test_rows_stay_linear(spark):
    """A text reaches a shard once, whatever it shares with it; a third of the names are copies of one stem."""
    names = column(spark, {f"stem {i}" for i in range(300)})
    keys = column(spark, {f"the stem {i} of" for i in range(300)} | {f"other{i}" for i in range(300)})
    found = C.contained_names(names, keys)
    assert found.count() == 300 and found.where(F.col("outer").isNull()).count() == 0
