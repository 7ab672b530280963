"""Fill-in-middle: wavelet matrix against counting, cuts against splitting, exact round trips."""

import random
import re

import numpy as np
import pytest

from prismcat.llm import middle
from prismcat.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^ \t\x0b\x0c\r\n]*[ \t\x0b\x0c\r\n]|[^ \t\x0b\x0c\r\n]+"}
TEXTS = ["", "\n", "\n\n", "one", "one\n", "one\ntwo", "a. b! c?\n\n d", "ünï\nçødé 漢字\n𝒳 x", " \t \n", "x" * 5000 + "\n" + "y z. " * 900]


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for size in (0, 1, 7, 8, 9, 500):
        values = rng.integers(0, 8, size).astype(np.uint8)
        matrix = middle.WaveletMatrix(values)
        at = np.arange(size + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == [int((values[:i] == c).sum()) for i in at]
            places = np.flatnonzero(values == c)
            if len(places):
                assert matrix.select(c, np.arange(len(places))).tolist() == places.tolist()


@pytest.mark.parametrize("unit", PATTERNS)
def test_cuts(unit):
    bounds = middle.Boundaries(TEXTS, middle.UNITS[unit])
    units = [re.findall(PATTERNS[unit], t) for t in TEXTS]
    assert bounds.units.tolist() == [len(u) for u in units]
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        k = np.array([int(share * len(u)) for u in units])
        assert bounds.cut(k).tolist() == [len("".join(u[:i])) for u, i in zip(units, k, strict=True)]


def test_classes():
    assert middle.classes("\n .!?aZ5,é\x7f").tolist() == [1, 2, 3, 3, 3, 6, 5, 4, 7, 0, 0]


@pytest.mark.parametrize("unit", PATTERNS)
def test_round_trip(spark, unit):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab<>PSM \n.") for _ in range(rng.randrange(40))) for _ in range(150)] + ["has <P>", "<S>", "x<M>y\nz", "<<P>>", "P>\n<", "S>a\n<S"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = middle.restore(middle.fill_in_middle(docs, unit=unit)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.text == text
        assert (r.form == "plain") == (not text or any(m in text for m in middle.MARKERS))
        if r.form == "plain":
            assert (r.output, r.prefix_chars, r.middle_chars) == (text, None, None)
        else:
            a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
            psm, spm = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
            assert r.output == (psm if r.form == "psm" else spm)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a\nb\nc"), (None, "a\nb\nc"), (5, "only one"), (6, "line\n" * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", "x", 0) for i, t in rows], "doc_id long, text string, form string, output string, n int")
    out = middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.collect()
    assert sorted(((r.doc_id, r.n) for r in got), key=str) == sorted([(1, 0), (2, 0), (None, 3), (None, 3), (5, 1), (6, 30_000)], key=str)
    assert [(r.form, r.output) for r in got if r.doc_id in (1, 2)] == [("plain", "")] * 2
    nulls = [r for r in got if r.doc_id is None]
    assert nulls[0] == nulls[1]
    long = next(r for r in got if r.doc_id == 6)
    first, second = sorted(h % 30_001 for h in middle.draws(6)[:2])
    assert (long.prefix_chars, long.middle_chars) == (5 * first, 5 * (second - first))


def test_shares_and_markers(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = lambda **options: [r.form for r in middle.fill_in_middle(docs, **options).collect()]
    assert set(forms(fim_share=0)) == {"plain"}
    assert 150 < forms(fim_share=50).count("plain") < 250
    assert set(forms(spm_share=0)) == {"psm"}
    marks = ("|pre|>", "|suf|>", "|mid|>")
    with pytest.raises(ValueError, match="markers"):
        middle.fill_in_middle(docs, markers=marks)
    marks = ("~pre>", "~suf>", "~mid>")
    made = middle.restore(middle.fill_in_middle(docs, markers=marks), "back", marks)
    assert {r.back for r in made.collect()} == {f"a{i}\nb\nc" for i in range(400)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert middle.middle_digests(middle.fill_in_middle(docs)).count() == 0


def test_query_rebuilds_every_text(spark):
    rows = QUERIES["op13_fill_in_middle"](spark, SF)
    texts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "sha2(coalesce(text, ''), 256) AS sha")
    assert rows.join(texts, "doc_id").filter("restored_sha256 != sha").count() == 0
