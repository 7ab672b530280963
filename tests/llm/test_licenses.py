"""Licence scan: automata against regular expressions made from the same markup, base columns against splitting."""

import random
import re

import duckdb
import pytest

from prismcat.llm import licenses
from prismcat.llm.license_texts import PHRASES, templates
from prismcat.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expression(markup):
    """The markup as a regular expression over words that each have a blank behind them."""
    out, at = "", 0
    for m in [*re.finditer(r"\[\[|\]\]|<<(\w+)(?::(\d+)-(\d+)|=([^>]*))>>", markup), None]:
        out += "".join(re.escape(w) + " " for w in brute_words(markup[at : m.start() if m else len(markup)]))
        if m:
            at = m.end()
            out += "(?:" if m[0] == "[[" else ")?" if m[0] == "]]" else f"(?:{m[4]}) " if m[4] else rf"(?:\S+ ){{{m[2]},{m[3]}}}"
    return out


def instance(markup, rng):
    """A text that the template accepts."""
    out, keep, at = [], [True], 0
    for m in [*re.finditer(r"\[\[|\]\]|<<(\w+)(?::(\d+)-(\d+)|=([^>]*))>>", markup), None]:
        if keep[-1]:
            out.append(markup[at : m.start() if m else len(markup)])
        if m:
            at = m.end()
            if m[0] == "[[":
                keep.append(keep[-1] and rng.random() < 0.5)
            elif m[0] == "]]":
                keep.pop()
            elif keep[-1]:
                out.append(" " + rng.choice(m[4].split("|")) + " " if m[4] else " " + " ".join(rng.choice(["Jane", "Doe", "ACME", "Ünï"]) for _ in range(rng.randint(int(m[2]), int(m[3])))) + " ")
    return "".join(out)


def brute_scan(text):
    words = brute_words(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {label for _, label in places}
    joined = "".join(w + " " for w in words)
    found = {label for label, markup in templates() if re.search(r"(?:^|(?<= ))" + expression(markup), joined)}
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), bool(found)


def test_every_template_accepts_its_texts():
    rng, scanner = random.Random(4), licenses.Scanner(templates(), PHRASES)
    for label, markup in templates():
        text = instance(markup, rng)
        *_, labels, score, matches = scanner.scan(f"Some words before. {text} And some behind")
        assert label in labels.split(",") and score == 1.0
        hit = next(m for m in matches if m["label"] == label)
        assert hit["first"] == 3


def test_a_changed_mandatory_word_is_refused():
    rng = random.Random(5)
    for label, markup in templates()[:1] + templates()[2:8]:
        scanner = licenses.Scanner([(label, markup)], {})
        plain = re.sub(r"\[\[.*?\]\]", " ", markup, flags=re.S)
        words = brute_words(re.sub(r"<<\w+:\d+-\d+>>", " acme ", re.sub(r"<<\w+=([^|>]*)[^>]*>>", r" \1 ", plain)))
        assert scanner.scan(" ".join(words))[6] == 1.0
        for _ in range(8):
            at = rng.randrange(len(words))
            if words[at] != "acme" and words[max(at - 1, 0)] != "acme" and words[min(at + 1, len(words) - 1)] != "acme":
                changed = scanner.scan(" ".join([*words[:at], "otherwise", *words[at + 1 :]]))
                assert changed[6] < 1.0 and changed[7] == []


def test_automaton_equals_expression():
    rng = random.Random(6)
    markups = ["a [[b [[c]]]] <<x:0-2>> d", "a <<x:1-3>> b a", "a <<x=b|c>> [[d a]] b", "[[a b]] b [[<<x:0-1>> c]] a", "a a"]
    for markup in markups:
        automaton, pattern = licenses.Automaton(markup), re.compile(expression(markup))
        for _ in range(400):
            words = [rng.choice("abcd") for _ in range(rng.randrange(12))]
            joined = "".join(w + " " for w in words)
            for at in range(len(words)):
                ends = [e for e in range(at, len(words) + 1) if pattern.fullmatch(joined[2 * at : 2 * e])]
                if words[at].encode() in automaton.openers:
                    assert automaton.run([w.encode() for w in words], at)[0] == (ends[-1] if ends else None)
                else:
                    assert not ends


def test_query_equals_brute_force(spark):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: (*(r[c] for c in names), r.score == 1.0) for r in QUERIES["op11_license_scan"](spark, SF).collect()}
    assert got == {i: brute_scan(t) for i, t in rows}
    assert any(r[5] != r[4] for r in got.values())


def test_planted_texts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        parts = ["lorem ipsum " * rng.randrange(20), *(rng.choice([instance(rng.choice(templates())[1], rng), rng.choice(list(PHRASES)).title(), "CC-BY x"]) for _ in range(rng.randrange(3)))]
        rng.shuffle(parts)
        rows.append((i, ". ".join(parts)))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score == 1.0) == brute_scan(text)


def test_edges(spark):
    long = "word " * 50_000 + "Released under the MIT License."
    rows = [(1, None), (2, ""), (None, "the apache-license, APACHE LICENSE"), (4, long), (4, long), (5, "CC BY BY cc by"), (6, "Mit Licenses; ämit license")]
    docs = spark.createDataFrame([(i, t, "x", 1.0, "x") for i, t in rows], "doc_id long, text string, labels string, score double, _id string")
    got = sorted(licenses.license_scan(docs).collect(), key=lambda r: str(r.doc_id))
    short = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got]
    assert short == [
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0),
        (4, 50_005, 1, 50_003, 50_003, "mit", "mit", 1.0), (4, 50_005, 1, 50_003, 50_003, "mit", "mit", 1.0),
        (5, 5, 2, 0, 3, "cc-by", "cc-by", 0.5), (6, 4, 0, None, None, "", "", 0.0), (None, 5, 2, 1, 3, "apache", "apache", 0.5),
    ]
    assert [tuple(m) for m in got[2].matches] == [("mit", 50_000, 50_004)]


def test_share_of_a_cut_text():
    markup = "one two three four [[five]] six"
    scanner = licenses.Scanner([("x", markup)], {})
    assert scanner.scan("zero one two three four nine")[6] == pytest.approx(4 / 5)
    assert scanner.scan("one two nine")[6] == 0.0


def test_wrong_templates():
    for markup in ("[[a", "<<x:0-3>> a", "[[a]]"):
        with pytest.raises(ValueError):
            licenses.Automaton(markup)


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
