"""The corpus pipeline, stage by stage on planted documents, each stage against a brute-force reading of its own input."""

import random
import re

import pytest

import corpus_pipeline

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice(["ba", "lo", "mi", "tu", "re", "sa", "no"]) for _ in range(RNG.randint(1, 3))) for _ in range(60)]
ITEM = " ".join(RNG.choice(VOCABULARY) for _ in range(14))
BLOCK = "\n".join(" ".join(RNG.choice(VOCABULARY) for _ in range(9)) for _ in range(30))


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def planted():
    rows = [(i, prose(90)) for i in range(480)]
    base = [RNG.choice(VOCABULARY) for _ in range(500)]
    rows += [(500 + c, " ".join([*base[: 100 * c], RNG.choice(VOCABULARY), *base[100 * c + 1 :]])) for c in range(4)]
    rows += [(510 + c, f"{prose(20)}\n{BLOCK}\n{prose(20)}") for c in range(4)]
    rows += [(520 + c, f"{prose(40)} {ITEM} {prose(40)}") for c in range(3)]
    rows += [(530 + c, "".join(RNG.choice("qxzj#$%") for _ in range(400))) for c in range(10)]
    return rows + [(540, None), (541, "")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that each stage read and returned, and those of run()."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in planted()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage-{number}"
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect(), docs.columns, after.columns
        docs = after
    out["run"] = corpus_pipeline.run(spark, folder).collect()
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_run_is_its_stages(stages):
    assert sorted(stages["run"]) == sorted(stages["mixing"][1])


def test_columns_stay(stages):
    assert all(stages[name][2] == stages[name][3] for name, _ in corpus_pipeline.STAGES[:-1])


def test_quality_stage(stages):
    before, after = texts(stages["quality classifier"][0]), texts(stages["quality classifier"][1])
    assert all(before[i] == t for i, t in after.items())
    assert not any(i in after for i in [*range(530, 540), 540, 541])
    assert sum(i in after for i in range(480)) > 0.9 * 480


def test_line_stage(stages):
    before, after = texts(stages["line dedup"][0]), texts(stages["line dedup"][1])
    assert all(after.get(i) == t for i, t in before.items() if "\n" not in t)
    blocks = [i for i in range(510, 514) if i in before]
    assert len(blocks) > 1 and sum(BLOCK in after[i] for i in blocks) == 1
    for i in blocks:
        lines, left = before[i].split("\n"), after[i].split("\n")
        at = iter(lines)
        assert all(line in at for line in left)  # the lines that are left, in their order
        assert left[0] == lines[0] and left[-1] == lines[-1]


def test_near_duplicate_stage(stages):
    before, after = texts(stages["simhash near dedup"][0]), texts(stages["simhash near dedup"][1])

    def shingles(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t in before.items()}
    near = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {i for p in near for i in p} >= {500, 501, 502, 503}
    assert not any(i in after and j in after for i, j in near)
    alone = set(before) - {i for p in near for i in p}
    assert alone <= set(after) and sum(i in after for i in range(500, 504)) == 1


def test_benchmark_stage(stages):
    before, after = texts(stages["benchmark decontamination"][0]), texts(stages["benchmark decontamination"][1])

    def windows(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        return {tuple(words[k : k + 10]) for k in range(len(words) - 9)}

    leaks = {i for i, t in before.items() if windows(t) & windows(ITEM)}
    assert leaks and leaks <= {520, 521, 522}
    assert after == {i: t for i, t in before.items() if i not in leaks}


def test_mixing_stage(stages):
    before, after = stages["mixing"][:2]
    sizes = {r.doc_id: len(r.text.split()) for r in before}
    assert {r.doc_id: r["size"] for r in after} == sizes
    totals = {s: sum(sizes[r.doc_id] for r in before if r.source == s) for s in "ab"}
    # weights 3 and 1 share 150 %, no target above twice its source's size
    want = {"a": min(1.5 * sum(totals.values()) * 3 / 4, 2 * totals["a"])}
    want["b"] = 1.5 * sum(totals.values()) - want["a"]
    source = {r.doc_id: r.source for r in before}
    for s in "ab":
        mine = [r for r in after if source[r.doc_id] == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == totals[s] and r.taken <= 2 * r["size"] for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(want[s], rel=0.02)
