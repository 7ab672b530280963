"""Splits of one JSON array against reading it whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prismcat.sources.json_arrays import read_array_elements


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def values(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choice('ab{}[],:"\\ \nü漢') for _ in range(rng.randrange(20)))
    if kind < 4:
        return rng.choice([None, True, 17, -2.5, "", "plain"])
    if kind == 4:
        return [values(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": values(rng, depth + 1) for i in range(rng.randrange(5))}


def read(spark, path):
    return sorted(json.dumps(json.loads(r["item"])) for r in read_array_elements(spark, str(path)).collect())


@pytest.mark.parametrize("size", [61, 100_000])
@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_split_arrays(spark, tmp_path, small_splits, size, layout):
    rng = random.Random(size)
    want = []
    for name in ("a", "b"):
        items = [values(rng) for _ in range(25)] + ["x" * 300, {"s": 'brace } and "quote\\"'}]
        (tmp_path / f"{name}.json").write_text("\n " + json.dumps(items, **layout) + "\n", encoding="utf-8")
        want += [json.dumps(i) for i in items]
    small_splits(size)
    assert read(spark, tmp_path) == sorted(want)


def test_several_tasks_read_one_file(spark, tmp_path, small_splits):
    items = [{"id": i, "text": "t" * (i % 50)} for i in range(2000)]
    (tmp_path / "big.json").write_text(json.dumps(items))
    small_splits(8_000)
    text = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert text.select(F.spark_partition_id()).distinct().count() > 5
    assert read(spark, tmp_path) == sorted(map(json.dumps, items))


ODD = [
    ("", []), ("[]", []), (" [ ] ", []), ("[1]", [1]), ("[1, [2, {\"a\": [3]}], {}]", [1, [2, {"a": [3]}], {}]), ('{"a": 1, "b": [2, 3]}', []),
    ("no json, at all", []), ("[null, \"}\"]\n", [None, "}"]), ("\ufeff[7, 8]", [7, 8]), ("[{\"a\": 1}", [{"a": 1}]),
]


def test_odd_files(spark, tmp_path, small_splits):
    for i, (text, _) in enumerate(ODD):
        (tmp_path / f"x{i}.json").write_text(text, encoding="utf-8")
    small_splits(3)
    assert read(spark, tmp_path) == sorted(json.dumps(v) for _, want in ODD for v in want)


def test_many_splits_share_a_task(spark, tmp_path, small_splits):
    """Far more splits than cores: the passes write no file for each of them, and every element is read once."""
    from prismcat.sources import json_arrays

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"id": i, "t": "x" * (i % 90)} for i in range(3000)]))
    small_splits(300)
    text = spark.read.option("lineSep", "}").text(str(tmp_path / "in"))
    assert text.rdd.getNumPartitions() > 400
    most = max(4 * spark.sparkContext.defaultParallelism, -(-text.rdd.getNumPartitions() // 128))
    elements = read_array_elements(spark, str(tmp_path / "in"))
    assert len({f for f in elements.inputFiles()}) <= 2 * most
    assert json_arrays._grouped(text).rdd.getNumPartitions() <= most
    assert sorted(json.loads(r["item"])["id"] for r in elements.collect()) == list(range(3000))
