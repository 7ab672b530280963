"""Scans and sinks on small files."""

import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from prismcat import schemas
from prismcat.functions import columns as C
from prismcat.operators import catalogue as K
from prismcat.session import scratch_path
from prismcat.sources import files, images, keyed, reports, store
from prismcat.streaming.catalogue_stream import card_stream, fold_into_catalogue


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


CARDS = [
    {"id": "a", "oracle_id": "o1", "name": "Alpha", "set": "m20", "lang": "en", "cmc": 1.5, "colors": ["R"],
     "image_uris": {"large": "u"}, "prices": {"usd": "1.25", "eur": "", "tix": None}},
    {"id": "", "name": "No id", "lang": "en", "image_uris": {"large": "u"}},
    {"id": "b", "name": "Faces", "lang": "de", "card_faces": [{"image_uris": {"normal": "f"}}]},
    {"id": "c", "name": "French", "lang": "fr", "image_uris": {"large": "u"}},
    {"id": "d", "name": "Bare", "lang": "en"},
]


@pytest.mark.parametrize("layout", ["array", "array_lines", "lines"])
def test_card_scan(spark, tmp_path, layout):
    if layout == "array":
        text = json.dumps([*CARDS, "no object"], indent=1)
    elif layout == "array_lines":
        text = "[\n" + ",\n".join(json.dumps(c) for c in CARDS) + ",\n12\n]\n"
    else:
        text = "\n".join([*(json.dumps(c) for c in CARDS), "{broken"])
    raw = files.read_cards(spark, write(tmp_path / "cards.json", text), layout).cache()
    assert files.broken_records(raw).count() == 1
    flat = {r["print_id"]: r for r in K.flatten_cards(raw).collect()}
    assert set(flat) == {"a", "b", "c", "d"}
    assert flat["a"]["price_usd"] == 1.25 and flat["a"]["price_eur"] is None and flat["a"]["colors"] == ["R"]
    assert K.rejected_cards(raw.where("name IS NOT NULL")).count() == 1
    assert {r["id"] for r in K.importable(raw, C.PRINT_LANGUAGES).collect()} == {"a", "", "b"}
    assert {r["id"] for r in K.importable(raw, []).collect()} == {"a", "", "b", "c"}


def test_latest_snapshot_does_not_read_content(spark, tmp_path):
    for name in ["default_cards-20240101.json", "default_cards-20240301.json", "rulings-20230101.json", "notes.txt"]:
        write(tmp_path / name, "not even json")
    got = {r["type"]: r["file_name"] for r in files.latest_snapshots(files.list_files(spark, str(tmp_path), "*.json")).collect()}
    assert got == {"default_cards": "default_cards-20240301.json", "rulings": "rulings-20230101.json"}


def test_inventory_with_bom_and_quotes(spark, tmp_path):
    text = '﻿Name,Set code,Scryfall ID,Quantity\r\n"Fire, Ice",M20,abc,1\r\nBolt, LEA ,,2\r\n,,,1\r\n'
    df = files.read_inventory(spark, write(tmp_path / "inv.csv", text))
    assert df.columns[:4] == ["name", "set_code", "scryfall_id", "quantity"]
    got = [tuple(r) for r in files.inventory_rows(df).orderBy("row_id").collect()]
    assert got == [(0, "abc", None, "Fire, Ice", "m20"), (1, None, None, "Bolt", "lea"), (2, None, None, None, None)]


def test_empty_inventory_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        files.read_inventory(spark, write(tmp_path / "inv.csv", "Name,Set code\n"))


def test_blob_round_trip_and_wrong_length(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0]), (2, None)], "i int, v array<float>")
    blobs = df.select("i", store.encode_blob(F.col("v")).alias("b"))
    assert bytes(blobs.orderBy("i").first()["b"]) == struct.pack("<2f", 0.5, -1.0)
    back = [r["v"] for r in blobs.select("i", store.decode_blob(F.col("b"), 2).alias("v")).orderBy("i").collect()]
    assert back == [[0.5, -1.0], None]
    with pytest.raises(Exception, match="expected 3"):
        blobs.select(store.decode_blob(F.col("b"), 3)).collect()


def test_replace_mode(spark, folder):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "emb_id bigint, emb array<double>")
    store.replace_mode(rows, folder, "analysis", 2)
    store.replace_mode(rows, folder, "runtime", 2)
    store.replace_mode(rows.where("emb_id = 2"), folder, "runtime", 2)
    counts = {r["mode"]: r["count"] for r in store.read_store(spark, folder).groupBy("mode").count().collect()}
    assert counts == {"analysis": 2, "runtime": 1}
    store.replace_mode(rows.where("false"), folder, "runtime", 2)
    assert store.read_store(spark, folder).where("mode = 'runtime'").count() == 0
    with pytest.raises(Exception, match="expected 5"):
        store.replace_mode(rows, folder + "/bad", "analysis", 5)


def test_failed_replace_leaves_the_old_rows(spark, folder):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "emb_id bigint, emb array<double>")
    store.replace_mode(rows, folder, "analysis", 2)
    with pytest.raises(Exception, match="expected 2"):
        store.replace_mode(rows.withColumn("emb", F.slice("emb", 1, 1)), folder, "analysis", 2)
    assert store.read_store(spark, folder).count() == 2
    store.replace_mode(rows.where("emb_id = 2"), folder, "analysis", 2)
    assert [r["emb_id"] for r in store.read_store(spark, folder).collect()] == [2]


def test_old_snapshots_expire(spark, folder):
    for flag in range(4):
        store.upsert_quality(spark.createDataFrame([("a", flag)], "group_id string, flag int"), folder)
    store.expire_snapshots(spark, folder)
    assert sorted(n for n in os.listdir(folder)) == ["snapshot=000000003", "snapshot=000000004"]
    assert tuple(store.current_snapshot(spark, folder)[1].first()) == ("a", 3)
    assert store.current_snapshot(spark, folder + "/none") is None


def test_last_record_of_a_file_wins(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "1.json", "\n".join(json.dumps({**CARDS[0], "name": n}) for n in ("x", "z", "y")))
    fold_into_catalogue(card_stream(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "p"), []).awaitTermination()
    assert [r["name"] for r in keyed.read_keyed(spark, str(tmp_path / "t")).collect()] == ["y"]


def test_quality_upsert_keeps_other_cards(spark, folder):
    def q(rows):
        return spark.createDataFrame(rows, "group_id string, flag int")

    store.upsert_quality(q([("a", 0), ("b", 0)]), folder)
    got = store.upsert_quality(q([("b", 1), ("c", 1)]), folder)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 1)]


def test_broken_quality_json(spark):
    df = spark.createDataFrame([("b", '{"n": 2}'), ("a", "{oops"), ("c", None)], "group_id string, meta_info string")
    got = [r["meta_info"]["n"] for r in store.read_quality(df, "meta_info", "n int").collect()]
    assert got == [None, 2, None]


def test_projector_files_align(spark, folder):
    rows = spark.range(300).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN NULL ELSE array(cast(id as float), cast(0.5 as float)) END AS emb",
        "'n' || id || '\t' AS name", "CASE WHEN id % 2 = 0 THEN 's' END AS set_code", "'1' AS collector_number", "id AS print_id",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        reports.write_projector(reports.projector_lines(rows, [F.col("id")]), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def lines(name):
        parts = sorted(p for p in os.listdir(f"{folder}/file={name}") if p.startswith("part-"))
        return [line for p in parts for line in open(f"{folder}/file={name}/{p}").read().splitlines()]

    vectors, meta = lines("vectors"), lines("metadata")
    assert meta[0] == "name\tset_code\tcollector_number\tprint_id" and len(vectors) == len(meta) - 1 == 270
    for v, m in zip(vectors, meta[1:]):
        assert float(v.split("\t")[0]) == float(m.split("\t")[3])
    assert vectors[0] == "1.00000000\t0.50000000"
    back = sorted(map(tuple, reports.read_projector(spark, folder).collect()))
    assert back == [(-1, None, meta[0]), *((i, v, m) for i, (v, m) in enumerate(zip(vectors, meta[1:])))]
    numbers = [{p.split("-")[1] for p in os.listdir(f"{folder}/file={n}") if p.startswith("part-")} for n in ("vectors", "metadata")]
    assert numbers[0] == numbers[1] and len(numbers[0]) > 1
    limited = reports.projector_lines(rows, [F.col("id")], limit=5)
    assert limited.count() == 5


def test_schema_evolution_adds_typed_nulls(spark):
    out = schemas.evolve(spark.createDataFrame([(1, "x")], "print_id int, more string"), schemas.CARDS)
    assert out.columns == [*schemas.CARDS.fieldNames(), "more"]
    assert out.schema["print_id"].dataType.simpleString() == "string" and out.first()["price_usd"] is None


def test_stream_folds_files_and_survives_a_replay(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    write(src / "1.json", "\n".join(json.dumps(c) for c in CARDS[:3]))
    progress = str(tmp_path / "progress")
    fold_into_catalogue(card_stream(spark, str(src)), table, progress, C.PRINT_LANGUAGES).awaitTermination()
    write(src / "2.json", json.dumps({**CARDS[0], "name": "Alpha 2"}))
    write(src / "3.json", json.dumps({"id": "e", "lang": "en", "name": "New", "image_uris": {"large": "u"}}))
    fold_into_catalogue(card_stream(spark, str(src)), table, progress, C.PRINT_LANGUAGES).awaitTermination()
    number, rows = keyed.last_version(spark, table), keyed.read_keyed(spark, table)
    assert {r["print_id"]: r["name"] for r in rows.collect()} == {"a": "Alpha 2", "b": "Faces", "e": "New"}
    # a replay of everything starts at batch 0 again: its versions exist, so nothing changes
    fold_into_catalogue(card_stream(spark, str(src)), table, str(tmp_path / "other"), C.PRINT_LANGUAGES).awaitTermination()
    assert keyed.last_version(spark, table) == number


def files_below(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.startswith("part-")}


def test_a_batch_rewrites_only_its_buckets(spark, folder):
    first = spark.range(500).selectExpr("id", "'old' AS v")
    keyed.upsert_keyed(first, folder, ["id"], [F.col("v")], buckets=16)
    before = files_below(f"{folder}/data")
    keyed.upsert_keyed(spark.createDataFrame([(7, "a"), (7, "b"), (1000, "c")], "id bigint, v string"), folder, ["id"], [F.desc("v")])
    assert before <= files_below(f"{folder}/data") and len(files_below(f"{folder}/data") - before) <= 2
    got = {r["id"]: r["v"] for r in keyed.read_keyed(spark, folder).collect()}
    assert got == {**{i: "old" for i in range(500)}, 7: "b", 1000: "c"}
    keyed.expire_versions(spark, folder)
    assert len(before - files_below(f"{folder}/data")) in (1, 2)
    assert {r["id"]: r["v"] for r in keyed.read_keyed(spark, folder).collect()} == got


def test_a_batch_that_failed_leaves_no_trace(spark, folder, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "id bigint, v string")
    keyed.upsert_keyed(rows((1, "a"), (2, "a")), folder, ["id"], [F.col("v")], version=1)
    real = keyed._manifest

    def lost(*args):
        monkeypatch.setattr(keyed, "_manifest", real)
        raise OSError("executor lost")

    # the rows of version 2 are written, its manifest isn't
    rows((9, "half")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{folder}/data/version=000000002")
    assert {r["id"] for r in keyed.read_keyed(spark, folder).collect()} == {1, 2}
    monkeypatch.setattr(keyed, "_manifest", lost)
    with pytest.raises(OSError):
        keyed.upsert_keyed(rows((2, "b")), folder, ["id"], [F.col("v")], version=2)
    for _ in range(2):  # the replay, and one more of what is there already
        assert keyed.upsert_keyed(rows((2, "b"), (3, "c")), folder, ["id"], [F.col("v")], version=2) == 2
    assert sorted(map(tuple, keyed.read_keyed(spark, folder).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_keyed_tables_take_empty_batches_and_null_keys(spark, folder):
    rows = lambda *r: spark.createDataFrame(r, "id bigint, v string")
    assert keyed.upsert_keyed(rows(), folder, ["id"], [F.col("v")]) == 1
    with pytest.raises(FileNotFoundError):
        keyed.read_keyed(spark, folder)
    keyed.upsert_keyed(rows((None, "n"), (1, None)), folder, ["id"], [F.col("v")])
    assert sorted(map(tuple, keyed.read_keyed(spark, folder).collect()), key=str) == [(1, None), (None, "n")]


def png(path, rgb):
    """Write rows of (r, g, b) tuples as an 8-bit PNG."""
    h, w = len(rgb), len(rgb[0])
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rgb)

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_path):
    png(tmp_path / "M20_1_en_abc.png", [[(255, 0, 0)] * 4] * 4)
    png(tmp_path / "b.PNG", [[(0, 255, 0)] * 2] * 2)
    write(tmp_path / "bad.jpg", "this is no image")
    write(tmp_path / "note.txt", "x")
    good, bad = images.read_images(spark, str(tmp_path))
    rows = {os.path.basename(r["origin"]): r for r in good.collect()}
    assert set(rows) == {"M20_1_en_abc.png", "b.PNG"}
    assert bytes(rows["M20_1_en_abc.png"]["data"])[:3] == b"\x00\x00\xff"
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["bad.jpg"]
    assert images.list_images(spark, str(tmp_path)).count() == 3
    assert images.list_images(spark, str(tmp_path / "missing")).count() == 0


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
