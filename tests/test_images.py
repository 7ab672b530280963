"""Image jobs on generated pictures, and the two pipelines end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import png, write

from checks.images import linear_head
from prismcat.functions import pixels as P
from prismcat.operators import images as I
from prismcat.plans import export as E
from prismcat.plans.recognition import photo_vectors, recognise
from prismcat.sources.images import read_images


def split(h=6, w=8):
    """Left half black, right half white."""
    return [[(0, 0, 0) if x < w // 2 else (255, 255, 255) for x in range(w)] for _ in range(h)]


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("img")
    png(folder / "S_1_en_flat.png", [[(200, 100, 50)] * 6] * 6)
    png(folder / "S_2_de_half.png", split())
    png(folder / "S_3_fr_tiny.png", [[(10, 20, 30)] * 2] * 2)
    write(folder / "S_4_en_bad.png", "broken")
    return read_images(spark, str(folder))[0]


def by_name(df):
    return {r["origin"].rsplit("_", 1)[1].split(".")[0]: r for r in df.collect()}


def test_statistics(pictures):
    s = by_name(I.image_statistics(pictures))
    flat = s["flat"]
    assert [round(flat[c] * 255) for c in ("mean_r", "mean_g", "mean_b")] == [200, 100, 50]
    assert flat["std_luminance"] == pytest.approx(0.0) and flat["laplacian_var"] == pytest.approx(0.0)
    assert s["tiny"]["laplacian_var"] == 0.0
    assert s["half"]["mean_luminance"] == pytest.approx(0.5) and s["half"]["laplacian_var"] > 0
    total = I.domain_statistics(I.image_statistics(pictures)).first()
    assert total["images"] == 3


def test_crop_letterbox_and_roi(pictures):
    out = by_name(I.crop_images(pictures, {}, (12, 8)))
    assert {(r["height"], r["width"]) for r in out.values()} == {(12, 8)}
    flat = P.from_struct(12, 8, 3, out["flat"]["data"])
    assert (flat[:2] == 0).all() and (flat[10:] == 0).all() and (np.abs(flat[2:10] - [200, 100, 50]) <= 1).all()
    # a degenerate box leaves the image alone; the ROI keeps one pixel
    same = by_name(I.crop_images(pictures, {"x_min": 0.5, "x_max": 0.5}, (3, 3)))
    assert (same["half"]["height"], same["half"]["width"]) == (6, 8)
    roi = by_name(I.crop_roi(pictures, {"x_min": 0.99, "x_max": 0.2, "y_min": 0.0, "y_max": 1.0}))
    assert (roi["half"]["height"], roi["half"]["width"]) == (6, 1) and bytes(roi["half"]["data"])[:3] == b"\xff\xff\xff"


def test_tensor(pictures):
    t = by_name(I.image_tensors(pictures, (4, 4)))["flat"]["tensor"]
    want = (np.array([200, 100, 50]) / 255 - P.CHANNEL_MEAN) / P.CHANNEL_STD
    assert len(t) == 48 and t[0] == pytest.approx(want[0], abs=1e-5) and t[47] == pytest.approx(want[2], abs=1e-5)


def test_resize_keeps_means_and_constants():
    img = np.random.default_rng(0).uniform(0, 255, (20, 30, 3))
    assert P.resize(img, 10, 15).mean() == pytest.approx(img.mean(), rel=0.02)
    assert np.allclose(P.resize(np.full((5, 7, 3), 9.0), 13, 2), 9.0)


@pytest.mark.parametrize("parts", [1, 7])
def test_augmentation_repeats_under_any_partitioning(pictures, parts):
    out = I.augment_images(pictures.repartition(parts), 3).collect()
    assert len(out) == 12
    digest = {(r["origin"], r["variant"]): bytes(r["data"]) for r in out}
    original = {r["origin"]: bytes(r["data"]) for r in pictures.collect()}
    assert all(digest[(o, 0)] == original[o] for o in original)
    assert any(digest[(o, v)] != original[o] for o in original for v in (1, 2, 3))
    again = {(r["origin"], r["variant"]): bytes(r["data"]) for r in I.augment_images(pictures, 3).collect()}
    assert again == digest


def test_effects():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (16, 16, 3)).astype(float)
    assert np.allclose(P.exposure(img, 1.0), img) and np.allclose(P.saturation(img, 1.0), img)
    assert np.allclose(P.sharpness(img, 1.0), img) and np.allclose(P.rotate(img, 0.0, 255.0), img)
    assert np.allclose(P.hue_shift(img, 0.0), img, atol=1e-6) and np.allclose(P.hue_shift(img, 256.0), img, atol=1e-6)
    assert np.allclose(P.saturation(img, 0.0), P.grey(img)[:, :, None])
    red = np.zeros((1, 1, 3)) + [255.0, 0, 0]
    assert np.allclose(P.hue_shift(red, 256 / 3), [[[0, 255.0, 0]]], atol=1e-6)
    assert np.allclose(P.rotate(img, 90.0, 0.0), np.rot90(img), atol=1e-6)
    assert P.gaussian_blur(img, 2.0).std() < img.std() and P.blur(img, 0.01) is img
    assert np.allclose(P.contrast(img, 0.0), np.floor(P.grey(img).mean() + 0.5 + 1e-6))
    dark = P.shadow(np.full((16, 16, 3), 255.0), rng)
    assert set(np.unique(dark)) == {180.0, 255.0}
    warm, cool = P.color_temperature(img, 1.1), P.color_temperature(img, 0.9)
    assert warm[..., 0].mean() > cool[..., 0].mean() and warm[..., 2].mean() < cool[..., 2].mean()
    bent = P.trapezoid(np.full((8, 8, 3), 7.0), 3.0, 255.0)
    assert bent[0, 0, 0] == 255.0 and np.allclose(bent[-1], 7.0)


def test_training_view_bounds():
    cfg = {"size": (5, 4), "rotation_deg": 2, "brightness": (0.8, 1.2), "contrast": (0.9, 1.1), "blur_prob": 1.0, "noise_std": 0.1}
    img = np.random.default_rng(2).uniform(0, 255, (9, 9, 3))
    view = P.training_view(img, 11, cfg)
    low, high = (0 - P.CHANNEL_MEAN) / P.CHANNEL_STD, (1 - P.CHANNEL_MEAN) / P.CHANNEL_STD
    assert view.shape == (3, 5, 4)
    assert (view >= low[:, None, None] - 1e-9).all() and (view <= high[:, None, None] + 1e-9).all()
    assert np.array_equal(view, P.training_view(img, 11, cfg)) and not np.array_equal(view, P.training_view(img, 12, cfg))


def test_range_hints(spark):
    cols = "images bigint, mean_luminance double, std_luminance double, mean_r double, mean_g double, mean_b double, laplacian_var double"
    ref = spark.createDataFrame([(2, 0.5, 0.2, 0.0, 0.0, 0.0, 0.1)], cols)
    cam = spark.createDataFrame([(2, 0.4, 0.1, 0.0, 0.0, 0.0, 0.25)], cols)
    h = I.range_hints(ref, cam).first()
    assert tuple(h) == pytest.approx((0.7, 0.9, 0.6, 0.6, 1 / (0.25 + 1e-6) ** 0.5, 0.1 / 3), abs=1e-5)


def test_export_and_recognition(spark, pictures):
    cards = spark.createDataFrame([("flat", "L1"), ("half", "")], "print_id string, logical_id string")
    settings = E.ExportSettings.analysis(num_augmentations=2, model_id="m")
    encoded = E.encoded_variants(pictures, linear_head(192, 8), settings, (8, 8), batch_size=2).cache()
    rows = E.export_rows(encoded, cards, settings).cache()
    assert {r["aug_index"] for r in rows.where("print_id = 'flat'").collect()} == {0, 1, 2, 999}
    assert {r["print_id"]: r["logical_id"] for r in rows.collect()} == {"flat": "L1", "half": "half", "tiny": "tiny"}
    assert E.audit_export(rows, settings).count() == 0
    assert E.audit_export(rows.where("aug_index <> 1"), settings).count() == 3
    norms = rows.select(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1.0, abs=1e-5) for r in norms)
    runtime = E.export_rows(encoded, cards, E.ExportSettings.runtime(num_augmentations=2))
    assert runtime.count() == 3 and {r["image_id"] for r in runtime.collect()} == {None}
    langs = {r["print_id"]: r["language"] for r in E.export_images(encoded, "scan").collect()}
    assert langs == {"flat": "en", "half": "de", "tiny": "fr"}
    stored = rows.where("aug_index = 0").select(F.col("emb_id").alias("id"), F.col("emb").alias("vec"), "print_id")
    photos = photo_vectors(pictures, linear_head(192, 8), (8, 8), {"x_min": 0.0, "x_max": 1.0})
    hits = recognise(photos, stored, k=1).hits.collect()
    assert {r["query_id"].rsplit("_", 1)[1].split(".")[0] == r["print_id"] for r in hits} == {True} and len(hits) == 3


def test_export_job(spark, tmp_path):
    from prismcat import schemas
    from prismcat.sources.store import read_store

    src = tmp_path / "scans"
    src.mkdir()
    png(src / "S_1_en_x.png", split())
    png(src / "S_2_de_y.png", [[(9, 9, 200)] * 6] * 6)
    write(src / "S_3_en_z.png", "broken")
    cards = spark.createDataFrame([("x", "LX")], "print_id string, logical_id string")
    known = spark.createDataFrame([], schemas.IMAGES)
    out = str(tmp_path / "store")
    for settings, expected in ((E.ExportSettings.analysis(num_augmentations=1), 6), (E.ExportSettings.runtime(num_augmentations=1), 2)):
        run = E.run_export(spark, str(src), cards, known, out, settings, linear_head(192, 8), (8, 8), 8, "scan", f"file:{tmp_path}")
        assert run.mismatches.count() == 0 and run.unreadable.count() == 1
        assert read_store(spark, out).where(F.col("mode") == settings.mode).count() == expected
        assert len({r["image_id"] for r in run.images.collect()}) == 2
        known = run.images
    assert read_store(spark, out).count() == 8


def test_bytes_are_listed_once_per_picture(spark):
    """The hex text of a picture isn't built again for each of its bytes; the lists are its bytes."""
    from checks import images as checked
    from checks.base import pixel_images

    sf = "/root/testdata/sf0.001"
    pictures = pixel_images(spark, sf)
    both = checked._with_bytes(pictures.withColumn("data", pictures["data"]), spark, sf)
    assert "substring(hex" not in both._jdf.queryExecution().optimizedPlan().toString()
    data = {r["origin"]: bytes(r["data"]) for r in pictures.collect()}
    rows = both.collect()
    assert len(rows) == len(data)
    assert all([p["old"] for p in r["pairs"]] == [p["new"] for p in r["pairs"]] == list(data[r["origin"]]) for r in rows)
    assert all(r["code"] == data[r["origin"]].hex().upper() for r in rows)
