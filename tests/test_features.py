"""Sampling, triplets, losses, PCA and histogram rules."""

import numpy as np
import pytest

from prismcat.operators import features as X


def test_fixed_sample(spark):
    df = spark.range(500)
    sizes = {n: X.fixed_sample(df, "id", n).count() for n in (0, -1, 7, 500, 900)}
    assert sizes == {0: 500, -1: 500, 7: 7, 500: 500, 900: 500}
    picks = [sorted(r["id"] for r in X.fixed_sample(df.repartition(p), "id", 20, 5).collect()) for p in (1, 7)]
    assert picks[0] == picks[1] != sorted(r["id"] for r in X.fixed_sample(df, "id", 20, 6).collect())


def listing(spark):
    rows = [("a", f"a{i}") for i in range(40)] + [("b", "b0")] + [("c", f"c{i}") for i in range(3)]
    return spark.createDataFrame(rows, "print_id string, path string")


def test_triplets(spark):
    runs = [sorted(map(tuple, X.triplets(listing(spark).repartition(p), 3).collect())) for p in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 44
    for _, card, other, anchor, positive, negative, label in runs[0]:
        assert anchor[0] == positive[0] == card and negative[0] == other != card
        assert (anchor == positive) == (card == "b")
        assert label == "abc".index(card)
    with pytest.raises(ValueError, match="two classes"):
        X.triplets(listing(spark).where("print_id = 'a'"))


def test_class_index_and_counts(spark):
    assert sorted(map(tuple, X.class_index(listing(spark), "print_id").collect())) == [("a", 0), ("b", 1), ("c", 2)]
    both = X.merge_listings(listing(spark), listing(spark).where("print_id = 'b'"))
    got = {r["print_id"]: (r["n_images"], r["first_path"]) for r in X.images_per_class(both).collect()}
    assert got == {"a": (40, "a0"), "b": (2, "b0"), "c": (3, "c0")}


def test_losses(spark):
    rows = [([0.0, 0.0], [0.0, 1.0], [3.0, 0.0]), ([0.0, 0.0], [2.0, 0.0], [1.0, 0.0])]
    loss = X.triplet_loss(spark.createDataFrame(rows, "a array<double>, p array<double>, n array<double>"), "a", "p", "n", 0.35).first()
    assert (loss["triplets"], loss["mean_loss"], loss["active_share"]) == (2, pytest.approx(1.35 / 2), 0.5)
    logits = spark.createDataFrame([([0.0, 1000.0], 1), ([1.0, 1.0], 1)], "z array<double>, y int")
    m = X.classification_metrics(logits, "z", "y").first()
    assert (m["n"], m["mean_ce"], m["accuracy"]) == (2, pytest.approx(np.log(2) / 2), 0.5)


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id int, v array<double>")
    got = np.array([[r["pc1"], r["pc2"]] for r in X.pca_2d(df, "id", "v").orderBy("id").collect()])
    centred = data - data.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    axes = vt[:2] * np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])[:, None]
    assert np.allclose(got, centred @ axes.T, atol=1e-8)
    flat = spark.createDataFrame([(1, [2.0]), (2, [4.0])], "id int, v array<double>")
    assert sorted((r["pc1"], r["pc2"]) for r in X.pca_2d(flat, "id", "v").collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_min_max_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert sorted(map(tuple, X.min_max(df, ["x", "y"]).collect())) == [(0.0, 0.0), (0.0, 1.0)]


def test_histograms(spark):
    df = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.25, 0.5, 1.0, 1.1, None)], "x double")
    got = [r["n"] for r in X.histogram(df, "x", 4, 0.0, 1.0).orderBy("bin").collect()]
    assert got == [1, 1, 1, 1]
    ranged = [r["n"] for r in X.histogram(df, "x", 3).orderBy("bin").collect()]
    assert ranged == np.histogram([-0.1, 0.0, 0.25, 0.5, 1.0, 1.1], 3)[0].tolist()
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert sorted(r["n"] for r in X.histogram(same, "x", 5).collect()) == [0, 0, 0, 0, 2]


def test_box_plot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    b = X.box_plot(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    assert tuple(b) == (2.0, 3.0, 4.0, 1.0, 4.0, 1, 5)


def test_gallery(spark):
    got = X.first_paths(listing(spark), "print_id", "path", 2)
    assert sorted((r["print_id"], r["path"], r["place"]) for r in got.collect()) == [
        ("a", "a0", 1), ("a", "a1", 2), ("b", "b0", 1), ("c", "c0", 1), ("c", "c1", 2)
    ]
