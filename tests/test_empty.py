"""Empty tables give empty results or explicit NULLs, never errors."""

import pytest
from pyspark.sql import functions as F

from prismcat import schemas
from prismcat.operators import blocks as B
from prismcat.operators import catalogue as K
from prismcat.operators import features as X
from prismcat.operators import groups as G
from prismcat.operators import match as M
from prismcat.operators import pairs as P
from prismcat.operators import quality as Q
from prismcat.operators import search as S
from prismcat.operators.numbering import with_global_index, with_group_index
from prismcat.operators.skew import hot_keys, lookup_join
from prismcat.plans.quality_report import build_quality
from prismcat.plans.recognition import recognise


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "id bigint, g string, vec array<float>")


def test_numbering_and_joins(spark, none):
    assert with_global_index(none, [F.col("id")], "i").count() == 0
    assert with_group_index(none, ["g"], [F.col("id")], "i").count() == 0
    assert hot_keys(none, ["g"], 0) == {}
    lookup = spark.createDataFrame([("a", 1)], "g string, x int")
    assert lookup_join(none, lookup, ["g"], F.col("id")).count() == 0


def test_search_and_pairs(none):
    side = none.select("id", "vec")
    for plan in ({}, {"round_rows": 2}, {"prune": True}):
        assert S.top_k_similar(side, side, 3, None, **plan).count() == 0
    run = recognise(side, side)
    assert run.matches.count() == 0 and run.grades.count() == 0 and run.summary.first()["best_score"] is None
    assert P.pair_summary(B.pack_blocks(side, "id", "vec")).first()["n_pairs"] == 0
    assert P.pair_summary(B.pack_group_blocks(none, "g", "id", "vec"), median=False).first()["std_dist"] is None
    assert P.d_aug(P.intra_means(none, "g", "vec")).first()["d_aug"] == 0.0
    assert G.centroids(none, "g", "vec").count() == 0


def test_plots(none):
    empty = none.select(F.col("id").cast("double").alias("x"))
    assert [r["n"] for r in X.histogram(empty, "x", 3, 0.0, 1.0).collect()] == [0, 0, 0]
    box = X.box_plot(empty, "x").first()
    assert box["median"] is None and box["n"] == 0
    assert X.pca_2d(none, "id", "vec").count() == 0
    assert X.min_max(empty, ["x"]).count() == 0


def test_report_and_catalogue(spark):
    cards = spark.createDataFrame([], "print_id bigint, logical_id string, name string, mana_cost string, cmc double, colors string, color_identity string")
    images = spark.createDataFrame([], "image_id bigint, file_path string")
    emb = spark.createDataFrame([], "emb_id bigint, print_id bigint, logical_id string, image_id bigint, mode string, aug_index int, emb array<float>")
    report = build_quality(emb, cards, images)
    assert report.quality.count() == 0 and Q.flag_counts(report.quality).first()["cards"] == 0
    table = spark.createDataFrame([], schemas.CARDS)
    assert K.upsert(table, table, ["print_id"], [F.col("name")]).count() == 0
    assert tuple(K.load_statistics(table, table, ["print_id"]).first()) == (0, 0, 0, 0, 0)
    names = spark.createDataFrame([], "query_id int, query_name string")
    refs = spark.createDataFrame([], "ref_id int, ref_name string")
    assert M.match_names(names, refs).count() == 0
    one = spark.createDataFrame([(1, "abc")], "query_id int, query_name string")
    assert M.match_names(one, refs).first()["how"] == "none"
    assert M.round_robin(one, refs, "query_id", "ref_id").first()["ref_id"] is None
