"""Grouping, search and quality rules on hand-made vectors."""

import pytest
from pyspark.sql import functions as F

from prismcat.operators import catalogue as K
from prismcat.operators import groups as G
from prismcat.operators import match as M
from prismcat.operators import pairs as P
from prismcat.operators import quality as Q
from prismcat.operators import search as S
from prismcat.operators.blocks import pack_blocks, pack_group_blocks, self_tiles
from prismcat.plans.quality_report import build_quality
from prismcat.plans.recognition import recognise


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, g string, vec array<double>")


def test_centroid_and_spread_edge_groups(spark):
    df = vectors(spark, [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (3, "b", [0.0, 0.0]), (4, "c", [0.0, 5.0])])
    cents = {r["g"]: r["centroid"] for r in G.centroids(df, "g", "vec", normalise_rows=True).collect()}
    assert cents["a"] == pytest.approx([2**-0.5, 2**-0.5]) and cents["b"] == [0.0, 0.0] and cents["c"] == [0.0, 1.0]
    spread = {r["g"]: r for r in G.cluster_spread(df, "g", "id", vec="vec").collect()}
    assert spread["b"]["intra_mean_dist"] == 0.0 and spread["c"]["intra_max_dist"] == 0.0
    edge = (2 - 2**0.5) ** 0.5
    assert spread["a"]["intra_max_dist"] == pytest.approx(edge)
    assert spread["a"]["global_mean"] == pytest.approx(edge / 3)
    empty = df.where("false")
    assert G.cluster_spread(empty, "g", "id", vec="vec").count() == 0
    cover = G.coverage(df, "g", "vec").first()
    assert (cover["cards"], cover["cards_multi"], cover["vectors"], cover["dimension"]) == (3, 1, 4, 2)


def test_neighbour_of_single_group_and_ties(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0])], "g string, centroid array<double>")
    assert S.nearest_neighbour(one, "g").first()["neighbour"] is None
    rows = [("a", [1.0, 0.0]), ("d", [1.0, 0.0]), ("c", [1.0, 0.0]), ("b", [0.0, 1.0])]
    many = spark.createDataFrame(rows, "g string, centroid array<double>")
    got = {r["g"]: (r["neighbour"], r["neighbour_dist"]) for r in S.nearest_neighbour(many, "g").collect()}
    assert got == {"a": ("c", 0.0), "c": ("a", 0.0), "d": ("a", 0.0), "b": ("a", pytest.approx(2**0.5))}


def test_threshold_is_inclusive_and_missing_hits_score_zero(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id bigint, vec array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, -1.0]), (12, None)], "id bigint, vec array<double>")
    hits = S.top_k_similar(queries, stored, 5, 0.6).collect()
    assert sorted((r["query_id"], r["stored_id"], r["rank"], round(r["similarity"], 6)) for r in hits) == [
        (10, 1, 1, 1.0), (10, 2, 2, 0.6)
    ]
    run = recognise(queries, stored, k=2, threshold=0.6, failed=spark.createDataFrame([(99,)], "id bigint"))
    scores = {r["query_id"]: (r["score"], r["grade"]) for r in run.matches.collect()}
    assert scores == {10: (1.0, "excellent"), 11: (0.0, "none"), 12: (0.0, "none")}
    s = run.summary.first()
    assert (s["searched"], s["scored"], s["best_score"], s["worst_score"]) == (4, 3, 1.0, 0.0)
    assert s["mean_score"] == pytest.approx(1 / 3)


def test_pair_statistics_without_pairs(spark):
    df = vectors(spark, [(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])])
    none = P.pair_summary(pack_group_blocks(df, "g", "id", "vec"))
    assert tuple(none.first()) == (0, None, None, None, None)
    assert P.d_aug(P.intra_means(df, "g", "vec")).first()["d_aug"] == 0.0
    assert P.separation(P.d_aug(P.intra_means(df, "g", "vec")), none).first()["q"] is None
    single = self_tiles(pack_blocks(df.where("id = 1"), "id", "vec"))
    assert P.closest_pairs(single, "bigint", 0.0).count() == 0


CARD = "print_id bigint, logical_id string, name string, mana_cost string, cmc double, colors string, color_identity string, set_code string, set_name string, lang string"
CARDS = [
    (1, "A", "Ann", "1", 1.0, "[]", "[]", "s", "S", "en"), (2, "A", "Ann", "1", 1.0, "[]", "[]", "s", "S", "de"),
    (3, "A", None, None, None, None, None, None, None, "fr"), (4, "B", "Bob", "2", 10.0, "[]", "[]", "t", "T", "en"),
    (5, "B", "Bobby", "2", 2.0, "[]", "[]", "t", "T", "en"),
]
EMB = "emb_id bigint, print_id bigint, logical_id string, image_id bigint, mode string, aug_index int, emb array<float>"
ROWS = [
    (1, 1, "A", 1, "analysis", 0, [1.0, 0.0]), (2, 2, None, None, "analysis", 0, [1.0, 0.1]),
    (3, 3, "A", None, "analysis", 0, [1.0, 0.2]), (4, 4, "B", 2, "analysis", 0, [0.9, 0.1]),
    (5, 5, "B", None, "analysis", 999, [0.0, 1.0]), (6, 77, None, None, "analysis", 0, [-1.0, 0.0]),
    (7, 1, "A", 1, "runtime", 999, [0.0, 1.0]),
]


@pytest.fixture(scope="module")
def tables(spark):
    images = spark.createDataFrame([(1, "p/1.jpg"), (2, "p/2.jpg")], "image_id bigint, file_path string")
    return spark.createDataFrame(ROWS, EMB), spark.createDataFrame(CARDS, CARD), images


def test_load_has_no_fan_out_and_sets_match_the_fan_out(spark, tables):
    emb, cards, images = tables
    fields = ["name", "mana_cost", "cmc", "colors", "color_identity", "lang"]
    loaded = Q.load_by_logical(emb, cards, images, "analysis", fields)
    assert loaded.count() == 6
    values = Q.metadata_values(loaded, cards, [*fields, "image_path"])
    got = {(r["group_id"], r["field"]): set() for r in values.collect()}
    for r in values.collect():
        got[(r["group_id"], r["field"])].add(r["value"])
    assert got[("A", "name")] == {"Ann"} and got[("A", "lang")] == {"en", "de", "fr"}
    assert got[("B", "name")] == {"Bob", "Bobby"} and got[("B", "image_path")] == {"p/2.jpg"}
    assert not any(g == "77" for g, _ in got)
    meta = {r["group_id"]: r for r in Q.metadata_summary(values, [*fields, "image_path"]).collect()}
    assert meta["B"]["cmc"] == 2.0 and meta["B"]["n_cmc"] == 2 and meta["A"]["n_name"] == 1


def test_quality_flags(spark, tables):
    report = build_quality(*tables, "analysis", spread_max=0.5, overlap=0.9)
    rows = {r["group_id"]: r for r in report.quality.collect()}
    assert set(rows) == {"A", "B", "77"}
    assert rows["B"]["suspect_metadata_conflict"] == 1 and rows["B"]["suspect_cluster_spread"] == 1
    assert rows["A"]["nearest_neighbor_id"] == "B" and rows["A"]["suspect_overlap"] == 1
    # A has no conflict of its own but differs from its overlapping neighbour
    assert rows["A"]["suspect_metadata_conflict"] == 1
    assert rows["77"]["suspect_metadata_conflict"] == 0 and rows["77"]["intra_mean_dist"] == 0.0
    without = build_quality(*tables, "analysis", spread_max=0.5, overlap=0.9, include_centroid_rows=False)
    assert {r["group_id"]: r["suspect_cluster_spread"] for r in without.quality.collect()}["B"] == 0
    counts = Q.flag_counts(report.quality).first()
    assert counts["cards"] == 3 and counts["suspect_overlap"] == 2


def test_report_order_puts_zero_distance_first(spark):
    rows = [("a", 0, 0, 0, None, 1.0), ("b", 1, 0, 0, 0.5, 1.0), ("c", 1, 0, 0, 0.0, 1.0), ("d", 0, 0, 0, 0.1, 2.0), ("e", 0, 0, 0, 0.1, 3.0)]
    schema = "group_id string, suspect_overlap int, suspect_cluster_spread int, suspect_metadata_conflict int, nearest_neighbor_dist double, intra_mean_dist double"
    q = spark.createDataFrame(rows, schema)
    assert [r["group_id"] for r in q.orderBy(*Q.report_order()).collect()] == ["c", "b", "e", "d", "a"]


def test_upsert_rules(spark):
    target = spark.createDataFrame([(1, "old"), (2, "stay")], "k int, v string")
    batch = spark.createDataFrame([(1, "first", 1, 9), (1, "last", 2, 9), (3, "new", 1, None)], "k int, v string, t int, extra int")
    out = K.upsert(target, batch, ["k"], [F.desc("t")])
    assert sorted((r["k"], r["v"], r["extra"]) for r in out.collect()) == [(1, "last", 9), (2, "stay", None), (3, "new", None)]
    stats = K.load_statistics(target, batch, ["k"], batch.where("k = 3")).first()
    assert tuple(stats) == (2, 3, 1, 1, 1)


def test_inventory_precedence(spark, tables):
    _, cards, _ = tables
    cards = cards.withColumn("price", F.col("print_id"))
    rows = [(1, 2, "B", "Bob", "t"), (2, None, "B", "Ann", None), (3, None, None, "Ann", "s"), (4, None, None, "Bob", "s"),
            (5, None, None, "Bobby", None), (6, None, None, None, "s"), (7, 99, "A", "Ann", None), (8, None, "", "Ann", "")]
    inventory = spark.createDataFrame(rows, "row_id bigint, print_id bigint, logical_id string, name string, set_code string")
    got = {r["row_id"]: (r["tier"], r["resolved_print_id"]) for r in K.resolve_inventory(inventory, cards, [F.col("price")]).collect()}
    assert got == {1: (1, 2), 2: (2, 4), 3: (3, 1), 4: (3, None), 5: (4, 5), 6: (None, None), 7: (1, None), 8: (4, 1)}


def test_name_match(spark):
    queries = spark.createDataFrame([(1, "NATION_1"), (2, "nation 10!"), (3, ""), (4, "zzz"), (5, "na"), (6, "my-nation-10-x")], "query_id int, query_name string")
    refs = spark.createDataFrame([("r1", "Nation_1"), ("r10", "Nation_10"), ("r0", "")], "ref_id string, ref_name string")
    got = {r["query_id"]: (r["ref_id"], r["how"]) for r in M.match_names(queries, refs).collect()}
    assert got == {1: ("r1", "exact"), 2: ("r10", "exact"), 3: (None, "none"), 4: (None, "none"), 5: ("r1", "contains"), 6: ("r1", "contains")}


def test_round_robin_with_more_queries_than_refs(spark):
    got = M.round_robin(spark.range(5).selectExpr("id AS q"), spark.range(10, 12).selectExpr("id AS r"), "q", "r")
    assert sorted((r["q"], r["r"]) for r in got.collect()) == [(0, 10), (1, 11), (2, 10), (3, 11), (4, 10)]


def test_first_seen_values_and_headers(spark):
    rows = [(1, 0, 5, "b", None), (1, 1, 6, "a", "de"), (1, 2, 7, "b", "en"), (1, 3, 8, "", "en"), (2, 0, 9, None, "")]
    df = spark.createDataFrame(rows, "k int, aug int, id int, path string, lang string")
    order = [F.col("aug"), F.col("id")]
    got = G.values_in_first_seen_order(df, "k", "path", order).collect()
    assert sorted((r["k"], r["position"], r["path"]) for r in got) == [(1, 0, "b"), (1, 1, "a")]
    heads = {r["k"]: (r["n_vectors"], r["path"], r["lang"]) for r in G.card_headers(df, "k", order, ["path"], "lang").collect()}
    assert heads == {1: (4, "b", "de"), 2: (1, None, None)}


@pytest.mark.parametrize("switches,expected", [
    (dict(append_individual=True, append_centroid=True), {0, 1, 999}), (dict(append_individual=True, append_centroid=False), {0, 1}),
    (dict(append_individual=False, append_centroid=True), {999}), (dict(append_individual=False, append_centroid=False), {0, 1}),
    (dict(use_centroid=True), {999}),
])
def test_export_switches(spark, switches, expected):
    df = spark.createDataFrame([(1, "p2", 1, [1.0, 0.0]), (1, "p1", 1, [0.0, 1.0])], "print_id int, path string, image_id int, emb array<double>")
    rows = G.export_records(df, "print_id", [F.col("path")], **switches).collect()
    assert {r["aug_index"] for r in rows} == expected
    full = {"append_individual": True, "append_centroid": True, "use_centroid": False, **switches}
    assert G.expected_vectors(2, **full) == len(expected)
