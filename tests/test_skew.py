"""Hot keys, partitioning independence, equality of the search paths."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismcat.operators import blocks as B
from prismcat.operators import cells as C
from prismcat.operators import groups as G
from prismcat.operators import pairs as P
from prismcat.operators import search as S
from prismcat.operators.numbering import exact_quantiles, with_global_index, with_group_index
from prismcat.operators.skew import hot_keys, lookup_join


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under one key, another part under NULL."""
    return spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 40 END AS k"
    )


def test_hot_keys_found(hot):
    found = hot_keys(hot, ["k"], min_rows=200)
    assert list(found.values()) == [-(-hot.where("k = 7").count() // 200)]
    assert hot_keys(hot, ["k"]) == {}


def test_a_key_of_a_small_share_is_cut(spark):
    """0.05 % of a large table is still far more than a piece should hold; the other keys are rare."""
    df = spark.range(2_000_000).selectExpr("id", "CASE WHEN id % 2000 = 7 THEN -1 ELSE id END AS k")
    found = hot_keys(df, ["k"], min_rows=100)
    assert list(found.values()) == [10]
    lookup = spark.range(-1, 2_000_000, 3).selectExpr("id AS k", "id * 2 AS v")
    joined = lookup_join(df, lookup, ["k"], F.col("id"), "inner", min_rows=100)
    assert joined.where("k = -1").agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first() == (1000, -2, -2)
    assert joined.count() == df.join(lookup, "k").count()


def test_triplets_with_a_class_of_one_image(spark):
    """Every second triplet draws the only image of the small class; its number is salted, the rows don't change."""
    from prismcat.operators.features import triplets

    listing = spark.range(4000).selectExpr("CASE WHEN id = 0 THEN 'one' ELSE 'many' END AS print_id", "'p' || id AS path")
    plain, salted = (rows_of(triplets(listing, min_rows=n), "triplet", "anchor", "positive", "negative", "print_id") for n in (200_000, 50))
    assert plain == salted and len(plain) == 4000
    small = [r for r in plain if r[4] == "one"]
    assert 1800 < len(small) < 2200 and all(r[1] == r[2] == "p0" and r[3] != "p0" for r in small)
    assert all(r[3] == "p0" and r[1] != r[2] for r in plain if r[4] == "many")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_join_equals_plain_join(spark, hot, how):
    lookup = spark.range(0, 30).selectExpr("id AS k", "'v' || id AS v")
    plain = hot.join(lookup, "k", how)
    salted = lookup_join(hot, lookup, ["k"], F.col("id"), how, min_rows=10)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in plain.columns]
    assert rows_of(salted.select(*plain.columns), *key) == rows_of(plain, *key)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_takes_any_column_names(spark, how):
    """Keys and other columns may be called like the helper columns of a join with hot keys."""
    facts = spark.range(1000).selectExpr("id AS row_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'k' || id % 9 END AS _key", "id % 3 AS _SALT", "id AS _hot", "1 AS tier")
    lookup = spark.createDataFrame([("a", 1, "x", 5), ("k3", 1, "y", 6)], "_key string, tier int, _of string, _pieces int")
    got = lookup_join(facts, lookup, ["tier", "_key"], F.col("row_id"), how, min_rows=100)
    plain = facts.join(lookup, ["tier", "_key"], how)
    assert got.columns == plain.columns
    key = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in plain.columns]
    assert rows_of(got, *key) == rows_of(plain, *key)


def test_inventory_with_many_rows_of_one_key(spark):
    """So many rows without any key, or with the same one, that their key is cut into pieces."""
    from prismcat.operators.catalogue import resolve_inventory

    catalogue = spark.createDataFrame([(1, "L1", "a", "s", 2.0), (2, "L1", "b", "s", 1.0)], "print_id bigint, logical_id string, name string, set_code string, price double")
    asked = spark.range(900).selectExpr("id AS row_id", "IF(id % 3 = 0, 2, CAST(NULL AS BIGINT)) AS print_id", "IF(id % 3 = 1, 'L1', NULL) AS logical_id", "CAST(NULL AS STRING) AS name", "CAST(NULL AS STRING) AS set_code")
    plain, cut = (rows_of(resolve_inventory(asked, catalogue, [F.col("price")], min_rows=n), "row_id", F.coalesce("tier", F.lit(0)), F.coalesce("resolved_print_id", F.lit(0))) for n in (200_000, 100))
    assert plain == cut == [(i, *((1, 2), (2, 2), (0, 0))[i % 3]) for i in range(900)]


def test_hot_key_is_spread(spark, hot):
    lookup = spark.range(0, 30).selectExpr("id AS k", "'v' || id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = lookup_join(hot, lookup, ["k"], F.col("id"), "inner", min_rows=10)
        sizes = [r["count"] for r in joined.where("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10485760)
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert len(sizes) == 8 and max(sizes) < 300


@pytest.mark.parametrize("parts", [1, 7])
def test_indexes(hot, parts):
    df = hot.repartition(parts)
    idx = rows_of(with_global_index(df, [F.col("id")], "i"), "id", "i")
    assert idx == [(i, i) for i in range(3000)]
    got = rows_of(with_group_index(df, ["k"], [F.desc("id")], "i").where("k = 7"), "i", "id")
    ids = sorted((r["id"] for r in hot.where("k = 7").collect()), reverse=True)
    assert got == list(enumerate(ids))
    nulls = with_group_index(df, ["k"], [F.col("id")], "i").where("k IS NULL").select("i").collect()
    assert sorted(r["i"] for r in nulls) == list(range(len(nulls)))


def test_exact_quantiles(spark):
    values = [5.0, 1.0, 1.0, 1.0, 2.5, 9.0, 7.25, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["p"]: r["quantile"] for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    known = [v for v in values if v is not None]
    assert got == pytest.approx({p: float(np.quantile(known, p)) for p in got})
    empty = exact_quantiles(df.where("x > 100"), "x", [0.5]).collect()
    assert empty[0]["quantile"] is None


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors of which a third are copies of one vector."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 8))
    base[::3] = base[0]
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", [float(x) for x in v]) for i, v in enumerate(base)]
    return spark.createDataFrame(rows, "id bigint, g string, vec array<double>"), base


def brute(base, k, exclude=True):
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    if exclude:
        np.fill_diagonal(sims, -np.inf)
    out = []
    for i, row in enumerate(sims):
        order = np.lexsort((np.arange(len(row)), -row))[:k]
        out += [(i, int(j), r + 1) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("parts,plan", list(itertools.product([1, 7], [{}, {"round_rows": 40}, {"prune": True, "leaf_rows": 8}, {"prune": True, "leaf_rows": 2, "round_rows": 50}])))
def test_search_paths_agree(vectors, parts, plan):
    df, base = vectors
    side = df.select("id", "vec").repartition(parts)
    got = S.top_k_similar(side, side, 4, None, exclude_self=True, **plan)
    assert rows_of(got, "query_id", "stored_id", "rank") == brute(base, 4)


@pytest.mark.parametrize("plan", [{}, {"round_rows": 1}, {"prune": True, "leaf_rows": 1}])
def test_blocks_smaller_than_k(vectors, plan):
    """A block that holds little more than the query itself must not repeat a hit."""
    df, base = vectors
    side = df.where("id in (0, 1, 2)").select("id", "vec")
    got = S.top_k_similar(side, side, 5, None, exclude_self=True, **plan)
    assert rows_of(got, "query_id", "stored_id", "rank") == brute(base[:3], 2)


def test_distinct_cards_look_past_a_crowded_card(vectors):
    """Card 'hot' owns a third of the vectors, all equal: the other cards must still be found."""
    df, base = vectors
    stored = df.select("id", "vec", F.col("g").alias("print_id"))
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    sims = np.round(u @ u[0], 9)
    card = ["hot" if i % 3 == 0 else f"g{i % 7}" for i in range(90)]
    best = {}
    for i in np.lexsort((np.arange(90), -sims)):
        best.setdefault(card[i], int(i))
    want = [(c, i, n + 1) for n, (c, i) in enumerate(list(best.items())[:4])]
    for plan in ({}, {"round_rows": 1}):
        got = S.top_k_cards(df.where("id = 0").select("id", "vec"), stored, 4, None, **plan).orderBy("rank").collect()
        assert [(r["print_id"], r["stored_id"], r["rank"]) for r in got] == want


def test_text_ids(vectors):
    df, base = vectors
    side = df.select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"), "vec")
    for plan in ({}, {"round_rows": 30}, {"prune": True, "leaf_rows": 16}):
        got = S.top_k_similar(side, side, 2, None, exclude_self=True, **plan)
        assert [(int(a), int(b), r) for a, b, r in rows_of(got, "query_id", "stored_id", "rank")] == brute(base, 2)


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_pair_statistics(vectors, block_rows):
    df, base = vectors
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    groups = [r["g"] for r in df.orderBy("id").collect()]
    cos = [u[i] @ u[j] for i, j in itertools.combinations(range(90), 2) if groups[i] == groups[j]]
    blocks = B.pack_group_blocks(df, "g", "id", "vec", block_rows)
    got = P.pair_summary(blocks).first()
    dist = 1 - np.array(cos)
    assert got["n_pairs"] == len(cos)
    assert [got[c] for c in ("mean_cos", "median_dist", "std_dist")] == pytest.approx(
        [np.mean(cos), np.median(dist), np.std(dist)], abs=1e-8
    )
    per = {r["g"]: r["mean_cos"] for r in P.intra_means(df, "g", "vec").collect()}
    hot_cos = [u[i] @ u[j] for i, j in itertools.combinations(range(0, 90, 3), 2)]
    assert per["hot"] == pytest.approx(np.mean(hot_cos))


@pytest.mark.parametrize("steps", [1, 7, 4096])
def test_median_takes_two_passes(vectors, monkeypatch, steps):
    """Whatever the width of the bins, also where the two middle distances lie in different ones."""
    df, base = vectors
    monkeypatch.setattr(P, "_STEPS", steps)
    monkeypatch.setattr(P, "_STEP", 1e-3)
    monkeypatch.setattr(P, "SIM_DECIMALS", 3)
    passes = []
    original = P._counted
    monkeypatch.setattr(P, "_counted", lambda *a: passes.append(1) or original(*a))
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    for rows in (90, 60, 3, 2):
        dist = 1 - np.round((u[:rows] @ u[:rows].T)[np.triu_indices(rows, 1)], 3)
        blocks = B.pack_blocks(df.where(F.col("id") < rows), "id", "vec", 30)
        assert P.pair_summary(blocks).first()["median_dist"] == pytest.approx(np.median(dist), abs=1e-8)
    assert len(passes) == 8


@pytest.mark.parametrize("block_rows", [3, 16, 1000])
def test_moments_without_pairs_across_blocks(vectors, block_rows):
    """Groups of one block and of many; blocks of fewer and of more rows than dimensions."""
    df, base = vectors
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    groups = [r["g"] for r in df.orderBy("id").collect()]
    for blocks, same in ((B.pack_group_blocks(df, "g", "id", "vec", block_rows), True), (B.pack_blocks(df, "id", "vec", block_rows), False)):
        cos = np.array([u[i] @ u[j] for i, j in itertools.combinations(range(90), 2) if not same or groups[i] == groups[j]])
        got = P.pair_moments(blocks).first()
        assert got["n_pairs"] == len(cos)
        assert (got["s"], got["ss"]) == (pytest.approx(cos.sum(), abs=1e-8), pytest.approx((cos**2).sum(), abs=1e-8))


def test_closest_pairs_and_boundaries(vectors):
    df, base = vectors
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    dist = 1 - np.round(u @ u.T, 9)
    want = sorted((round(dist[i, j], 9), i, j) for i, j in itertools.combinations(range(90), 2))[:25]
    for block_rows in (7, 1000):
        tiles = B.self_tiles(B.pack_blocks(df, "id", "vec", block_rows))
        got = P.closest_pairs(tiles, "bigint", 0.5, 25).collect()
        assert sorted((round(r["dist"], 9), r["card_a"], r["card_b"]) for r in got) == want
        near = {r["id"]: r for r in P.boundary_by_card(tiles, "bigint", 0.5).collect()}
        np.fill_diagonal(dist, np.inf)
        for i in (0, 1, 45, 89):
            assert near[i]["min_dist"] == pytest.approx(dist[i].min(), abs=1e-8)
            assert near[i]["n_critical"] == int((dist[i] < 0.5).sum()) and near[i]["n_pairs"] == 89


def test_metadata_joins_with_salted_keys(spark):
    """Hot prints, missing and NULL images: same rows as the two plain left joins."""
    from prismcat.operators.catalogue import embeddings_with_meta

    emb = spark.range(600).selectExpr(
        "id AS emb_id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 40 END AS print_id", "'x' AS mode", "CAST(NULL AS string) AS logical_id",
        "CASE WHEN id % 4 = 0 THEN NULL ELSE (CASE WHEN id % 3 = 0 THEN 5 ELSE id % 40 END) * 10 + id % 3 END AS image_id",
    )
    images = spark.range(0, 300, 2).selectExpr("id AS image_id", "'p' || id AS file_path", "'en' AS language")
    cards = spark.range(30).selectExpr("id AS print_id", "'L' || id AS logical_id", "'n' || id AS name")
    plain = emb.join(images, "image_id", "left").join(cards.drop("logical_id"), "print_id", "left")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("emb_id", "print_id", "image_id", "file_path", "name")]
    for least in (10, 200_000):
        assert rows_of(embeddings_with_meta(emb, images, cards, "x", min_rows=least), *text) == rows_of(plain, *text)
    assert embeddings_with_meta(emb, images, cards, "other").count() == 0


def test_spread_with_salted_hot_group(vectors):
    df, _ = vectors
    plain = G.cluster_spread(df, "g", "id", vec="vec")
    salted = G.cluster_spread(df, "g", "id", vec="vec", min_rows=1)
    cols = ["g", "n_vectors", F.round("intra_mean_dist", 9), F.round("intra_max_dist", 9), F.round("global_std", 9)]
    assert rows_of(plain, *cols) == rows_of(salted, *cols)


def test_one_query_block_against_many(vectors):
    """Fewer than k candidates, and queries that are not in the store."""
    df, _ = vectors
    few = df.where("id < 2").select("id", "vec")
    got = S.top_k_similar(df.select((F.col("id") + 1000).alias("id"), "vec"), few, 5, None)
    assert got.count() == 180
    assert S.top_k_similar(few.where("id > 5"), few, 3, None).count() == 0
    assert S.top_k_similar(few, few.where("id > 5"), 3, None).count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    """Tight clusters in separate directions; one of them holds a third of the rows, half of those being copies."""
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    label = np.where(np.arange(360) % 3 == 0, 0, 1 + np.arange(360) % 11)
    base = centres[label] + 0.02 * rng.normal(size=(360, 12))
    base[::6] = base[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>"), base


@pytest.mark.parametrize("threshold", [None, 0.9])
@pytest.mark.parametrize("leaf_rows", [4, 12, 400])
def test_tree_search_is_exact(clustered, threshold, leaf_rows):
    """A sixth of the vectors are copies of one, so a leaf is crowded whatever its size."""
    df, base = clustered
    got = rows_of(S.top_k_similar(df, df, 3, threshold, exclude_self=True, prune=True, leaf_rows=leaf_rows), "query_id", "stored_id", "rank")
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    assert got == [(q, d, r) for q, d, r in brute(base, 3) if threshold is None or sims[q, d] >= threshold]


def test_a_built_tree_serves_other_queries(clustered):
    df, base = clustered
    tree = C.build_tree(df, 8)
    asked = df.where("id % 5 = 0").select((F.col("id") + 1000).alias("id"), "vec")
    got = rows_of(S.top_k_similar(asked, tree, 2, None, prune=True), "query_id", "stored_id", "rank")
    assert [(q - 1000, d, r) for q, d, r in got] == [x for x in brute(base, 2, exclude=False) if x[0] % 5 == 0]


def test_tree_grows_with_the_vectors(spark):
    """Leaves keep their size, so the share of blocks a query has to see falls with the number of vectors."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 6))
    shares, levels = [], []
    for n in (500, 2500, 12_500):
        base = centres[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, 6))
        rows = list(enumerate(base.tolist()))
        df = spark.createDataFrame(rows, "id bigint, vec array<double>")
        tree = C.build_tree(df, 8)
        asked = spark.createDataFrame(rows[:60], "id bigint, vec array<double>")
        seen = S.visited_blocks(asked, tree, 3, exclude_self=True).agg(F.sum("queries").alias("q"), F.count(F.lit(1)).alias("blocks")).first()
        assert seen.blocks >= n / 8 and tree.leaves.agg(F.sum(F.size("ids"))).first()[0] == n
        shares.append(seen.q / seen.blocks / 60)
        levels.append(tree.levels)
    assert levels == [2, 2, 3]
    assert all(after < 2 * before / 3 for before, after in zip(shares, shares[1:]))


@pytest.mark.parametrize("by_card", [False, True])
def test_queries_are_fetched_by_bytes_not_by_rounds(vectors, monkeypatch, by_card):
    """However small the rounds, jobs and fetches follow the bytes of the queries; both sizes give the same hits."""
    df, base = vectors
    written = []
    original = S.materialise
    monkeypatch.setattr(S, "materialise", lambda rows, label: written.append(label) or original(rows, label))
    monkeypatch.setattr(S, "FEW_QUERIES", 10)
    side = df.select("id", "vec", (F.col("id") if by_card else F.lit("x")).alias("print_id"))
    search = S.top_k_cards if by_card else S.top_k_similar
    for round_bytes, deliveries in ((64 << 20, 1), (30 * 8 * base.shape[1], 3)):
        monkeypatch.setattr(S, "ROUND_BYTES", round_bytes)
        written.clear()
        got = search(side if by_card else side.drop("print_id"), side, 4, None, exclude_self=True, round_rows=2)
        if by_card:  # one vector a card, ties by the card as text
            u = base / np.linalg.norm(base, axis=1, keepdims=True)
            sims = np.round(u @ u.T, 9)
            np.fill_diagonal(sims, -np.inf)
            want = [(i, j, r + 1) for i, row in enumerate(sims) for r, j in enumerate(sorted(range(90), key=lambda j: (-row[j], str(j)))[:4])]
        else:
            want = brute(base, 4)
        assert rows_of(got, "query_id", "stored_id", "rank") == sorted(want)
        assert written == ["queries"] + ["round-hits"] * (deliveries - 1)  # 45 rounds before


def test_the_store_is_not_shuffled(vectors):
    df, _ = vectors
    stored = df.select("id", "vec").withColumn("vec", F.transform("vec", lambda x: x * 2))
    plan = S.candidate_hits(df.select("id", "vec"), stored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_many_small_blocks_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Each vector lies in one tile a panel at most, each pair in one tile; the statistics are those of all pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 6))
    base[700:] = base[0]  # a median among ties
    df = spark.createDataFrame([(i, "hot" if i < 600 or i >= 700 else f"g{i % 30}", [float(x) for x in v]) for i, v in enumerate(base)], "id bigint, g string, vec array<double>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    group = np.array([r["g"] for r in df.orderBy("id").collect()])
    i, j = np.triu_indices(len(base), 1)
    cos = np.round(unit @ unit.T, 9)[i, j]
    for blocks, wanted in ((B.pack_blocks(df, "id", "vec", 4), cos), (B.pack_group_blocks(df, "g", "id", "vec", 4), cos[group[i] == group[j]])):
        tiles = B.self_tiles(blocks).select("g", "a_ids", "b_ids")
        sent = tiles.select("g", F.explode(F.concat("a_ids", "b_ids")).alias("id")).groupBy("id").count().agg(F.max("count")).first()[0]
        assert sent <= B.MAX_PANELS  # 225 blocks of 4 rows before
        pairs = tiles.select(F.expr("CASE WHEN size(b_ids) = 0 THEN size(a_ids) * (size(a_ids) - 1) / 2 ELSE size(a_ids) * size(b_ids) END").alias("n"))
        assert pairs.agg(F.sum("n")).first()[0] == len(wanted)
        got = P.pair_summary(blocks).first()
        assert got["n_pairs"] == len(wanted)
        assert tuple(got)[1:] == pytest.approx((wanted.mean(), 1 - wanted.mean(), np.median(1 - wanted), (1 - wanted).std()), abs=1e-9)
    monkeypatch.setattr(B, "PANEL_BYTES", 10 * 4 * 6 * 8)  # panels of about ten blocks
    small = B.self_tiles(B.pack_blocks(df, "id", "vec", 4)).agg(F.max(F.length("a_mat"))).first()[0]
    assert 4 * 6 * 8 < small <= 2 * 10 * 4 * 6 * 8


@pytest.mark.parametrize("leaf_rows", [2, 8])
def test_neighbouring_leaves_are_multiplied_together(spark, monkeypatch, leaf_rows):
    """Vectors without clusters, which no cell can leave out: products are few and wide, and only promising rows are ranked."""
    base = np.random.default_rng(3).normal(size=(700, 16))
    base[300:340] = base[0]  # copies, so that hits tie
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "id bigint, vec array<double>")
    tree = C.build_tree(df, leaf_rows)
    rows = tree.leaves.toArrow().to_batches()
    ids, vectors = np.arange(700), base / np.linalg.norm(base, axis=1, keepdims=True)
    families = list(C._families(iter(rows)))
    assert sum(len(f) for f in families) == sum(b.num_rows for b in rows) > 700 // leaf_rows
    assert len(families) <= 700 // 128  # hundreds of products before, one for each block
    # what is left out by the cosines is what the angles leave out
    rng = np.random.default_rng(4)
    cosines, needed, radii = rng.uniform(-1, 1, (50, 40)), np.append(rng.uniform(-1, 1, 48), [-1.0, 1.0]), np.append(rng.uniform(0, np.pi, 38), [0.0, np.pi])
    closest = np.cos(np.clip(np.arccos(cosines) - radii - C._ANGLE_SLACK, 0.0, np.pi))
    assert (C._within(cosines, needed, radii) == (closest >= needed[:, None] - C._SIM_SLACK)).all()
    # ranked are the rows that can win only
    seen = []
    original = S._best
    monkeypatch.setattr(S, "_best", lambda sims, k: seen.append(len(sims)) or original(sims, k))
    sims = np.round(vectors @ vectors.T, 9)
    np.fill_diagonal(sims, -np.inf)
    floors = np.sort(sims, axis=1)[:, -3]
    best = S.Best(ids, vectors, 3, True, floors=floors)
    for family in families:
        near = np.concatenate([B.id_array(row["ids"]) for row in family])
        best.add(near, vectors[near])
    assert sum(seen) <= 3 * 700 + 41 * len(families)
    got = best.batch(-1.0, ["q", "d", "s"]).to_pydict()
    kept = {(q, d) for q, d in zip(got["q"], got["d"], strict=True)}
    assert {(q, d) for q, d, _ in brute(base, 3)} <= kept
    monkeypatch.undo()
    found = S.top_k_similar(df, tree, 3, None, exclude_self=True, prune=True)
    assert rows_of(found, "query_id", "stored_id", "rank") == brute(base, 3)
