"""Vector operators: scalar functions, similarity search, centroids, pair statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import V_CARDS, V_EMB, V_IMAGES, V_UNIT, cents, emb, query, r6, sql6, table, v_cent
from checks import base
from prismcat.functions import vectors as V
from prismcat.operators import blocks as B
from prismcat.operators import features as X
from prismcat.operators import groups as G
from prismcat.operators import pairs as P
from prismcat.operators import search as S
from prismcat.plans.recognition import recognise
from prismcat.sources import store

# Similarity floor that splits the test vectors.
FLOOR = 0.35


@query("p15_l2_normalise", f"""SELECT vec_id, CAST(i - 1 AS INT) AS dim, {sql6("x[i] / greatest(sqrt(list_dot_product(x, x)), 1e-12)", "value")}
 FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: e * (vec_id % 7)) AS x FROM embeddings), range(1, 65) t(i)""")
def p15(spark, sf) -> DataFrame:
    scaled = table(spark, sf, "embeddings").select(
        "vec_id", F.expr("transform(embedding, e -> cast(e as double) * (vec_id % 7))").alias("x")
    )
    return scaled.select("vec_id", F.posexplode(V.unit(F.col("x"))).alias("dim", "value")).select("vec_id", "dim", r6("value"))


@query("p16_dimension_check", """SELECT vec_id, CAST(len(x) AS INT) AS dim FROM
 (SELECT vec_id, list_slice(embedding, 1, 60 + CAST(least(vec_id % 7, 4) AS INT)) AS x FROM embeddings) WHERE len(x) <> 64""")
def p16(spark, sf) -> DataFrame:
    ragged = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "slice(embedding, 1, 60 + cast(least(vec_id % 7, 4) as int)) AS x"
    )
    return store.dimension_rejects(ragged, "x", 64).select("vec_id", F.size("x").alias("dim"))


@query("p17_distances", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), p AS
 (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, {sql6("c", "cosine")}, {sql6("1 - c", "cosine_distance")},
 {sql6("sqrt(least(greatest(2 - 2 * c, 0), 4))", "euclid")} FROM p""")
def p17(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    both = e.select("vec_id", F.col("embedding").alias("a")).join(nxt, "vec_id")
    cos = both.select("vec_id", V.cosine(F.col("a"), F.col("b")).alias("cosine"))
    return cos.withColumn("cosine_distance", 1 - F.col("cosine")).withColumn(
        "euclid", V.unit_euclid_from_cosine(F.col("cosine"))
    ).select("vec_id", r6("cosine"), r6("cosine_distance"), r6("euclid"))


@query("s05_blob_decode", f"""SELECT vec_id, CAST(i - 1 AS INT) AS dim, {sql6("embedding[i]::DOUBLE", "value")}
 FROM embeddings, range(1, 65) t(i)""")
def s05(spark, sf) -> DataFrame:
    blobs = table(spark, sf, "embeddings").select("vec_id", store.encode_blob(F.col("embedding")).alias("blob"))
    vec = blobs.select("vec_id", store.decode_blob(F.col("blob"), 64).alias("v"))
    return vec.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", "dim", F.round(F.col("value").cast("double"), 6).alias("value")
    )


# --- similarity search ------------------------------------------------------------------------

HITS = V_UNIT + f""", s AS (SELECT a.emb_id q, b.emb_id d, round(list_dot_product(a.u, b.u), 9) s
 FROM v_unit a JOIN v_unit b ON a.emb_id <> b.emb_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) rk FROM s),
 hits AS (SELECT * FROM ranked WHERE rk <= 3 AND s >= {FLOOR}),
 matches AS (SELECT e.emb_id AS query_id, h.d AS stored_id, coalesce(h.s, 0.0) AS score FROM v_unit e
  LEFT JOIN hits h ON h.q = e.emb_id AND h.rk = 1),
 graded AS (SELECT *, CASE WHEN score > 0.8 THEN 'excellent' WHEN score > 0.6 THEN 'good' WHEN score > 0.4 THEN 'poor'
  ELSE 'none' END AS grade FROM matches)"""


def _vectors(spark, sf) -> DataFrame:
    return emb(spark, sf).select(F.col("emb_id").alias("id"), F.col("emb").alias("vec"), "print_id")


def _run(spark, sf):
    v = _vectors(spark, sf)
    return recognise(v, v, k=3, threshold=FLOOR, exclude_self=True)


@query("j09_topk_similarity", f"""WITH {HITS} SELECT q AS query_id, d AS stored_id, {sql6("s", "similarity")},
 {sql6("1 - s", "distance")}, CAST(rk AS INT) AS "rank" FROM hits""")
def j09(spark, sf) -> DataFrame:
    v = _vectors(spark, sf).select("id", "vec")
    hits = S.top_k_similar(v, v, 3, FLOOR, exclude_self=True)
    return hits.select("query_id", "stored_id", r6("similarity"), r6("distance"), "rank")


@query("j09_topk_similarity_tiles", f"""WITH {HITS} SELECT q AS query_id, d AS stored_id, {sql6("s", "similarity")},
 {sql6("1 - s", "distance")}, CAST(rk AS INT) AS "rank" FROM hits""")
def j09_tiles(spark, sf) -> DataFrame:
    """Many queries: a task takes them up in several rounds over its part of the store."""
    v = _vectors(spark, sf).select("id", "vec")
    hits = S.top_k_similar(v, v, 3, FLOOR, exclude_self=True, round_rows=1024)
    return hits.select("query_id", "stored_id", r6("similarity"), r6("distance"), "rank")


@query("j09_topk_similarity_pruned", f"""WITH {HITS} SELECT q AS query_id, d AS stored_id, {sql6("s", "similarity")},
 {sql6("1 - s", "distance")}, CAST(rk AS INT) AS "rank" FROM hits""")
def j09_pruned(spark, sf) -> DataFrame:
    """The same through a cell tree of small leaves; cells out of reach are left out."""
    v = _vectors(spark, sf).select("id", "vec")
    hits = S.top_k_similar(v, v, 3, FLOOR, exclude_self=True, prune=True, leaf_rows=32)
    return hits.select("query_id", "stored_id", r6("similarity"), r6("distance"), "rank")


CARD_SQL = f"""WITH {HITS}, c AS (SELECT s.q, e.print_id, s.d, s.s, row_number() OVER (PARTITION BY s.q, e.print_id ORDER BY s.s DESC, s.d) rn
 FROM s JOIN v_emb e ON e.emb_id = s.d), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, CAST(print_id AS VARCHAR)) rk FROM c WHERE rn = 1)
 SELECT q AS query_id, print_id, d AS stored_id, {sql6("s", "similarity")}, CAST(rk AS INT) AS "rank" FROM r WHERE rk <= 5 AND s >= 0.2"""


def _cards(spark, sf, **plan) -> DataFrame:
    v = _vectors(spark, sf)
    hits = S.top_k_cards(v, v, 5, 0.2, exclude_self=True, **plan)
    return hits.select("query_id", "print_id", "stored_id", r6("similarity"), "rank")


@query("j09_topk_cards", CARD_SQL)
def j09_cards(spark, sf) -> DataFrame:
    """At most one hit per print."""
    return _cards(spark, sf)


@query("j09_topk_cards_tiles", CARD_SQL)
def j09_cards_tiles(spark, sf) -> DataFrame:
    return _cards(spark, sf, round_rows=512)


@query("p18_match_grade", f"""WITH {HITS} SELECT query_id, stored_id, {sql6("score", "score")}, grade FROM graded""")
def p18(spark, sf) -> DataFrame:
    return _run(spark, sf).matches.select("query_id", "stored_id", r6("score"), "grade")


@query("g16_run_summary", f"""WITH {HITS} SELECT count(*) AS searched, count(score) AS scored, {sql6("max(score)", "best_score")},
 {sql6("min(score)", "worst_score")}, {sql6("avg(score)", "mean_score")} FROM graded""")
def g16(spark, sf) -> DataFrame:
    s = _run(spark, sf).summary
    return s.select("searched", "scored", r6("best_score"), r6("worst_score"), r6("mean_score"))


@query("g17_grade_distribution", f"""WITH {HITS} SELECT grade, count(*) AS n,
 {sql6("count(*)::DOUBLE / (SELECT count(*) FROM graded)", "share")} FROM graded GROUP BY grade""")
def g17(spark, sf) -> DataFrame:
    return _run(spark, sf).grades.select("grade", "n", r6("share"))


@query("i08_recognition", f"""WITH {HITS}, {V_CARDS} SELECT h.q AS query_id, CAST(h.rk AS INT) AS "rank", e.print_id, k.name, k.set_code,
 k.collector_number, {sql6("h.s", "similarity")} FROM hits h JOIN v_emb e ON e.emb_id = h.d LEFT JOIN v_cards k ON k.print_id = e.print_id""")
def i08(spark, sf) -> DataFrame:
    v = _vectors(spark, sf)
    fields = base.cards(spark, sf).select("print_id", "name", "set_code", "collector_number")
    hits = recognise(v, v, fields, 3, FLOOR, exclude_self=True).hits
    return hits.select("query_id", "rank", "print_id", "name", "set_code", "collector_number", r6("similarity"))


@query("g14_score_histogram", f"""WITH {HITS}, e AS (SELECT min(score) lo, max(score) hi FROM graded),
 c AS (SELECT least(floor((score - lo) / (hi - lo) * 20), 19)::BIGINT b, count(*) n FROM graded, e GROUP BY 1)
 SELECT r.b AS bin, {sql6("lo + r.b * ((hi - lo) / 20)", "low")}, {sql6("lo + (r.b + 1) * ((hi - lo) / 20)", "high")},
 coalesce(c.n, 0) AS n FROM range(0, 20) r(b) CROSS JOIN e LEFT JOIN c ON c.b = r.b""")
def g14(spark, sf) -> DataFrame:
    return X.histogram(_run(spark, sf).matches, "score", 20).select("bin", r6("low"), r6("high"), "n")


@query("g15_score_boxplot", f"""WITH {HITS}, q AS (SELECT quantile_cont(score, 0.25) q1, quantile_cont(score, 0.5) q2,
 quantile_cont(score, 0.75) q3 FROM graded), f AS (SELECT score, q1, q2, q3,
 score BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM graded, q)
 SELECT {sql6("min(q1)", "q1")}, {sql6("min(q2)", "median")}, {sql6("min(q3)", "q3")},
 {sql6("min(score) FILTER (inside)", "whisker_low")}, {sql6("max(score) FILTER (inside)", "whisker_high")},
 count(*) FILTER (NOT inside) AS outliers, count(score) AS n FROM f""")
def g15(spark, sf) -> DataFrame:
    b = X.box_plot(_run(spark, sf).matches, "score")
    names = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return b.select(*[r6(n) for n in names], "outliers", "n")


# --- grouping and centroids -------------------------------------------------------------------


@query("g01_vectors_by_card", f"""WITH {V_EMB} SELECT print_id, emb_id,
 row_number() OVER (PARTITION BY print_id ORDER BY aug_index, emb_id) - 1 AS position FROM v_emb""")
def g01(spark, sf) -> DataFrame:
    order = [F.col("aug_index"), F.col("emb_id")]
    return G.vectors_by_card(emb(spark, sf).drop("emb"), "print_id", order).select("print_id", "emb_id", "position")


def _centroid_sql(key: str) -> str:
    return f"""WITH {v_cent(key)} SELECT g AS {key}, CAST(i - 1 AS INT) AS dim, {sql6("c[i]", "value")}, n AS n_vectors
 FROM v_cent, range(1, 65) t(i)"""


def _centroids(spark, sf, key) -> DataFrame:
    c = G.centroids(emb(spark, sf), key, normalise_rows=True)
    return c.select(key, F.posexplode("centroid").alias("dim", "value"), "n_vectors").select(
        key, "dim", r6("value"), "n_vectors"
    )


@query("g02_centroid", _centroid_sql("print_id"))
def g02(spark, sf) -> DataFrame:
    return _centroids(spark, sf, "print_id")


@query("g02_centroid_by_group", _centroid_sql("group_id"))
def g02_group(spark, sf) -> DataFrame:
    return _centroids(spark, sf, "group_id")


def spread_ctes(key: str) -> str:
    return v_cent(key) + f""", v_dist AS (SELECT c.g, sqrt(list_sum(list_transform(list_zip(e.u, c.c), lambda z: (z[1] - z[2]) ** 2))) d
 FROM v_unit e JOIN v_cent c ON c.g = e.{key}),
 v_spread AS (SELECT g, count(*) n_vectors, avg(d) intra_mean_dist, max(d) intra_max_dist FROM v_dist GROUP BY g),
 v_global AS (SELECT avg(intra_mean_dist) global_mean, stddev_pop(intra_mean_dist) global_std FROM v_spread)"""


@query("g03_cluster_spread", f"""WITH {spread_ctes("print_id")} SELECT g AS print_id, n_vectors, {sql6("intra_mean_dist", "intra_mean_dist")},
 {sql6("intra_max_dist", "intra_max_dist")}, {sql6("global_mean", "global_mean")}, {sql6("global_std", "global_std")} FROM v_spread, v_global""")
def g03(spark, sf) -> DataFrame:
    s = G.cluster_spread(emb(spark, sf), "print_id", "emb_id")
    return s.select("print_id", "n_vectors", *[r6(c) for c in s.columns[2:]])


@query("g12_coverage", f"""WITH {V_EMB}, c AS (SELECT print_id, count(*) n, max(len(emb)) dim FROM v_emb GROUP BY 1)
 SELECT count(*) AS cards, count(*) FILTER (n >= 2) AS cards_multi, CAST(sum(n) AS BIGINT) AS vectors, CAST(max(dim) AS INT) AS dimension FROM c""")
def g12(spark, sf) -> DataFrame:
    return G.coverage(emb(spark, sf), "print_id")


def nearest_ctes(key: str) -> str:
    return v_cent(key) + """, nn AS (SELECT a.g, b.g AS o, round(list_dot_product(a.c, b.c), 9) s, row_number() OVER
 (PARTITION BY a.g ORDER BY round(list_dot_product(a.c, b.c), 9) DESC, b.g) rk FROM v_cent a JOIN v_cent b ON a.g <> b.g),
 v_near AS (SELECT c.g, nn.o AS neighbour, nn.s AS neighbour_cos, sqrt(least(greatest(2 - 2 * nn.s, 0), 4)) AS neighbour_dist,
 1 - nn.s AS neighbour_cos_dist FROM v_cent c LEFT JOIN nn ON nn.g = c.g AND nn.rk = 1)"""


@query("j10_nearest_centroid", f"""WITH {nearest_ctes("print_id")} SELECT g AS print_id, neighbour, {sql6("neighbour_cos", "neighbour_cos")},
 {sql6("neighbour_dist", "neighbour_dist")}, {sql6("neighbour_cos_dist", "neighbour_cos_dist")} FROM v_near""")
def j10(spark, sf) -> DataFrame:
    n = S.nearest_neighbour(cents(spark, sf, "print_id"), "print_id")
    return n.select("print_id", "neighbour", *[r6(c) for c in n.columns[2:]])


@query("w10_confusable_cards", f"""WITH {nearest_ctes("print_id")} SELECT g AS print_id, neighbour, {sql6("neighbour_cos", "neighbour_cos")},
 {sql6("neighbour_cos_dist", "neighbour_cos_dist")} FROM v_near ORDER BY v_near.neighbour_cos_dist, g LIMIT 20""")
def w10(spark, sf) -> DataFrame:
    n = S.nearest_neighbour(cents(spark, sf, "print_id"), "print_id")
    top = n.orderBy(F.asc_nulls_last("neighbour_cos_dist"), "print_id").limit(20)
    return top.select("print_id", "neighbour", r6("neighbour_cos"), r6("neighbour_cos_dist"))


# --- pair statistics ----------------------------------------------------------------------------

PAIRS = V_UNIT + """, v_pairs AS (SELECT a.print_id, round(list_dot_product(a.u, b.u), 9) AS cos FROM v_unit a
 JOIN v_unit b ON a.print_id = b.print_id AND a.emb_id < b.emb_id),
 v_intra AS (SELECT print_id, count(*) AS n_pairs, avg(cos) AS mean_cos, avg(1 - cos) AS mean_dist FROM v_pairs GROUP BY 1),
 v_daug AS (SELECT coalesce(avg(1 - cos), 0) AS d_aug FROM v_pairs)"""
CENT_PAIRS = v_cent("print_id") + """, c_pairs AS (SELECT a.g AS card_a, b.g AS card_b, round(list_dot_product(a.c, b.c), 9) AS cos
 FROM v_cent a JOIN v_cent b ON a.g < b.g)"""
BOTH = PAIRS + "," + CENT_PAIRS[len(V_UNIT) + 1:]
SUMMARY = f"""count(*) AS n_pairs, {sql6("avg(cos)", "mean_cos")}, {sql6("avg(1 - cos)", "mean_dist")},
 {sql6("quantile_cont(1 - cos, 0.5)", "median_dist")}, {sql6("stddev_pop(1 - cos)", "std_dist")}"""
STATS = ["mean_cos", "mean_dist", "median_dist", "std_dist"]


def _intra_blocks(spark, sf, block_rows=B.BLOCK_ROWS) -> DataFrame:
    return B.pack_group_blocks(emb(spark, sf), "print_id", "emb_id", "emb", block_rows)


def _cent_blocks(spark, sf, block_rows=B.BLOCK_ROWS) -> DataFrame:
    return B.pack_blocks(cents(spark, sf, "print_id"), "print_id", "centroid", block_rows)


def _d_aug(spark, sf):
    return P.d_aug(P.intra_means(emb(spark, sf), "print_id")).scalar()


@query("j15_intra_pairs", f"""WITH {PAIRS} SELECT print_id, n_pairs, {sql6("mean_cos", "mean_cos")}, {sql6("mean_dist", "mean_dist")} FROM v_intra""")
def j15(spark, sf) -> DataFrame:
    return P.intra_means(emb(spark, sf), "print_id").select("print_id", "n_pairs", r6("mean_cos"), r6("mean_dist"))


@query("g05_intra_stats", f"WITH {PAIRS} SELECT {SUMMARY} FROM v_pairs")
def g05(spark, sf) -> DataFrame:
    return P.pair_summary(_intra_blocks(spark, sf)).select("n_pairs", *[r6(c) for c in STATS])


@query("g05_intra_stats_split_groups", f"WITH {PAIRS} SELECT {SUMMARY} FROM v_pairs")
def g05_split(spark, sf) -> DataFrame:
    """Every card cut into several blocks, as a hot card would be."""
    return P.pair_summary(_intra_blocks(spark, sf, 8)).select("n_pairs", *[r6(c) for c in STATS])


MOMENTS = f"""count(*) AS n_pairs, {sql6("avg(cos)", "mean_cos")}, {sql6("avg(1 - cos)", "mean_dist")}, {sql6("stddev_pop(1 - cos)", "std_dist")}"""


@query("g05_intra_moments", f"WITH {PAIRS} SELECT {MOMENTS} FROM v_pairs")
def g05_moments(spark, sf) -> DataFrame:
    """Count, mean and deviation from summed outer products, without a pass over pairs; every card in several blocks."""
    return P.pair_summary(_intra_blocks(spark, sf, 8), median=False).select("n_pairs", r6("mean_cos"), r6("mean_dist"), r6("std_dist"))


@query("g07_vector_pair_moments", f"""WITH {V_UNIT}, p AS (SELECT round(list_dot_product(a.u, b.u), 9) AS cos FROM v_unit a
 JOIN v_unit b ON a.emb_id < b.emb_id) SELECT {MOMENTS} FROM p""")
def g07_moments(spark, sf) -> DataFrame:
    blocks = B.pack_blocks(emb(spark, sf), "emb_id", "emb", 128)
    return P.pair_summary(blocks, median=False).select("n_pairs", r6("mean_cos"), r6("mean_dist"), r6("std_dist"))


@query("g06_d_aug", f"""WITH {PAIRS} SELECT {sql6("d_aug", "d_aug")} FROM v_daug""")
def g06(spark, sf) -> DataFrame:
    return P.d_aug(P.intra_means(emb(spark, sf), "print_id")).select(r6("d_aug"))


@query("g07_inter_stats", f"WITH {CENT_PAIRS} SELECT {SUMMARY} FROM c_pairs")
def g07(spark, sf) -> DataFrame:
    return P.pair_summary(_cent_blocks(spark, sf)).select("n_pairs", *[r6(c) for c in STATS])


@query("g07_vector_pair_stats", f"""WITH {V_UNIT}, p AS (SELECT round(list_dot_product(a.u, b.u), 9) AS cos FROM v_unit a
 JOIN v_unit b ON a.emb_id < b.emb_id) SELECT {SUMMARY} FROM p""")
def g07_vectors(spark, sf) -> DataFrame:
    """The same statistics over all pairs of vectors, in blocks of 128 rows."""
    return P.pair_summary(B.pack_blocks(emb(spark, sf), "emb_id", "emb", 128)).select("n_pairs", *[r6(c) for c in STATS])


@query("g08_separation", f"""WITH {BOTH}, x AS (SELECT (SELECT avg(1 - cos) FROM v_pairs) d, (SELECT quantile_cont(1 - cos, 0.5) FROM c_pairs) m)
 SELECT {sql6("d", "d_aug")}, {sql6("m", "dist_med")}, {sql6("m / d", "q")}, {sql6("1 - 1.5 * d", "thr_high")}, {sql6("1 - m", "thr_low")} FROM x""")
def g08(spark, sf) -> DataFrame:
    s = P.separation(P.d_aug(P.intra_means(emb(spark, sf), "print_id")), P.pair_summary(_cent_blocks(spark, sf)))
    return s.select(*[r6(c) for c in s.columns])


def _histogram_sql(ctes: str, pairs: str) -> str:
    return f"""WITH {ctes}, c AS (SELECT least(floor((cos - 0.0) / 1.0 * 40), 39)::BIGINT b, count(*) n FROM {pairs}
 WHERE cos BETWEEN 0 AND 1 GROUP BY 1) SELECT r.b AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM range(0, 40) r(b) LEFT JOIN c ON c.b = r.b"""


@query("g13_intra_histogram", _histogram_sql(PAIRS, "v_pairs"))
def g13(spark, sf) -> DataFrame:
    return P.cosine_histogram(B.self_tiles(_intra_blocks(spark, sf)))


@query("g13_inter_histogram", _histogram_sql(CENT_PAIRS, "c_pairs"))
def g13_inter(spark, sf) -> DataFrame:
    return P.cosine_histogram(B.self_tiles(_cent_blocks(spark, sf)))


CARD_PAIRS = BOTH + """, v_sides AS (SELECT card_a AS id, cos FROM c_pairs UNION ALL SELECT card_b, cos FROM c_pairs)"""


@query("j16_inter_pairs_by_card", f"""WITH {CARD_PAIRS} SELECT id AS print_id, count(*) AS n_pairs, {sql6("avg(cos)", "mean_cos")},
 {sql6("min(1 - cos)", "min_dist")} FROM v_sides GROUP BY id""")
def j16(spark, sf) -> DataFrame:
    b = P.boundary_by_card(B.self_tiles(_cent_blocks(spark, sf)), "bigint", 0.0)
    return b.select(F.col("id").alias("print_id"), "n_pairs", r6("mean_cos"), r6("min_dist"))


@query("j17_boundaries", f"""WITH {CARD_PAIRS} SELECT id AS print_id, CAST(count(*) FILTER (1 - cos - d_aug < 0) AS BIGINT) AS n_critical,
 {sql6("min(1 - cos) - any_value(d_aug)", "min_boundary")}, {sql6("avg(1 - cos) - any_value(d_aug)", "mean_boundary")}
 FROM v_sides, v_daug GROUP BY id""")
def j17(spark, sf) -> DataFrame:
    b = P.boundary_by_card(B.self_tiles(_cent_blocks(spark, sf)), "bigint", _d_aug(spark, sf))
    return b.select(F.col("id").alias("print_id"), "n_critical", r6("min_boundary"), r6("mean_boundary"))


@query("g21_closest_boundary", f"""WITH {CARD_PAIRS}, m AS (SELECT id, min(1 - cos) - any_value(d_aug) AS b FROM v_sides, v_daug GROUP BY id)
 SELECT id AS print_id, {sql6("b", "min_boundary")}, row_number() OVER (ORDER BY round(b, 9), id) - 1 AS place FROM m""")
def g21(spark, sf) -> DataFrame:
    from prismcat.operators.numbering import with_global_index

    near = S.nearest_neighbour(cents(spark, sf, "print_id"), "print_id").withColumn("_d", _d_aug(spark, sf))
    edge = near.select("print_id", F.coalesce(F.col("neighbour_cos_dist") - F.col("_d"), F.lit(0.0)).alias("min_boundary"))
    placed = with_global_index(edge, [F.round("min_boundary", 9), F.col("print_id")], "place")
    return placed.select("print_id", r6("min_boundary"), "place")


@query("w11_critical_pairs", f"""WITH {BOTH} SELECT card_a, card_b, {sql6("1 - cos", "dist")}, {sql6("1 - cos - d_aug", "boundary")},
 1 - cos - d_aug < 0 AS critical FROM c_pairs, v_daug ORDER BY 1 - c_pairs.cos, card_a, card_b LIMIT 20""")
def w11(spark, sf) -> DataFrame:
    top = P.closest_pairs(B.self_tiles(_cent_blocks(spark, sf)), "bigint", _d_aug(spark, sf), 20)
    return top.select("card_a", "card_b", r6("dist"), r6("boundary"), "critical")


@query("w09_high_variance_cards", f"""WITH {PAIRS} SELECT print_id, n_pairs, {sql6("mean_dist", "mean_dist")} FROM v_intra
 ORDER BY v_intra.mean_dist DESC, print_id LIMIT 20""")
def w09(spark, sf) -> DataFrame:
    top = P.intra_means(emb(spark, sf), "print_id").orderBy(F.desc("mean_dist"), "print_id").limit(20)
    return top.select("print_id", "n_pairs", r6("mean_dist"))


# --- export rows --------------------------------------------------------------------------------


@query("w01_number_vectors", f"""WITH {V_EMB} SELECT emb_id, print_id, CAST(row_number() OVER (PARTITION BY print_id ORDER BY image_id, emb_id) - 1 AS INT)
 AS aug_index FROM v_emb""")
def w01(spark, sf) -> DataFrame:
    rows = emb(spark, sf).drop("aug_index", "emb")
    return G.number_vectors(rows, "print_id", [F.col("image_id"), F.col("emb_id")]).select("emb_id", "print_id", "aug_index")


@query("w02_export_records", f"""WITH {v_cent("print_id")}, r AS (SELECT print_id, CAST(row_number() OVER (PARTITION BY print_id ORDER BY image_id, emb_id) - 1 AS INT)
 AS aug_index, image_id, u[1] AS first_value FROM v_unit UNION ALL SELECT g, 999, NULL, c[1] FROM v_cent)
 SELECT print_id, aug_index, image_id, {sql6("first_value", "first_value")} FROM r""")
def w02(spark, sf) -> DataFrame:
    rows = emb(spark, sf).drop("aug_index").withColumn("emb", V.unit(F.col("emb")))
    out = G.export_records(rows, "print_id", [F.col("image_id"), F.col("emb_id")])
    return out.select("print_id", "aug_index", "image_id", F.round(F.col("emb")[0], 6).alias("first_value"))


@query("g18_export_audit", f"""WITH {V_EMB}, c AS (SELECT print_id, count(*) n FROM v_emb GROUP BY 1)
 SELECT print_id, n AS written, CAST(12 AS BIGINT) AS expected, n - 12 AS difference FROM c WHERE n <> 12""")
def g18(spark, sf) -> DataFrame:
    want = G.expected_vectors(11, True, True, False)
    return G.export_audit(emb(spark, sf), "print_id", want).where(F.col("difference") != 0)


STORE_SQL = f"""WITH {v_cent("print_id")} SELECT 'analysis' AS mode, count(*) AS n, count(DISTINCT print_id) AS cards FROM v_emb
 UNION ALL SELECT 'runtime', count(*), count(DISTINCT g) FROM v_cent"""


@query("s06_replace_mode", STORE_SQL)
def s06(spark, sf) -> DataFrame:
    from prismcat.session import scratch_path

    path = scratch_path(spark, "store")
    rows = emb(spark, sf)
    store.replace_mode(rows, path, "analysis", 64)
    store.replace_mode(rows, path, "runtime", 64)
    center = G.centroids(rows, "print_id").select("print_id", F.col("centroid").alias("emb"))
    store.replace_mode(center, path, "runtime", 64)
    back = store.read_store(spark, path)
    return back.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("print_id").alias("cards"))


@query("s06_model_id_of_one_mode", f"""WITH {V_EMB} SELECT 'analysis' AS mode, count(*) AS n, CAST(0 AS BIGINT) AS with_model FROM v_emb
 UNION ALL SELECT 'runtime', count(*), count(*) FILTER (WHERE print_id % 2 = 0) FROM v_emb""")
def s06_model_id(spark, sf) -> DataFrame:
    """A column that only the newer mode has is read from it."""
    from prismcat.session import scratch_path

    path = scratch_path(spark, "store")
    rows = emb(spark, sf)
    store.replace_mode(rows, path, "analysis", 64)
    store.replace_mode(rows.withColumn("model_id", F.expr("CASE WHEN print_id % 2 = 0 THEN 'm1' END")), path, "runtime", 64)
    return store.read_store(spark, path).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count("model_id").alias("with_model"))


@query("s10_column_added_later", f"""WITH {V_EMB} SELECT DISTINCT print_id, CASE WHEN print_id % 3 <> 0 THEN 0 ELSE 1 END AS flag,
 CASE WHEN print_id % 3 = 0 THEN 'late' END AS note FROM v_emb""")
def s10_added(spark, sf) -> DataFrame:
    """A second snapshot adds a column; rows that it doesn't touch have NULL there."""
    from prismcat.session import scratch_path

    path = scratch_path(spark, "quality")
    prints = emb(spark, sf).select("print_id").distinct()
    store.upsert_quality(prints.withColumn("flag", F.lit(0)), path, "print_id")
    some = prints.where("print_id % 3 = 0").select("print_id", F.lit(1).alias("flag"), F.lit("late").alias("note"))
    store.upsert_quality(some, path, "print_id")
    return store.current_snapshot(spark, path)[1]


@query("j01_embedding_image_card", f"""WITH {V_EMB}, {V_IMAGES}, {V_CARDS} SELECT e.emb_id, e.print_id, e.aug_index, i.file_path,
 i.language AS image_language, k.name, k.set_code FROM v_emb e LEFT JOIN v_images i ON i.image_id = e.image_id
 LEFT JOIN v_cards k ON k.print_id = e.print_id WHERE e.mode = 'analysis'""")
def j01(spark, sf) -> DataFrame:
    from prismcat.operators.catalogue import embeddings_with_meta

    joined = embeddings_with_meta(emb(spark, sf), base.images(spark, sf), base.cards(spark, sf), "analysis")
    return joined.select("emb_id", "print_id", "aug_index", "file_path", "image_language", "name", "set_code")


HEADERS = f"""{V_EMB}, {V_IMAGES}, {V_CARDS}, j AS (SELECT e.emb_id, e.print_id, e.aug_index, i.file_path, i.language, k.name, k.set_code
 FROM v_emb e LEFT JOIN v_images i ON i.image_id = e.image_id LEFT JOIN v_cards k ON k.print_id = e.print_id)"""


@query("g01_card_headers", f"""WITH {HEADERS} SELECT print_id, count(*) AS n_vectors, arg_min(name, aug_index::BIGINT * 1000000000 + emb_id) AS name,
 arg_min(set_code, aug_index::BIGINT * 1000000000 + emb_id) AS set_code, arg_min(language, aug_index::BIGINT * 1000000000 + emb_id) FILTER (language <> '') AS image_language
 FROM j GROUP BY print_id""")
def g01_headers(spark, sf) -> DataFrame:
    from prismcat.operators.catalogue import embeddings_with_meta

    joined = embeddings_with_meta(emb(spark, sf), base.images(spark, sf), base.cards(spark, sf), "analysis")
    order = [F.col("aug_index"), F.col("emb_id")]
    return G.card_headers(joined, "print_id", order, ["name", "set_code"], "image_language")


@query("w03_paths_in_first_seen_order", f"""WITH {HEADERS}, f AS (SELECT print_id, file_path, min(aug_index::BIGINT * 1000000000 + emb_id) p FROM j
 WHERE file_path <> '' GROUP BY ALL) SELECT print_id, file_path, row_number() OVER (PARTITION BY print_id ORDER BY p, file_path) - 1 AS position FROM f""")
def w03(spark, sf) -> DataFrame:
    from prismcat.operators.catalogue import embeddings_with_meta

    joined = embeddings_with_meta(emb(spark, sf), base.images(spark, sf), base.cards(spark, sf), "analysis")
    order = [F.col("aug_index"), F.col("emb_id")]
    return G.values_in_first_seen_order(joined, "print_id", "file_path", order).select("print_id", "file_path", "position")


@query("p23_search_rows", f"""WITH {HEADERS} SELECT j.emb_id, j.print_id, coalesce(nullif(j.name, ''), CAST(j.print_id AS VARCHAR)) AS label,
 coalesce(j.set_code, '') AS set_code, coalesce(j.file_path, '') AS image_path, {sql6("e.emb[1]::DOUBLE / sqrt(list_dot_product(e.emb::DOUBLE[], e.emb::DOUBLE[]))", "first_value")}
 FROM j JOIN v_emb e ON e.emb_id = j.emb_id""")
def p23(spark, sf) -> DataFrame:
    from prismcat.operators.catalogue import embeddings_with_meta, search_rows

    rows = search_rows(embeddings_with_meta(emb(spark, sf), base.images(spark, sf), base.cards(spark, sf), "analysis"))
    return rows.select(
        "emb_id", "print_id", "label", "set_code", "image_path", F.round(F.col("emb")[0], 6).alias("first_value")
    )
