"""Sampling, triplets, losses, PCA, scaling, projector export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import V_CARDS, V_EMB, cards, cents, emb, images, query, r6, sql6, table
from prismcat.operators import features as X
from prismcat.session import scratch_path
from prismcat.sources import reports


@query("m01_fixed_sample")
def m01(spark, sf) -> DataFrame:
    return X.fixed_sample(table(spark, sf, "embeddings"), "vec_id", 200, seed=42).select("vec_id", "label")


@query("m01_sample_invariants", "SELECT least(count(*), 200) AS n, least(count(*), 200) AS known FROM embeddings")
def m01_invariants(spark, sf) -> DataFrame:
    """Exactly 200 different rows of the table, or all of them."""
    e = table(spark, sf, "embeddings").select("vec_id")
    picked = X.fixed_sample(e, "vec_id", 200, seed=7)
    known = e.join(picked, "vec_id", "left_semi").agg(F.countDistinct("vec_id")).scalar()
    return picked.agg(F.count(F.lit(1)).alias("n")).withColumn("known", known)


def _triplets(spark, sf) -> DataFrame:
    return X.triplets(images(spark, sf).select("print_id", F.col("file_path").alias("path")))


@query("m02_triplets")
def m02(spark, sf) -> DataFrame:
    return _triplets(spark, sf)


@query("m02_triplet_invariants", """WITH i AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem), s AS (SELECT l_partkey, count(*) n FROM i GROUP BY 1)
 SELECT (SELECT count(*) FROM i) AS triplets, CAST(0 AS BIGINT) AS same_class, CAST(0 AS BIGINT) AS anchor_is_positive, CAST(0 AS BIGINT) AS wrong_owner,
 (SELECT count(*) FROM s) AS classes""")
def m02_invariants(spark, sf) -> DataFrame:
    """What must hold for every draw: one triplet per image, right owners, positive differs if it can."""
    sizes = images(spark, sf).groupBy("print_id").agg(F.count(F.lit(1)).alias("size"))
    t = _triplets(spark, sf).join(sizes, "print_id")
    owner = lambda c: F.split(F.element_at(F.split(c, "/"), -1), "_")[0].cast("bigint")
    wrong = (owner("anchor") != F.col("print_id")) | (owner("positive") != F.col("print_id")) | (
        owner("negative") != F.col("negative_print_id")
    )
    return t.agg(
        F.count(F.lit(1)).alias("triplets"),
        F.count_if(F.col("print_id") == F.col("negative_print_id")).alias("same_class"),
        F.count_if((F.col("anchor") == F.col("positive")) & (F.col("size") > 1)).alias("anchor_is_positive"),
        F.count_if(wrong).alias("wrong_owner"),
    ).withColumn("classes", sizes.agg(F.count(F.lit(1))).scalar())


_D2 = "sqrt(list_sum(list_transform(list_zip(a.v, {0}.v), lambda z: (z[1] - z[2]) ** 2)))"


@query("g22_triplet_loss", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), t AS (SELECT greatest({_D2.format("p")} - {_D2.format("n")} + 0.35, 0) AS l
 FROM e a JOIN e p ON p.vec_id = a.vec_id + 10 JOIN e n ON n.vec_id = a.vec_id + 1)
 SELECT count(*) AS triplets, {sql6("avg(l)", "mean_loss")}, {sql6("avg(CAST(l > 0 AS DOUBLE))", "active_share")} FROM t""")
def g22(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    side = lambda step, name: e.select((F.col("vec_id") - step).alias("vec_id"), F.col("embedding").alias(name))
    rows = e.select("vec_id", F.col("embedding").alias("a")).join(side(10, "p"), "vec_id").join(side(1, "n"), "vec_id")
    out = X.triplet_loss(rows, "a", "p", "n", 0.35)
    return out.select("triplets", r6("mean_loss"), r6("active_share"))


@query("g22_classification", f"""WITH e AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x * 5) z FROM embeddings), m AS (SELECT label, z, list_max(z) t FROM e),
 c AS (SELECT ln(list_sum(list_transform(z, lambda x: exp(x - t)))) + t - z[label + 1] AS ce, CAST(list_position(z, t) - 1 = label AS DOUBLE) AS hit FROM m)
 SELECT count(*) AS n, {sql6("avg(ce)", "mean_ce")}, {sql6("avg(hit)", "accuracy")} FROM c""")
def g22_class(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").selectExpr("label", "transform(embedding, x -> cast(x as double) * 5) AS z")
    return X.classification_metrics(rows, "z", "label").select("n", r6("mean_ce"), r6("accuracy"))


@query("m03_pca")
def m03(spark, sf) -> DataFrame:
    p = X.pca_2d(cents(spark, sf, "print_id"), "print_id", "centroid")
    return p.select("print_id", r6("pc1"), r6("pc2"))


@query("m03_pca_vectors_moments", """SELECT count(*) AS n, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2, true AS ordered FROM embeddings""")
def m03_moments(spark, sf) -> DataFrame:
    """Projections of all vectors: centred, uncorrelated, first axis widest."""
    p = X.pca_2d(table(spark, sf, "embeddings"), "vec_id", "embedding")
    clean = lambda c: F.abs(F.round(F.avg(c), 6))
    return p.agg(
        F.count(F.lit(1)).alias("n"), clean("pc1").alias("mean1"), clean("pc2").alias("mean2"),
        ((F.var_pop("pc1") >= F.var_pop("pc2")) & (F.abs(F.covar_pop("pc1", "pc2")) < 1e-9)).alias("ordered"),
    )


@query("m04_min_max", f"""WITH e AS (SELECT min(p_retailprice) a, max(p_retailprice) b, min(p_size) c, max(p_size) d FROM part)
 SELECT p_partkey, {sql6("(p_retailprice - a) / greatest(b - a, 1e-9)", "x")}, {sql6("(p_size - c) / greatest(d - c, 1e-9)", "y")} FROM part, e""")
def m04(spark, sf) -> DataFrame:
    points = table(spark, sf, "part").selectExpr("p_partkey", "p_retailprice AS x", "cast(p_size as double) AS y")
    return X.min_max(points, ["x", "y"]).select("p_partkey", r6("x"), r6("y"))


@query("g13_value_histogram", """WITH c AS (SELECT CAST(least(floor(l_discount / 0.1 * 40), 39) AS BIGINT) b, count(*) n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1)
 SELECT r.b AS bin, coalesce(c.n, 0) AS n FROM range(0, 40) r(b) LEFT JOIN c ON c.b = r.b""")
def g13_values(spark, sf) -> DataFrame:
    return X.histogram(table(spark, sf, "lineitem"), "l_discount", 40, 0.0, 0.1).select("bin", "n")


@query("g15_value_boxplot", f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) q2, quantile_cont(o_totalprice, 0.75) q3 FROM orders),
 f AS (SELECT o_totalprice v, q1, q2, q3, o_totalprice BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM orders, q)
 SELECT {sql6("min(q1)", "q1")}, {sql6("min(q2)", "median")}, {sql6("min(q3)", "q3")}, {sql6("min(v) FILTER (inside)", "whisker_low")},
 {sql6("max(v) FILTER (inside)", "whisker_high")}, count(*) FILTER (NOT inside) AS outliers, count(v) AS n FROM f""")
def g15_values(spark, sf) -> DataFrame:
    b = X.box_plot(table(spark, sf, "orders"), "o_totalprice")
    return b.select(*[r6(n) for n in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers", "n")


@query("s09_projector_lines", f"""WITH {V_EMB}, {V_CARDS} SELECT row_number() OVER (ORDER BY emb_id) - 1 AS line,
 array_to_string(list_transform(emb::DOUBLE[], lambda x: printf('%.8f', x)), chr(9)) AS vector_line,
 concat_ws(chr(9), coalesce(name, ''), coalesce(set_code, ''), coalesce(collector_number, ''), CAST(e.print_id AS VARCHAR)) AS metadata_line
 FROM v_emb e LEFT JOIN v_cards k ON k.print_id = e.print_id""")
def s09(spark, sf) -> DataFrame:
    """Both files written in one job, read back and matched line by line."""
    fields = cards(spark, sf).select("print_id", "name", "set_code", "collector_number")
    rows = emb(spark, sf).join(fields, "print_id", "left")
    lines = reports.projector_lines(rows, [F.col("emb_id")])
    folder = scratch_path(spark, "projector")
    reports.write_projector(lines, folder)
    return reports.read_projector(spark, folder).where("line >= 0")
