"""Cluster quality: metadata sets, flags, ranked reports, report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import base
from checks.base import V_CARDS, V_IMAGES, cards, cents, emb, images, query, r6, sql6
from checks.vectors import nearest_ctes, spread_ctes
from prismcat.operators import features as X
from prismcat.operators import quality as Q
from prismcat.plans.quality_report import META_FIELDS, build_quality
from prismcat.session import scratch_path
from prismcat.sources import reports, store

# Thresholds that split the test vectors; the defaults would flag one side only.
SPREAD, NEAR = 1.40, 1.20


def _load(spark, sf) -> DataFrame:
    fields = [f for f in META_FIELDS if f != "image_path"]
    return Q.load_by_logical(emb(spark, sf), cards(spark, sf), images(spark, sf), "analysis", fields)


def _report(spark, sf, spread=SPREAD, near=NEAR):
    return build_quality(emb(spark, sf), cards(spark, sf), images(spark, sf), "analysis", spread, near)


# The load join with its fan-out over all prints of the logical card, as DISTINCT values per field.
_CARD = [f for f in META_FIELDS if f != "image_path"]
LOAD = f"""{V_CARDS}, {V_IMAGES}, loaded AS (SELECT e.emb_id, e.print_id, coalesce(e.logical_id, k1.logical_id) AS lid,
 coalesce(nullif(coalesce(e.logical_id, k1.logical_id), ''), CAST(e.print_id AS VARCHAR)) AS gid, i.file_path AS image_path,
 {", ".join(f"coalesce(k1.{f}, k2.{f}) AS {f}" for f in _CARD)} FROM v_emb e LEFT JOIN v_cards k1 ON k1.print_id = e.print_id
 LEFT JOIN v_cards k2 ON k2.logical_id = coalesce(e.logical_id, k1.logical_id) LEFT JOIN v_images i ON i.image_id = e.image_id),
 vals AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT gid, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM loaded" for f in META_FIELDS)})
  WHERE value IS NOT NULL AND (value <> '' OR field IN ('mana_cost', 'colors', 'color_identity'))),
 meta AS (SELECT gid, {", ".join(f"min(value) FILTER (field = '{f}') AS {f}, count(*) FILTER (field = '{f}') AS n_{f}" for f in META_FIELDS)}
  FROM vals GROUP BY gid)"""


def quality_ctes(spread: float = SPREAD, near: float = NEAR) -> str:
    nn = nearest_ctes("group_id")
    rest = spread_ctes("group_id")[len(base.v_cent("group_id")):]
    cross = " OR ".join(f"m.{f} IS DISTINCT FROM o.{f}" for f in Q.CROSS_FIELDS)
    inner = " OR ".join(f"m.n_{f} > 1" for f in Q.INTERNAL_FIELDS)
    return f"""{nn}{rest}, {LOAD}, quality AS (SELECT s.g AS group_id, CAST(coalesce(n.neighbour_dist < {near}, false) AS INT) AS suspect_overlap,
 CAST(s.intra_mean_dist > global_mean + 2 * global_std OR s.intra_max_dist > {spread} AS INT) AS suspect_cluster_spread,
 CAST(coalesce({inner}, false) OR (coalesce(n.neighbour_dist < {near}, false) AND ({cross})) AS INT) AS suspect_metadata_conflict,
 n.neighbour AS nearest_neighbor_id, n.neighbour_dist AS nearest_neighbor_dist, s.intra_mean_dist, s.intra_max_dist, global_mean, global_std
 FROM v_spread s CROSS JOIN v_global JOIN v_near n ON n.g = s.g LEFT JOIN meta m ON m.gid = s.g LEFT JOIN meta o ON o.gid = n.neighbour)"""


FLAG_LIST = ", ".join(Q.FLAGS)
DISTANCES = ["nearest_neighbor_dist", "intra_mean_dist", "intra_max_dist"]
SQL_DISTANCES = ", ".join(sql6(d, d) for d in DISTANCES)
ANY = "(suspect_overlap + suspect_cluster_spread + suspect_metadata_conflict > 0)"


@query("j02_logical_load", f"""WITH {base.V_EMB}, {V_CARDS}, {V_IMAGES} SELECT e.emb_id, coalesce(e.logical_id, k.logical_id) AS logical_id,
 k.name, k.mana_cost, i.file_path AS image_path FROM v_emb e LEFT JOIN v_cards k ON k.print_id = e.print_id LEFT JOIN v_images i ON i.image_id = e.image_id""")
def j02(spark, sf) -> DataFrame:
    return _load(spark, sf).select("emb_id", "logical_id", "name", "mana_cost", "image_path")


@query("g04_metadata_values", f"WITH {base.V_EMB}, {LOAD} SELECT gid AS group_id, field, value FROM vals")
def g04_values(spark, sf) -> DataFrame:
    return Q.metadata_values(_load(spark, sf), cards(spark, sf), META_FIELDS)


@query("g04_metadata_summary", f"""WITH {base.V_EMB}, {LOAD} SELECT gid AS group_id, name, n_name, mana_cost, n_mana_cost,
 CAST(cmc AS DOUBLE) AS cmc, n_cmc, colors, n_colors, set_code, n_set_code, lang, n_lang, image_path, n_image_path FROM meta""")
def g04(spark, sf) -> DataFrame:
    meta = Q.metadata_summary(Q.metadata_values(_load(spark, sf), cards(spark, sf), META_FIELDS), META_FIELDS)
    shown = ["name", "mana_cost", "cmc", "colors", "set_code", "lang", "image_path"]
    return meta.select("group_id", *[c for f in shown for c in (f, f"n_{f}")])


@query("g04_catalogue_conflicts", f"""WITH {V_CARDS} SELECT logical_id AS group_id, count(DISTINCT name) > 1 OR count(DISTINCT mana_cost) > 1 AS conflict
 FROM v_cards GROUP BY 1""")
def g04_catalogue(spark, sf) -> DataFrame:
    """Internal conflicts over the whole catalogue: every print as its own member of its logical card."""
    fields = ["name", "mana_cost"]
    loaded = cards(spark, sf).withColumn("group_id", F.col("logical_id"))
    values = Q.metadata_values(loaded, cards(spark, sf), fields)
    meta = Q.metadata_summary(values, fields)
    return meta.select("group_id", Q.internal_conflict(meta, fields).alias("conflict"))


@query("g09_quality_flags", f"WITH {quality_ctes()} SELECT group_id, {FLAG_LIST}, nearest_neighbor_id, {SQL_DISTANCES} FROM quality")
def g09(spark, sf) -> DataFrame:
    return _shown(_report(spark, sf).quality)


def _shown(q: DataFrame) -> DataFrame:
    return q.select("group_id", *Q.FLAGS, "nearest_neighbor_id", *[r6(d) for d in DISTANCES])


@query("g09_quality_flags_by_print", f"""WITH {nearest_ctes("print_id")}{spread_ctes("print_id")[len(base.v_cent("print_id")):]}
 SELECT s.g AS print_id, CAST(n.neighbour_dist < {NEAR} AS INT) AS overlap, CAST(s.intra_mean_dist > global_mean + 2 * global_std OR s.intra_max_dist > {SPREAD} AS INT) AS spread
 FROM v_spread s CROSS JOIN v_global JOIN v_near n ON n.g = s.g""")
def g09_print(spark, sf) -> DataFrame:
    """Spread and overlap flags with prints as clusters (no metadata)."""
    from prismcat.operators.groups import cluster_spread
    from prismcat.operators.search import nearest_neighbour

    c = cents(spark, sf, "print_id")
    spread = cluster_spread(emb(spark, sf), "print_id", "emb_id", c)
    both = spread.join(nearest_neighbour(c, "print_id"), "print_id")
    wide = (F.col("intra_mean_dist") > F.col("global_mean") + 2 * F.col("global_std")) | (F.col("intra_max_dist") > SPREAD)
    return both.select("print_id", (F.col("neighbour_dist") < NEAR).cast("int").alias("overlap"), wide.cast("int").alias("spread"))


@query("g10_metadata_conflict", f"WITH {quality_ctes()} SELECT group_id, suspect_metadata_conflict FROM quality")
def g10(spark, sf) -> DataFrame:
    return _report(spark, sf).quality.select("group_id", "suspect_metadata_conflict")


@query("g11_flag_counts", f"""WITH {quality_ctes()} SELECT count(*) AS cards, {", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in Q.FLAGS)} FROM quality""")
def g11(spark, sf) -> DataFrame:
    return Q.flag_counts(_report(spark, sf).quality)


@query("p19_suspects_only", f"WITH {quality_ctes()} SELECT group_id, {FLAG_LIST} FROM quality WHERE {ANY}")
def p19(spark, sf) -> DataFrame:
    return Q.suspects_only(_report(spark, sf).quality).select("group_id", *Q.FLAGS)


@query("j11_neighbour_enrichment", f"""WITH {quality_ctes()} SELECT q.group_id, m.name, m.image_path, o.name AS neighbor_name, o.image_path AS neighbor_image_path
 FROM quality q LEFT JOIN meta m ON m.gid = q.group_id LEFT JOIN meta o ON o.gid = q.nearest_neighbor_id""")
def j11(spark, sf) -> DataFrame:
    r = _report(spark, sf)
    rich = Q.enrich_neighbours(r.quality, r.meta, ["name", "image_path"])
    return rich.select("group_id", "name", "image_path", "neighbor_name", "neighbor_image_path")


@query("w06_top_spread", f"""WITH {quality_ctes()} SELECT group_id, suspect_cluster_spread, {sql6("intra_mean_dist", "intra_mean_dist")} FROM quality
 ORDER BY suspect_cluster_spread DESC, quality.intra_mean_dist DESC, intra_max_dist DESC, group_id LIMIT 5""")
def w06(spark, sf) -> DataFrame:
    return Q.top_spread(_report(spark, sf).quality, 5).select("group_id", "suspect_cluster_spread", r6("intra_mean_dist"))


@query("w07_top_overlap", f"""WITH {quality_ctes()} SELECT group_id, nearest_neighbor_id, {sql6("nearest_neighbor_dist", "nearest_neighbor_dist")} FROM quality
 ORDER BY quality.nearest_neighbor_dist NULLS LAST, group_id LIMIT 5""")
def w07(spark, sf) -> DataFrame:
    return Q.top_overlap(_report(spark, sf).quality, 5).select("group_id", "nearest_neighbor_id", r6("nearest_neighbor_dist"))


@query("w08_top_conflicts", f"""WITH {quality_ctes()} SELECT group_id, suspect_overlap, {sql6("intra_mean_dist", "intra_mean_dist")} FROM quality
 WHERE suspect_metadata_conflict = 1 ORDER BY suspect_overlap DESC, quality.intra_mean_dist DESC, group_id LIMIT 5""")
def w08(spark, sf) -> DataFrame:
    return Q.top_conflicts(_report(spark, sf).quality, 5).select("group_id", "suspect_overlap", r6("intra_mean_dist"))


@query("w12_report_order", f"""WITH {quality_ctes()} SELECT group_id, row_number() OVER (ORDER BY CAST({ANY} AS INT) DESC, nearest_neighbor_dist NULLS LAST,
 intra_mean_dist DESC, group_id) - 1 AS place FROM quality""")
def w12(spark, sf) -> DataFrame:
    from prismcat.operators.numbering import with_global_index

    return with_global_index(_report(spark, sf).quality, Q.report_order(), "place").select("group_id", "place")


def _fmt(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN '' ELSE replace(printf('%.6f', {expr}), '.', ',') END"


REPORT_SQL = f"""SELECT q.group_id, coalesce(m.name, '') AS name, coalesce(m.set_code, '') AS set_code, coalesce(m.image_path, '') AS image_path,
 coalesce(m.mana_cost, '') AS mana_cost, {_fmt("CAST(m.cmc AS DOUBLE)")} AS cmc, coalesce(m.colors, '[]') AS colors,
 {", ".join(f"CAST(q.{f} AS VARCHAR) AS {f}" for f in Q.FLAGS)}, coalesce(q.nearest_neighbor_id, '') AS nearest_neighbor_id,
 coalesce(o.name, '') AS nearest_neighbor_name, {", ".join(f"{_fmt(f'q.{d}')} AS {d}" for d in DISTANCES)}, {_fmt(f"{SPREAD}::DOUBLE")} AS spread_max_thr,
 {_fmt("q.global_mean")} AS global_intra_mean, {_fmt("q.global_std")} AS global_intra_std, 'analysis' AS mode
 FROM quality q LEFT JOIN meta m ON m.gid = q.group_id LEFT JOIN meta o ON o.gid = q.nearest_neighbor_id"""


@query("s07_csv_report", f"WITH {quality_ctes()} {REPORT_SQL}")
def s07(spark, sf) -> DataFrame:
    """The report as it comes back from the CSV files (delimiter ';', decimal comma)."""
    r = _report(spark, sf)
    rich = Q.enrich_neighbours(r.quality, r.meta, ["name", "set_code", "set_name", "image_path", "mana_cost", "cmc", "colors"])
    path = scratch_path(spark, "report")
    reports.write_csv_report(Q.report_rows(rich, decimal_comma=True), path, ";")
    back = spark.read.option("header", True).option("sep", ";").option("nullValue", "\u0000").csv(path).fillna("")
    return back.drop("set_name", "nearest_neighbor_image_path", "overlap_thr")


@query("s08_json_summary", f"""WITH {quality_ctes()}, t AS (SELECT group_id, row_number() OVER (ORDER BY suspect_cluster_spread DESC, intra_mean_dist DESC, intra_max_dist DESC, group_id) rn FROM quality)
 SELECT 'analysis' AS mode, (SELECT count(*) FROM quality) AS cards, (SELECT CAST(sum(suspect_overlap) AS BIGINT) FROM quality) AS overlaps,
 (SELECT string_agg(group_id, ',' ORDER BY rn) FROM t WHERE rn <= 5) AS spread_ids""")
def s08(spark, sf) -> DataFrame:
    r = _report(spark, sf)
    path = scratch_path(spark, "summary")
    reports.write_json_summary(Q.summary_document(r.quality, r.meta, 5), path)
    back = spark.read.json(path)
    return back.select(
        "mode", F.col("counts.cards").alias("cards"), F.col("counts.flags.suspect_overlap").alias("overlaps"),
        F.array_join(F.col("top.spread.group_id"), ",").alias("spread_ids"),
    )


@query("s10_quality_upsert", f"WITH {quality_ctes(1.30, 1.15)} SELECT group_id, {FLAG_LIST}, nearest_neighbor_id, {SQL_DISTANCES} FROM quality")
def s10(spark, sf) -> DataFrame:
    """Two runs with different thresholds into one table: the second replaces every card of the first."""
    path = scratch_path(spark, "quality-table")
    store.upsert_quality(_report(spark, sf).quality, path)
    return _shown(store.upsert_quality(_report(spark, sf, 1.30, 1.15).quality, path))


@query("s11_quality_scan", f"""WITH {quality_ctes()} SELECT group_id, CASE WHEN suspect_overlap = 1 THEN NULL ELSE 'analysis' END AS mode,
 CASE WHEN suspect_overlap = 1 THEN NULL ELSE {SPREAD}::DOUBLE END AS spread_max FROM quality""")
def s11(spark, sf) -> DataFrame:
    """JSON text parsed on reading; overlapping cards got broken text and come back empty."""
    q = _report(spark, sf).quality
    text = F.when(F.col("suspect_overlap") == 1, F.lit("{broken")).otherwise(F.to_json("meta_info"))
    back = store.read_quality(q.withColumn("meta_info", text), "meta_info", q.schema["meta_info"].dataType)
    return back.select("group_id", F.col("meta_info.thresholds.mode").alias("mode"), F.col("meta_info.thresholds.spread_max").alias("spread_max"))


@query("m05_scatter_table")
def m05(spark, sf) -> DataFrame:
    r = _report(spark, sf)
    out = X.scatter_table(r.centroids, "group_id", "centroid", r.meta, r.quality)
    return out.withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("m05_scatter_classes", f"""WITH {quality_ctes()} SELECT q.group_id, coalesce(nullif(m.name, ''), q.group_id) AS name, coalesce(m.set_code, '') AS set_code,
 CASE WHEN suspect_overlap = 1 THEN 'overlap' WHEN suspect_cluster_spread = 1 THEN 'spread' WHEN suspect_metadata_conflict = 1 THEN 'meta' ELSE 'normal' END AS drawn_class,
 true AS inside FROM quality q LEFT JOIN meta m ON m.gid = q.group_id""")
def m05_classes(spark, sf) -> DataFrame:
    """The points' names and drawn classes; coordinates must lie in the unit square."""
    r = _report(spark, sf)
    out = X.scatter_table(r.centroids, "group_id", "centroid", r.meta, r.quality)
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    return out.select("group_id", "name", "set_code", "drawn_class", inside.alias("inside"))
