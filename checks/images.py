"""Image jobs, on 8 x 8 pictures derived from the stored vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from checks import base
from checks.base import ORIGIN_SQL, V_PIXELS, pixel_images, query, r6, sql6, table
from prismcat.functions import pixels as P
from prismcat.operators import images as I
from prismcat.plans import export as E
from prismcat.plans.recognition import photo_vectors, recognise
from prismcat.session import materialise
from prismcat.sources.images import only_images

STATS = ["mean_luminance", "std_luminance", "mean_r", "mean_g", "mean_b", "laplacian_var"]


_LISTING = "'img/' || l_partkey || '_' || l_linenumber || CASE l_partkey % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.png.txt' END AS path"


@query("s04_image_listing", rf"""SELECT path, count(*) AS n FROM (SELECT {_LISTING} FROM lineitem)
 WHERE regexp_matches(lower(path), '\.(jpg|jpeg|png)$') GROUP BY path""")
def s04(spark, sf) -> DataFrame:
    """A listing in which a third of the files are no images."""
    return only_images(table(spark, sf, "lineitem").selectExpr(_LISTING)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("i01_crop", f"""WITH {V_PIXELS}, c AS (SELECT label, vec_id, y, x, printf('%02X%02X%02X', CAST(b * 255 AS INT), CAST(g * 255 AS INT), CAST(r * 255 AS INT)) AS h
 FROM v_px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 4 AND 7) SELECT {ORIGIN_SQL} AS origin, 4 AS height, 4 AS width, string_agg(h, '' ORDER BY y, x) AS data
 FROM c GROUP BY label, vec_id""")
def i01(spark, sf) -> DataFrame:
    box = {"x_min": 0.5, "x_max": 1.0, "y_min": 0.25, "y_max": 0.75}
    out = I.crop_images(pixel_images(spark, sf), box, (4, 4))
    return out.select("origin", "height", "width", F.hex("data").alias("data"))


@query("i01_roi", f"""WITH {V_PIXELS}, c AS (SELECT label, vec_id, y, x, printf('%02X%02X%02X', CAST(b * 255 AS INT), CAST(g * 255 AS INT), CAST(r * 255 AS INT)) AS h
 FROM v_px WHERE y BETWEEN 0 AND 1 AND x = 3) SELECT {ORIGIN_SQL} AS origin, 2 AS height, 1 AS width, string_agg(h, '' ORDER BY y, x) AS data
 FROM c GROUP BY label, vec_id""")
def i01_roi(spark, sf) -> DataFrame:
    out = I.crop_roi(pixel_images(spark, sf), {"x_min": 0.4, "x_max": 0.4, "y_min": 0.0, "y_max": 0.3})
    return out.select("origin", "height", "width", F.hex("data").alias("data"))


@query("i01_letterbox")
def i01_letterbox(spark, sf) -> DataFrame:
    out = I.crop_images(pixel_images(spark, sf), {"y_max": 0.5}, (20, 12))
    return out.select("origin", "height", "width", F.md5("data").alias("digest"))


@query("i02_tensor", f"""WITH {V_PIXELS}, t AS (SELECT label, vec_id, 0 AS c, y, x, (r - 0.485) / 0.229 AS v FROM v_px UNION ALL
 SELECT label, vec_id, 1, y, x, (g - 0.456) / 0.224 FROM v_px UNION ALL SELECT label, vec_id, 2, y, x, (b - 0.406) / 0.225 FROM v_px)
 SELECT {ORIGIN_SQL} AS origin, CAST(c * 64 + y * 8 + x AS INT) AS pos, {sql6("CAST(CAST(v AS FLOAT) AS DOUBLE)", "value")} FROM t""")
def i02(spark, sf) -> DataFrame:
    t = I.image_tensors(pixel_images(spark, sf), (8, 8))
    return t.select("origin", F.posexplode("tensor").alias("pos", "value")).select(
        "origin", "pos", F.round(F.col("value").cast("double"), 6).alias("value")
    )


def stats_ctes(source: str, p: str = "") -> str:
    """Per-image statistics of a pixel table, as CTEs whose names start with ``p``."""
    return f"""{p}l AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS lum FROM {source}),
 {p}lap AS (SELECT c.vec_id, u.lum + d.lum + w.lum + e.lum - 4 * c.lum AS v FROM {p}l c
  JOIN {p}l u ON u.vec_id = c.vec_id AND u.x = c.x AND u.y = c.y - 1 JOIN {p}l d ON d.vec_id = c.vec_id AND d.x = c.x AND d.y = c.y + 1
  JOIN {p}l w ON w.vec_id = c.vec_id AND w.y = c.y AND w.x = c.x - 1 JOIN {p}l e ON e.vec_id = c.vec_id AND e.y = c.y AND e.x = c.x + 1),
 {p}st AS (SELECT label, vec_id, avg(lum) AS mean_luminance, stddev_pop(lum) AS std_luminance, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b FROM {p}l GROUP BY ALL),
 {p}full_st AS (SELECT s.*, v.laplacian_var FROM {p}st s JOIN (SELECT vec_id, var_pop(v) AS laplacian_var FROM {p}lap GROUP BY 1) v USING (vec_id))"""


PIXEL_STATS = f"{V_PIXELS}, {stats_ctes('v_px')}"


@query("i03_image_statistics", f"WITH {PIXEL_STATS} SELECT {ORIGIN_SQL} AS origin, {', '.join(sql6(s, s) for s in STATS)} FROM full_st")
def i03(spark, sf) -> DataFrame:
    return I.image_statistics(pixel_images(spark, sf)).select("origin", *[r6(s) for s in STATS])


@query("i03_domain_statistics", f"WITH {PIXEL_STATS} SELECT label AS domain, count(*) AS images, {', '.join(sql6(f'avg({s})', s) for s in STATS)} FROM full_st GROUP BY label")
def i03_domain(spark, sf) -> DataFrame:
    per_image = I.image_statistics(pixel_images(spark, sf))
    labelled = per_image.withColumn("domain", F.regexp_extract("origin", r"/S(\d+)_", 1).cast("int"))
    return I.domain_statistics(labelled, "domain").select("domain", "images", *[r6(s) for s in STATS])


@query("p22_range_hints", f"""WITH {PIXEL_STATS}, d_px AS (SELECT vec_id, label, y, x, floor(round(b * 255) * 0.5) / 255.0 AS b,
 floor(round(g * 255) * 0.5) / 255.0 AS g, floor(round(r * 255) * 0.5) / 255.0 AS r FROM v_px), {stats_ctes("d_px", "d_")},
 a AS (SELECT avg(mean_luminance) m, avg(std_luminance) s, avg(laplacian_var) v FROM full_st),
 c AS (SELECT avg(mean_luminance) m, avg(std_luminance) s, avg(laplacian_var) v FROM d_full_st)
 SELECT {sql6("greatest(0.4, c.m / greatest(a.m, 1e-6) - c.s)", "brightness_min")}, {sql6("least(1.6, c.m / greatest(a.m, 1e-6) + c.s)", "brightness_max")},
 {sql6("greatest(0.6, c.s / greatest(a.s, 1e-6) * 0.8)", "contrast_min")}, {sql6("least(1.6, c.s / greatest(a.s, 1e-6) * 1.2)", "contrast_max")},
 {sql6("greatest(0.2, 1.0 / (sqrt(c.v + 1e-6) + 1e-6))", "blur_sigma_max")}, {sql6("greatest(0.005, abs(c.m - a.m) / 3)", "noise_std_max")} FROM a, c""")
def p22(spark, sf) -> DataFrame:
    """Reference domain: the pictures; camera domain: the same pictures at half exposure."""
    reference = pixel_images(spark, sf)
    camera = I.effect_images(reference, lambda img, rng: P.exposure(img, 0.5))
    both = [I.domain_statistics(I.image_statistics(d)) for d in (reference, camera)]
    hints = I.range_hints(*both)
    return hints.select(*[r6(c) for c in hints.columns])


@query("i04_augment")
def i04(spark, sf) -> DataFrame:
    out = I.augment_images(pixel_images(spark, sf), 3)
    return out.select("origin", "variant", "height", "width", F.md5("data").alias("digest"))


@query("i04_augment_originals", f"""WITH {V_PIXELS}, c AS (SELECT label, vec_id, string_agg(printf('%02X%02X%02X', CAST(b * 255 AS INT), CAST(g * 255 AS INT), CAST(r * 255 AS INT)), ''
 ORDER BY y, x) AS h FROM v_px GROUP BY ALL) SELECT {ORIGIN_SQL} AS origin, CAST(i AS INT) AS variant, CASE i WHEN 0 THEN h END AS original FROM c, range(0, 4) t(i)""")
def i04_originals(spark, sf) -> DataFrame:
    """Four rows per picture; variant 0 is the untouched picture."""
    out = I.augment_images(pixel_images(spark, sf), 3)
    return out.select("origin", "variant", F.when(F.col("variant") == 0, F.hex("data")).alias("original"))


def _effect_sql(r: str, g: str, b: str, pixels: str = "p AS (SELECT * FROM p0)") -> str:
    """Mean bytes after a per-pixel effect; results are cut to whole bytes."""
    cut = lambda e: f"avg(floor(least(greatest({e}, 0), 255) + 1e-6))"
    return f"""WITH {V_PIXELS}, p0 AS (SELECT label, vec_id, y, x, round(r * 255) AS r, round(g * 255) AS g, round(b * 255) AS b,
 0.299 * round(r * 255) + 0.587 * round(g * 255) + 0.114 * round(b * 255) AS lum FROM v_px), {pixels}
 SELECT {ORIGIN_SQL} AS origin, {sql6(cut(r), "red")}, {sql6(cut(g), "green")}, {sql6(cut(b), "blue")} FROM p GROUP BY label, vec_id"""


def _each(template: str) -> list[str]:
    return [template.replace("#", c) for c in "rgb"]


# weighted sum over the 3 x 3 neighbourhood (centre counts 5), border pixels as they are
_SMOOTH = """p AS (SELECT c.*, CASE WHEN c.y IN (0, 7) OR c.x IN (0, 7) THEN c.r ELSE s.r END AS sr, CASE WHEN c.y IN (0, 7) OR c.x IN (0, 7) THEN c.g ELSE s.g END AS sg,
 CASE WHEN c.y IN (0, 7) OR c.x IN (0, 7) THEN c.b ELSE s.b END AS sb FROM p0 c JOIN (SELECT a.vec_id, a.y, a.x, (sum(n.r) + 4 * any_value(a.r)) / 13 AS r,
 (sum(n.g) + 4 * any_value(a.g)) / 13 AS g, (sum(n.b) + 4 * any_value(a.b)) / 13 AS b FROM p0 a JOIN p0 n ON n.vec_id = a.vec_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1
 GROUP BY a.vec_id, a.y, a.x) s USING (vec_id, y, x))"""
# separable Gaussian, sigma 1, three pixels either way, edge pixels repeated
_BLUR = """k AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM range(-3, 4) t(e)) AS w FROM range(-3, 4) t(d)),
 v AS (SELECT c.label, c.vec_id, c.y, c.x, sum(k.w * n.r) AS r, sum(k.w * n.g) AS g, sum(k.w * n.b) AS b FROM p0 c, k JOIN p0 n ON n.vec_id = c.vec_id AND n.x = c.x
  AND n.y = least(greatest(c.y + k.d, 0), 7) GROUP BY ALL),
 p AS (SELECT c.label, c.vec_id, c.y, c.x, sum(k.w * n.r) AS r, sum(k.w * n.g) AS g, sum(k.w * n.b) AS b FROM v c, k JOIN v n ON n.vec_id = c.vec_id AND n.y = c.y
  AND n.x = least(greatest(c.x + k.d, 0), 7) GROUP BY ALL)"""
# hue turned by 10 of 256 steps at constant value and chroma
_HUE = """h AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM p0), s AS (SELECT *, top - low AS c, CASE WHEN top = low THEN 0.0
 WHEN top = r THEN (g - b) / (top - low) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN top = g THEN (b - r) / (top - low) + 2 ELSE (r - g) / (top - low) + 4 END AS hue FROM h),
 t AS (SELECT *, CASE WHEN hue + 60 / 256.0 >= 6 THEN hue + 60 / 256.0 - 6 ELSE hue + 60 / 256.0 END AS u FROM s), p AS (SELECT * FROM t)"""


def _share(hue: int) -> str:
    away = f"least(abs(u - {hue}), 6 - abs(u - {hue}))"
    return f"low + c * least(greatest(2 - {away}, 0), 1)"


def _effect(spark, sf, effect) -> DataFrame:
    out = I.effect_images(pixel_images(spark, sf), effect)
    per = I.image_statistics(out)
    scaled = {n: F.round(F.col(c) * 255, 6) for n, c in (("red", "mean_r"), ("green", "mean_g"), ("blue", "mean_b"))}
    return per.select("origin", *[e.alias(n) for n, e in scaled.items()])


@query("i04a_exposure", _effect_sql("r * 0.5", "g * 0.5", "b * 0.5"))
def i04a(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.exposure(img, 0.5))


@query("i04b_contrast", _effect_sql(*_each("m + (# - m) * 1.3"), pixels="p AS (SELECT *, floor(avg(lum) OVER (PARTITION BY vec_id) + 0.5 + 1e-6) AS m FROM p0)"))
def i04b(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.contrast(img, 1.3))


@query("i04c_gamma", _effect_sql("255 * sqrt(r / 255)", "255 * sqrt(g / 255)", "255 * sqrt(b / 255)"))
def i04c(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.gamma_curve(img, 2.0))


@query("i04d_saturation", _effect_sql(*_each("lum + (# - lum) * 0.7")))
def i04d(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.saturation(img, 0.7))


@query("i04e_color_temperature", _effect_sql("r * 1.25", "g * 1.1875", "b * 0.875"))
def i04e(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.color_temperature(img, 1.25))


@query("i04f_hue_shift", _effect_sql(_share(0), _share(2), _share(4), _HUE))
def i04f(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.hue_shift(img, 10.0))


@query("i04g_noise")
def i04g(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.noise(img, 0.02, rng))


@query("i04h_sharpness", _effect_sql(*_each("s# + (# - s#) * 1.5"), pixels=_SMOOTH))
def i04h(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.sharpness(img, 1.5))


@query("i04i_blur", _effect_sql("r", "g", "b", _BLUR))
def i04i(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.blur(img, 1.0))


def _sampled(sy: str, sx: str) -> str:
    """Pixels looked up at fractional places between four neighbours; what lies outside is white."""
    return f"""s AS (SELECT label, vec_id, y, x, {sy} AS sy, {sx} AS sx FROM p0),
 n AS (SELECT label, vec_id, y, x, floor(sy) + a AS ny, floor(sx) + b AS nx, (CASE a WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END)
  * (CASE b WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w FROM s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b)),
 p AS (SELECT n.label, n.vec_id, n.y, n.x, sum(w * coalesce(q.r, 255)) AS r, sum(w * coalesce(q.g, 255)) AS g, sum(w * coalesce(q.b, 255)) AS b
  FROM n LEFT JOIN p0 q ON q.label = n.label AND q.vec_id = n.vec_id AND q.y = n.ny AND q.x = n.nx GROUP BY ALL)"""


_TURNED = _sampled("3.5 + (y - 3.5) * cos(radians(5)) + (x - 3.5) * sin(radians(5))", "3.5 + (x - 3.5) * cos(radians(5)) - (y - 3.5) * sin(radians(5))")
_NARROWED = _sampled("y::DOUBLE", "(x - (1 - y / 7.0::DOUBLE)) / greatest(7 - 2 * (1 - y / 7.0::DOUBLE), 1) * 7")


@query("i04j_rotation", _effect_sql("r", "g", "b", _TURNED))
def i04j(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.rotate(img, 5.0, 255.0))


@query("i04k_perspective", _effect_sql("r", "g", "b", _NARROWED))
def i04k(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.trapezoid(img, 1.0, 255.0))


def _hex_sql(where: str = "true") -> str:
    return f"string_agg(printf('%02X%02X%02X', CAST(b * 255 AS INT), CAST(g * 255 AS INT), CAST(r * 255 AS INT)), '' ORDER BY y, x) FILTER ({where})"


def _with_bytes(after: DataFrame, spark, sf) -> DataFrame:
    """(origin, pairs, code): each byte of a changed picture next to the original one, and all its bytes in hex."""
    # a list of byte codes is taken from the hex text once per picture; the join carries the pictures as they are
    level = lambda c: F.transform(F.regexp_extract_all(F.hex(c), F.lit("(..)"), 1), lambda h: F.conv(h, 16, 10).cast("int"))
    before = pixel_images(spark, sf).select("origin", F.col("data").alias("was"))
    both = after.select("origin", "data").join(before, "origin")
    return both.select("origin", F.arrays_zip(level(F.col("was")).alias("old"), level(F.col("data")).alias("new")).alias("pairs"), F.hex("data").alias("code"))


@query("i04g_noise_limits", f"""WITH {V_PIXELS} SELECT {ORIGIN_SQL} AS origin, {_hex_sql()} AS without, true AS near, true AS changed FROM v_px GROUP BY label, vec_id""")
def i04g_limits(spark, sf) -> DataFrame:
    """No deviation leaves every byte; a deviation of 0.02 moves some and none by more than six times as much."""
    quiet = I.effect_images(pixel_images(spark, sf), lambda img, rng: P.noise(img, 0.0, rng)).select("origin", F.hex("data").alias("without"))
    loud = _with_bytes(I.effect_images(pixel_images(spark, sf), lambda img, rng: P.noise(img, 0.02, rng)), spark, sf)
    near = F.forall("pairs", lambda p: F.abs(p["old"] - p["new"]) <= 6 * 0.02 * 255 + 1)
    changed = F.exists("pairs", lambda p: p["old"] != p["new"])
    return quiet.join(loud, "origin").select("origin", "without", near.alias("near"), changed.alias("changed"))


@query("i04l_shadow_limits", f"""WITH {V_PIXELS} SELECT {ORIGIN_SQL} AS origin, {_hex_sql("y >= 6")} AS lower_rows, true AS explained, true AS right_size FROM v_px GROUP BY label, vec_id""")
def i04l_limits(spark, sf) -> DataFrame:
    """Bytes are the old ones or darkened by the fixed share, in 4 to 16 pixels; the lower rows are out of reach."""
    both = _with_bytes(I.effect_images(pixel_images(spark, sf), lambda img, rng: P.shadow(img, rng)), spark, sf)
    dark = lambda p: F.floor(p["old"] * 180 / 255 + 1e-6)
    moved = F.size(F.filter("pairs", lambda p: p["old"] != p["new"]))
    return both.select(
        "origin", F.substring("code", 289, 96).alias("lower_rows"), F.forall("pairs", lambda p: (p["new"] == p["old"]) | (p["new"] == dark(p))).alias("explained"),
        (moved <= 3 * 16).alias("right_size"),
    )


@query("i05_plain_views", f"""WITH {V_PIXELS}, t AS (SELECT label, vec_id, 0 AS c, y, x, (r - 0.485) / 0.229 AS v FROM v_px UNION ALL
 SELECT label, vec_id, 1, y, x, (g - 0.456) / 0.224 FROM v_px UNION ALL SELECT label, vec_id, 2, y, x, (b - 0.406) / 0.225 FROM v_px)
 SELECT {ORIGIN_SQL} AS origin, CAST(c * 64 + y * 8 + x AS INT) AS pos, {sql6("CAST(CAST(v AS FLOAT) AS DOUBLE)", "value")}, true AS in_range FROM t""")
def i05_plain(spark, sf) -> DataFrame:
    """Views with every draw switched off are the normalised pictures; with them on they stay in the range of bytes."""
    plain = I.training_views(pixel_images(spark, sf), {"size": (8, 8)}).select("origin", F.posexplode("tensor").alias("pos", "value"))
    drawn = I.training_views(pixel_images(spark, sf), VIEW).select("origin", F.posexplode("tensor").alias("pos", "drawn"))
    low, high = (F.when(F.col("pos") < 64, a).when(F.col("pos") < 128, b).otherwise(c) for a, b, c in (
        (-0.485 / 0.229, -0.456 / 0.224, -0.406 / 0.225), (0.515 / 0.229, 0.544 / 0.224, 0.594 / 0.225)))
    inside = (F.col("drawn") >= low - 1e-5) & (F.col("drawn") <= high + 1e-5)
    return plain.join(drawn, ["origin", "pos"]).select("origin", "pos", F.round(F.col("value").cast("double"), 6).alias("value"), inside.alias("in_range"))


@query("i04l_shadow")
def i04l(spark, sf) -> DataFrame:
    return _effect(spark, sf, lambda img, rng: P.shadow(img, rng))


VIEW = {"size": (8, 8), "rotation_deg": 2.0, "brightness": (0.8, 1.2), "contrast": (0.85, 1.15), "blur_prob": 0.3, "noise_std": 0.05}


@query("i05_training_views")
def i05(spark, sf) -> DataFrame:
    t = I.training_views(pixel_images(spark, sf), VIEW)
    return t.select("origin", F.size("tensor").alias("n"), F.round(F.col("tensor")[0].cast("double"), 4).alias("first_value"))


def linear_head(rows: int, cols: int):
    """Test model: a fixed linear layer (weights -0.5 .. 0.5), as a user would supply a network."""

    def make():
        i, j = np.mgrid[0:rows, 0:cols]
        weights = ((i * 7 + j * 13) % 11 - 5) / 10.0
        return lambda batch: batch.reshape(len(batch), -1).astype(np.float64) @ weights

    return make


@query("i06_encode", f"""WITH w AS (SELECT j, list(((i * 7 + j * 13) % 11 - 5) / 10.0 ORDER BY i) AS c FROM range(0, 64) a(i), range(0, 8) b(j) GROUP BY j),
 y AS (SELECT vec_id, j, list_dot_product(embedding::DOUBLE[], c::DOUBLE[]) AS v FROM embeddings, w), n AS (SELECT vec_id, sqrt(sum(v * v)) AS len FROM y GROUP BY 1)
 SELECT vec_id, CAST(j AS INT) AS dim, {sql6("v / greatest(len, 1e-12)", "value")} FROM y JOIN n USING (vec_id)""")
def i06(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    out = e.select("vec_id", I.encode(F.col("embedding"), linear_head(64, 8), [64], 64, DoubleType()).alias("v"))
    return out.select("vec_id", F.posexplode("v").alias("dim", "value")).select("vec_id", "dim", r6("value"))


SIZE = (8, 8)


def _export(spark, sf, settings):
    catalogue = base.cards(spark, sf).selectExpr("'P' || print_id AS print_id", "logical_id")
    encoded = materialise(E.encoded_variants(pixel_images(spark, sf), linear_head(192, 16), settings, SIZE), "encoded")
    return E.export_rows(encoded, catalogue, settings)


@query("i07_export_analysis", """WITH c AS (SELECT 'P' || (label * 5 + vec_id % 5) AS print_id, any_value(label) AS label, count(*) AS n FROM embeddings GROUP BY 1)
 SELECT print_id, 'L' || label AS logical_id, 'analysis' AS mode, CAST(i AS INT) AS aug_index, CAST(16 AS INT) AS dim FROM c, range(0, 1000) t(i)
 WHERE i < n * 3 OR i = 999""")
def i07(spark, sf) -> DataFrame:
    """Two augmentations per picture: three rows per picture and one centroid row per print."""
    rows = _export(spark, sf, E.ExportSettings.analysis(num_augmentations=2))
    return rows.select("print_id", "logical_id", "mode", "aug_index", F.size("emb").alias("dim"))


@query("i07_export_runtime", """SELECT DISTINCT 'P' || (label * 5 + vec_id % 5) AS print_id, 'runtime' AS mode, CAST(999 AS INT) AS aug_index FROM embeddings""")
def i07_runtime(spark, sf) -> DataFrame:
    return _export(spark, sf, E.ExportSettings.runtime(num_augmentations=2)).select("print_id", "mode", "aug_index")


@query("i08_photo_recognition", """SELECT count(*) AS searched, count(*) AS scored, 1.0::DOUBLE AS best_score, 1.0::DOUBLE AS worst_score FROM embeddings""")
def i08_photos(spark, sf) -> DataFrame:
    """Every picture searched among all pictures: its best match is an identical one."""
    vectors = photo_vectors(pixel_images(spark, sf), linear_head(192, 16), SIZE)
    summary = recognise(vectors, vectors, k=1, threshold=0.55).summary
    return summary.select("searched", "scored", r6("best_score"), r6("worst_score"))
