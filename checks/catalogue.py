"""Catalogue operators: scans, scalar functions, lookups, upserts, inventory, matching, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import base
from checks.base import V_CARDS, V_EMB, V_IMAGES, cards, emb, images, query, table
from prismcat import schemas
from prismcat.functions import columns as C
from prismcat.operators import audit as A
from prismcat.operators import catalogue as K
from prismcat.operators import features as X
from prismcat.operators import groups as G
from prismcat.operators import match as M
from prismcat.session import materialise, scratch_path
from prismcat.sources import files

# Raw card records built from ``part``, in the bulk schema.
_RAW = """CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'L' || CAST(floor(p_partkey / 5) AS BIGINT) END AS oracle_id,
 p_name AS name, p_brand AS set, 'Set ' || p_brand AS set_name, CAST(p_partkey % 300 AS STRING) AS collector_number,
 CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang, p_type AS type_line, p_name || ' text' AS oracle_text,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'M' || (p_partkey % 3) END AS mana_cost, CAST(p_size AS DOUBLE) AS cmc, 'common' AS rarity,
 array(substr(p_type, 1, 1)) AS colors, array(substr(p_type, 1, 1), 'X') AS color_identity,
 CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN map('large', '', 'normal', 'n/' || p_partkey)
  WHEN p_partkey % 4 = 2 THEN map('small', 's/' || p_partkey) ELSE map('border_crop', 'b/' || p_partkey, 'large', 'l/' || p_partkey) END AS image_uris,
 map('standard', 'legal') AS legalities, map('usd', CAST(p_size AS STRING) || '.25', 'eur', '', 'tix', 'abc') AS prices,
 CASE WHEN p_partkey % 8 < 6 THEN array(named_struct('image_uris', map('normal', 'f/' || p_partkey))) END AS card_faces"""


def raw_cards(spark, sf) -> DataFrame:
    """The same records, typed like the bulk schema (no file in between)."""
    text = table(spark, sf, "part").selectExpr(*base._columns(_RAW)).select(F.to_json(F.struct("*")).alias("j"))
    return text.select(F.from_json("j", schemas.CARD_RAW).alias("c")).select("c.*")


FLAT_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS print_id, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'L' || CAST(floor(p_partkey / 5) AS BIGINT) END AS logical_id,
 p_name AS name, p_brand AS set_code, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'M' || (p_partkey % 3) END AS mana_cost,
 CAST(p_size AS DOUBLE) AS cmc, p_size + 0.25::DOUBLE AS price_usd, CAST(NULL AS DOUBLE) AS price_eur, CAST(NULL AS DOUBLE) AS price_tix FROM part"""
FLAT_COLUMNS = ["print_id", "logical_id", "name", "set_code", "mana_cost", "cmc", "price_usd", "price_eur", "price_tix"]


@query("p01_flatten_cards", FLAT_SQL)
def p01(spark, sf) -> DataFrame:
    return K.flatten_cards(raw_cards(spark, sf)).select(*FLAT_COLUMNS)


def _dump_lines(spark, sf) -> str:
    path = scratch_path(spark, "bulk")
    table(spark, sf, "part").selectExpr(*base._columns(_RAW)).write.json(path)
    return path


@query("s01_bulk_json_lines", FLAT_SQL)
def s01(spark, sf) -> DataFrame:
    raw = files.read_cards(spark, _dump_lines(spark, sf), "lines")
    return K.flatten_cards(raw).select(*FLAT_COLUMNS)


@query("s01_bulk_json_array_lines", FLAT_SQL)
def s01_array(spark, sf) -> DataFrame:
    """An array with one object per line, read as splittable text."""
    path = scratch_path(spark, "bulk-array")
    text = table(spark, sf, "part").selectExpr(*base._columns(_RAW)).select(F.to_json(F.struct("*")).alias("j"))
    text.select(F.concat("j", F.lit(",")).alias("value")).write.text(path)
    return K.flatten_cards(files.read_cards(spark, path, "array_lines")).select(*FLAT_COLUMNS)


@query("s01_bulk_json_array", FLAT_SQL)
def s01_one_array(spark, sf) -> DataFrame:
    """One array in one file, read in splits of 64 kB."""
    path = scratch_path(spark, "bulk-one-array")
    text = table(spark, sf, "part").selectExpr(*base._columns(_RAW)).select(F.concat(F.to_json(F.struct("*")), F.lit(", ")).alias("value"))
    text = materialise(text, "bulk-records")  # by all tasks; the one that writes the file only copies them
    last = spark.createDataFrame([("[",), ("null]",)], "value string")
    lines = last.where("value = '['").withColumn("n", F.lit(0)).unionByName(text.withColumn("n", F.lit(1))).unionByName(last.where("value <> '['").withColumn("n", F.lit(2)))
    lines.coalesce(1).sortWithinPartitions("n").select("value").write.option("lineSep", " ").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    try:  # the elements are written before the reader returns
        raw = files.read_cards(spark, path, "array")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return K.flatten_cards(raw.where("id IS NOT NULL")).select(*FLAT_COLUMNS)


@query("u01_upsert_buckets", """SELECT p_partkey AS print_id, CASE WHEN p_partkey % 50 = 7 THEN 'new ' || p_name ELSE p_name END AS name,
 CASE WHEN p_partkey % 50 = 7 THEN 'late' END AS note FROM part UNION ALL SELECT -1, 'added', 'late'""")
def u01_buckets(spark, sf) -> DataFrame:
    """Two batches into a keyed table; the second changes some rows, adds one and a column."""
    from prismcat.sources.keyed import read_keyed, upsert_keyed

    path = scratch_path(spark, "keyed")
    part = table(spark, sf, "part").selectExpr("p_partkey AS print_id", "p_name AS name")
    upsert_keyed(part, path, ["print_id"], [F.col("name")])
    late = part.where("print_id % 50 = 7").selectExpr("print_id", "'new ' || name AS name", "'late' AS note")
    upsert_keyed(late.unionByName(spark.createDataFrame([(-1, "added", "late")], late.schema)), path, ["print_id"], [F.col("name")])
    return read_keyed(spark, path).select("print_id", "name", "note")


@query("s02_latest_snapshot", """WITH n AS (SELECT page_id, 'dump' || (page_id % 5) || '_cards-' || CAST(20240000 + page_id AS VARCHAR) || '.json' AS f FROM pages)
 SELECT split_part(f, '-', 1) AS type, max(f) AS file_name, 'bulk/' || max(f) AS path FROM n GROUP BY 1""")
def s02(spark, sf) -> DataFrame:
    name = "concat('bulk/dump', page_id % 5, '_cards-', cast(20240000 + page_id as string), '.json') AS path"
    return files.latest_snapshots(table(spark, sf, "pages").selectExpr(name))


@query("s03_inventory_csv", """SELECT CAST(p_partkey AS VARCHAR) AS print_id, nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || ', "x"' END), '') AS name,
 lower(p_brand) AS set_code FROM part""")
def s03(spark, sf) -> DataFrame:
    path = scratch_path(spark, "inventory")
    rows = table(spark, sf, "part").selectExpr(
        "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || ', \"x\"' END AS `Name`", "' ' || p_brand AS `Set code`",
        "p_partkey AS `Print ID`", "p_size AS `Quantity`",
    )
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.inventory_rows(files.read_inventory(spark, path)).select("print_id", "name", "set_code")


# --- scalar functions ---------------------------------------------------------------------------

_NUMBERS = """CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN ' 1.5 '
 WHEN 4 THEN '1.5d' WHEN 5 THEN '-' || CAST(event_id AS VARCHAR(20)) ELSE CAST(event_id AS VARCHAR(20)) || '.125' END AS x"""


@query("p02_safe_number", f"SELECT event_id, TRY_CAST(trim(x) AS DOUBLE) AS x FROM (SELECT event_id, {_NUMBERS} FROM events)")
def p02(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id", _NUMBERS).select("event_id", C.to_number(F.col("x")).alias("x"))


@query("p03_json_encode", """SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || ',"tags":["' || p_brand || '"]}' AS j FROM part""")
def p03(spark, sf) -> DataFrame:
    doc = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand").alias("tags"))
    return table(spark, sf, "part").select("p_partkey", C.json_text(doc).alias("j"))


_PROPS = "CASE WHEN event_id % 5 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 5 = 1 THEN NULL ELSE props END AS p"


@query("p04_json_decode", f"""SELECT event_id, CAST(CASE WHEN json_valid(p) THEN json_extract(p, '$.k') END AS INT) AS k,
 CAST(CASE WHEN json_valid(p) THEN 1 ELSE 0 END AS INT) AS n FROM (SELECT event_id, {_PROPS} FROM events)""")
def p04(spark, sf) -> DataFrame:
    empty = F.create_map().cast("map<string,int>")
    parsed = C.json_or_default(F.col("p"), "map<string,int>", empty)
    rows = table(spark, sf, "events").selectExpr("event_id", _PROPS).withColumn("m", parsed)
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n"))


@query("p05_first_truthy", """SELECT event_id, coalesce(nullif(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END, ''),
 nullif(CASE event_id % 2 WHEN 0 THEN '' ELSE props END, ''), 'none') AS v FROM events""")
def p05(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS a",
        "CASE event_id % 2 WHEN 0 THEN '' ELSE props END AS b",
    )
    return e.select("event_id", C.first_truthy(F.col("a"), F.col("b"), F.lit("none")).alias("v"))


URI_SQL = """CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 < 6 THEN 'f/' || p_partkey END WHEN p_partkey % 4 = 1 THEN 'n/' || p_partkey
 WHEN p_partkey % 4 = 2 THEN NULL ELSE 'l/' || p_partkey END"""


@query("p06_image_uri", f"SELECT CAST(p_partkey AS VARCHAR) AS id, {URI_SQL} AS uri FROM part")
def p06(spark, sf) -> DataFrame:
    return raw_cards(spark, sf).select("id", C.image_uri(F.col("image_uris"), F.col("card_faces")).alias("uri"))


NAME_SQL = """upper(set_code) || '_' || CASE WHEN print_id % 10 = 0 THEN replace(collector_number || '/7', '/', '-')
 WHEN print_id % 10 = 1 THEN '0' ELSE collector_number END || '_' || lang || '_' || print_id || '.jpg'"""


def _file_names(spark, sf) -> DataFrame:
    number = F.expr("CASE print_id % 10 WHEN 0 THEN collector_number || '/7' WHEN 1 THEN '' ELSE collector_number END")
    name = C.canonical_file_name(F.col("set_code"), number, F.col("lang"), F.col("print_id").cast("string"))
    return cards(spark, sf).select("print_id", name.alias("file_name"))


@query("p07_file_name", f"WITH {V_CARDS} SELECT print_id, {NAME_SQL} AS file_name FROM v_cards")
def p07(spark, sf) -> DataFrame:
    return _file_names(spark, sf)


@query("p08_parse_file_name", f"""WITH {V_CARDS}, f AS (SELECT print_id, string_split(replace({NAME_SQL}, '.jpg', ''), '_') AS p FROM v_cards)
 SELECT print_id, p[4] AS parsed_id, p[1] AS set_code, p[2] AS collector_number, p[3] AS name FROM f""")
def p08(spark, sf) -> DataFrame:
    parsed = _file_names(spark, sf).select("print_id", C.parse_file_name(F.col("file_name")).alias("p"))
    return parsed.select("print_id", F.col("p.print_id").alias("parsed_id"), "p.set_code", "p.collector_number", "p.name")


@query("p09_language_from_name", f"WITH {V_CARDS} SELECT print_id, lower(lang) AS language FROM v_cards")
def p09(spark, sf) -> DataFrame:
    return _file_names(spark, sf).select("print_id", C.language_from_file_name(F.col("file_name")).alias("language"))


@query("p10_relative_path", r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '\', '/') ELSE 'other/' || url END AS path FROM pages""")
def p10(spark, sf) -> DataFrame:
    windows = table(spark, sf, "pages").selectExpr(
        "page_id", r"CASE WHEN page_id % 2 = 0 THEN '/srv/app/' || url ELSE 'other/' || url END AS u"
    )
    return windows.select("page_id", C.relative_path(F.translate("u", "/", "\\"), "/srv/app").alias("path"))


@query("p11_normal_name", """SELECT s_suppkey AS id, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS name FROM supplier
 UNION ALL SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') FROM part""")
def p11(spark, sf) -> DataFrame:
    both = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name").unionByName(
        table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name")
    )
    return both.select("id", C.normal_name(F.col("name")).alias("name"))


@query("p12_tsv_text", """SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id,
 trim(translate(coalesce(text, ''), chr(9) || chr(10), '  '), ' ') AS t FROM documents)""")
def p12(spark, sf) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", C.tsv_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("bigint").alias("n"))


@query("p13_alias_columns", """SELECT p_partkey AS row_id, nullif(trim(p_name), '') AS name, lower(p_brand) AS set_code FROM part""")
def p13(spark, sf) -> DataFrame:
    odd = table(spark, sf, "part").selectExpr("p_partkey AS row_id", "p_name AS `Card Name`", "p_brand AS `SetCode`")
    return files.inventory_rows(odd).select("row_id", "name", "set_code")


@query("p14_importable", f"""SELECT CAST(p_partkey AS VARCHAR) AS id, {URI_SQL} AS image_uri FROM part WHERE p_partkey % 3 IN (0, 1) AND ({URI_SQL}) IS NOT NULL""")
def p14(spark, sf) -> DataFrame:
    return K.importable(raw_cards(spark, sf), C.PRINT_LANGUAGES).select("id", "image_uri")


@query("p14_variant_order", """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'f/' || p_partkey
 WHEN p_partkey % 4 = 1 THEN 'n/' || p_partkey WHEN p_partkey % 4 = 2 THEN 's/' || p_partkey ELSE 'b/' || p_partkey END AS image_uri FROM part""")
def p14_variants(spark, sf) -> DataFrame:
    """Any language, other variants first."""
    return K.importable(raw_cards(spark, sf), [], ["small", "border_crop", "normal"]).select("id", "image_uri")


@query("p14_language_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def p14_language(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.where(C.language_allowed(F.col("lang"), C.PRINT_LANGUAGES))


@query("p20_asset_key", r"""WITH b AS (SELECT page_id, url, regexp_extract(url, '([^/\\]*)$', 1) AS n FROM pages),
 s AS (SELECT *, CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN regexp_replace(n, '\.[^.]*$', '') ELSE n END AS stem,
 CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN lower(regexp_extract(n, '(\.[^.]*)$', 1)) ELSE '' END AS ext FROM b)
 SELECT page_id, substr(stem, 1, 40) || '_' || substr(md5(url), 1, 12) || CASE WHEN ext IN ('.jpg', '.jpeg', '.png') THEN ext ELSE '.jpg' END AS asset FROM s""")
def p20(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.asset_key(F.col("url")).alias("asset"))


@query("p21_decimal_format", """SELECT l_orderkey, l_linenumber, printf('%.6f', l_extendedprice / 8) AS dot, replace(printf('%.6f', l_tax), '.', ',') AS comma,
 CASE WHEN l_discount = 0 THEN '' ELSE printf('%.8f', 0.5 / l_discount) END AS ratio FROM lineitem""")
def p21(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.fixed_decimals(F.col("l_extendedprice") / 8).alias("dot"),
        C.fixed_decimals(F.col("l_tax"), 6, comma=True).alias("comma"),
        C.fixed_decimals(F.try_divide(F.lit(0.5), F.col("l_discount")), 8).alias("ratio"),
    )


# --- lookups ------------------------------------------------------------------------------------

_OWN = "CASE print_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'own/' || print_id END"


@query("j03_missing_image_fallback", f"""WITH {V_CARDS}, {V_IMAGES}, b AS (SELECT print_id, min(file_path) p, arg_min(language, file_path) l FROM v_images GROUP BY 1),
 c AS (SELECT print_id, {_OWN} AS own, CASE WHEN print_id % 2 = 0 THEN '' ELSE lang END AS lang FROM v_cards)
 SELECT c.print_id, CASE WHEN coalesce(own, '') = '' THEN b.p ELSE own END AS image_path,
 CASE WHEN coalesce(own, '') = '' THEN coalesce(nullif(lang, ''), nullif(b.l, '')) ELSE lang END AS image_language FROM c LEFT JOIN b USING (print_id)""")
def j03(spark, sf) -> DataFrame:
    some = cards(spark, sf).selectExpr(
        "print_id", f"{_OWN} AS image_path", "CASE WHEN print_id % 2 = 0 THEN '' ELSE lang END AS image_language"
    )
    return K.fill_missing_images(some, images(spark, sf), "image_path", "image_language")


@query("j04_logical_id_backfill", f"""WITH {V_EMB}, {V_CARDS} SELECT e.emb_id, coalesce(nullif(e.logical_id, ''),
 nullif(CASE WHEN k.print_id % 3 = 0 THEN NULL ELSE k.logical_id END, ''), CAST(e.print_id AS VARCHAR)) AS logical_id
 FROM v_emb e LEFT JOIN v_cards k ON k.print_id = e.print_id""")
def j04(spark, sf) -> DataFrame:
    known = cards(spark, sf).selectExpr("print_id", "CASE WHEN print_id % 3 = 0 THEN NULL ELSE logical_id END AS logical_id")
    rows = emb(spark, sf).select("emb_id", "print_id", "logical_id")
    return K.backfill_logical_id(rows, known, "emb_id").select("emb_id", "logical_id")


@query("j05_orphan_purge", """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS kept FROM documents""")
def j05(spark, sf) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    kept, gone = K.with_children(docs, labels, "doc_id"), K.without_children(docs, labels, "doc_id")
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query("j06_worklist", """SELECT 'in/doc_' || doc_id || '.jpg' AS input FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j06(spark, sf) -> DataFrame:
    inputs = table(spark, sf, "documents").selectExpr("'in/doc_' || doc_id || '.jpg' AS input")
    outputs = table(spark, sf, "labels").selectExpr("'out/doc_' || doc_id || '.png' AS output")
    todo = K.without_children(
        inputs.withColumn("stem", C.file_stem(F.col("input"))), outputs.select(C.file_stem(F.col("output")).alias("stem")), "stem"
    )
    return todo.select("input")


# Inventory requests: one per order, each with one of the four kinds of key (or none).
_INVENTORY = """o_orderkey AS row_id, CASE WHEN o_orderkey % 6 = 0 THEN o_custkey END AS print_id,
 CASE WHEN o_orderkey % 6 = 1 THEN 'L' || CAST(CAST(floor(o_custkey / 5) AS BIGINT) AS VARCHAR(20)) END AS logical_id,
 CASE WHEN o_orderkey % 6 IN (2, 3, 4) THEN 'N' || CAST(CAST(floor(o_custkey / 5) AS BIGINT) AS VARCHAR(20)) END AS name,
 CASE WHEN o_orderkey % 6 = 2 THEN 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR(20)) END AS set_code"""
INVENTORY_SQL = f"""{V_CARDS}, inv AS (SELECT {_INVENTORY} FROM orders),
 t AS (SELECT *, CAST(CASE WHEN print_id IS NOT NULL THEN 1 WHEN logical_id IS NOT NULL THEN 2 WHEN name IS NOT NULL AND set_code IS NOT NULL THEN 3
  WHEN name IS NOT NULL THEN 4 END AS INT) AS tier FROM inv),
 pick AS (SELECT t.row_id, t.tier, k.print_id, k.logical_id, row_number() OVER (PARTITION BY t.row_id ORDER BY k.price, k.print_id) rn FROM t JOIN v_cards k ON
  (t.tier = 1 AND k.print_id = t.print_id) OR (t.tier = 2 AND k.logical_id = t.logical_id) OR (t.tier = 3 AND k.name = t.name AND k.set_code = t.set_code)
  OR (t.tier = 4 AND k.name = t.name)),
 resolved AS (SELECT t.row_id, t.tier, p.print_id AS resolved_print_id, p.logical_id AS resolved_logical_id FROM t LEFT JOIN pick p ON p.row_id = t.row_id AND p.rn = 1)"""
PRINTS_SQL = INVENTORY_SQL + """, req AS (SELECT resolved_logical_id AS logical_id, min(row_id) AS row_id FROM resolved WHERE resolved_logical_id IS NOT NULL GROUP BY 1),
 prints AS (SELECT k.print_id, k.lang, req.row_id FROM v_cards k JOIN req USING (logical_id) WHERE k.lang IN ('en', 'de') AND k.image_uri IS NOT NULL)"""


def _resolved(spark, sf) -> DataFrame:
    inventory = table(spark, sf, "orders").selectExpr(*base._columns(_INVENTORY))
    return K.resolve_inventory(inventory, cards(spark, sf), [F.col("price")])


def _prints(spark, sf, resolved) -> DataFrame:
    return K.expand_prints(resolved, cards(spark, sf), F.col("image_uri").isNotNull())


@query("j07_inventory_resolve", f"WITH {INVENTORY_SQL} SELECT * FROM resolved")
def j07(spark, sf) -> DataFrame:
    return _resolved(spark, sf).select("row_id", "tier", "resolved_print_id", "resolved_logical_id")


@query("j08_expand_prints", f"WITH {PRINTS_SQL} SELECT print_id, lang, row_id FROM prints")
def j08(spark, sf) -> DataFrame:
    return _prints(spark, sf, _resolved(spark, sf)).select("print_id", "lang", "row_id")


@query("g23_prints_per_row", f"""WITH {PRINTS_SQL}, k AS (SELECT row_id, count(*) n FROM prints GROUP BY 1)
 SELECT r.row_id, coalesce(k.n, 0) AS kept FROM resolved r LEFT JOIN k USING (row_id) WHERE r.resolved_print_id IS NOT NULL""")
def g23(spark, sf) -> DataFrame:
    resolved = _resolved(spark, sf)
    return K.prints_per_row(resolved, _prints(spark, sf, resolved))


@query("g23_import_totals", f"""WITH {PRINTS_SQL} SELECT (SELECT count(*) FROM resolved WHERE resolved_print_id IS NOT NULL) AS cards_resolved,
 (SELECT count(*) FROM prints) AS prints_kept""")
def g23_totals(spark, sf) -> DataFrame:
    resolved = _resolved(spark, sf)
    return K.import_totals(K.prints_per_row(resolved, _prints(spark, sf, resolved)))


# --- dedup and upsert -----------------------------------------------------------------------------


@query("w04_keep_first", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
 ORDER BY ts, event_id) rn FROM events) WHERE rn = 1""")
def w04(spark, sf) -> DataFrame:
    first = G.first_rows(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return first.select("user_id", "event_type", "event_id", "value")


UPSERT_SQL = """tgt AS (SELECT c_custkey AS user_id, 'view' AS event_type, c_acctbal AS value FROM customer),
 src AS (SELECT user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1)"""


def _upsert_inputs(spark, sf):
    target = table(spark, sf, "customer").selectExpr("c_custkey AS user_id", "'view' AS event_type", "c_acctbal AS value")
    return target, table(spark, sf, "events")


@query("u01_upsert", f"""WITH {UPSERT_SQL} SELECT user_id, event_type, value, props FROM src UNION ALL
 SELECT t.user_id, t.event_type, t.value, NULL FROM tgt t ANTI JOIN src s ON s.user_id = t.user_id AND s.event_type = t.event_type""")
def u01(spark, sf) -> DataFrame:
    target, events = _upsert_inputs(spark, sf)
    merged = K.upsert(target, events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return merged.select("user_id", "event_type", "value", "props")


@query("g19_load_statistics", f"""WITH {UPSERT_SQL}, n AS (SELECT count(*) b FROM tgt), o AS (SELECT count(*) s, count(t.user_id) u FROM src s
 LEFT JOIN tgt t ON t.user_id = s.user_id AND t.event_type = s.event_type)
 SELECT b AS rows_before, b + s - u AS rows_after, s - u AS rows_new, u AS rows_updated, CAST(0 AS BIGINT) AS errors FROM n, o""")
def g19(spark, sf) -> DataFrame:
    target, events = _upsert_inputs(spark, sf)
    return K.load_statistics(target, events, ["user_id", "event_type"])


@query("g19_ingest_errors", f"""SELECT CAST(0 AS BIGINT) AS rows_before, count(*) FILTER (WHERE ok) AS rows_after, count(*) FILTER (WHERE ok) AS rows_new,
 CAST(0 AS BIGINT) AS rows_updated, count(*) FILTER (WHERE p_partkey % 7 < 2) AS errors
 FROM (SELECT *, p_partkey % 7 > 1 AND p_partkey % 3 IN (0, 1) AND ({URI_SQL}) IS NOT NULL AS ok FROM part)""")
def g19_errors(spark, sf) -> DataFrame:
    """A dump with unreadable lines and records without an id, in any language."""
    from prismcat.plans.ingest import ingest

    path = scratch_path(spark, "bulk-errors")
    record = F.to_json(F.struct("*"))
    rows = table(spark, sf, "part").selectExpr(*base._columns(_RAW)).withColumn("n", F.col("id").cast("long") % 7)
    rows = rows.withColumn("id", F.when(F.col("n") != 1, F.col("id")))
    rows.select(F.when(F.col("n") == 0, F.lit("no object")).otherwise(record).alias("value")).write.text(path)
    empty = lambda s: spark.createDataFrame([], s)
    raw = files.read_cards(spark, path, "array_lines")
    return ingest(raw, empty(schemas.CARDS), empty(schemas.IMAGES), [F.col("name")], "bulk", C.PRINT_LANGUAGES).statistics


@query("u01_last_record_of_a_file", """SELECT CAST(p_partkey AS VARCHAR) AS print_id, p_name || ' 2' AS name FROM part""")
def u01_file_order(spark, sf) -> DataFrame:
    """Two records of every card in one file: the later one wins."""
    from prismcat.sources.keyed import read_keyed
    from prismcat.streaming.catalogue_stream import card_stream, fold_into_catalogue

    folder, target = scratch_path(spark, "twice"), scratch_path(spark, "stream-table")
    both = table(spark, sf, "part").selectExpr(
        "p_partkey", "explode(array(' 1', ' 2')) AS n", "p_name", "map('large', 'u') AS image_uris"
    ).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey", "n")
    both.selectExpr("CAST(p_partkey AS STRING) AS id", "p_name || n AS name", "image_uris").write.json(folder)
    fold_into_catalogue(card_stream(spark, folder), target, scratch_path(spark, "stream-progress"), []).awaitTermination()
    return read_keyed(spark, target).select("print_id", "name")


@query("u02_schema_evolution", """SELECT CAST(c_custkey AS VARCHAR) AS print_id, c_name AS name, CAST(NULL AS DOUBLE) AS cmc, CAST(NULL AS VARCHAR) AS lang, c_acctbal FROM customer""")
def u02(spark, sf) -> DataFrame:
    old = table(spark, sf, "customer").selectExpr("c_custkey AS print_id", "c_name AS name", "c_acctbal")
    return schemas.evolve(old, schemas.CARDS).select("print_id", "name", "cmc", "lang", "c_acctbal")


@query("so1_merge_listings", f"""WITH {V_IMAGES}, {V_EMB} SELECT print_id, count(*) AS n FROM (SELECT print_id, file_path FROM v_images UNION ALL
 SELECT print_id, 'cam/' || emb_id || '.png' FROM v_emb) GROUP BY print_id""")
def so1(spark, sf) -> DataFrame:
    return _listing(spark, sf).groupBy("print_id").agg(F.count(F.lit(1)).alias("n"))


def _listing(spark, sf) -> DataFrame:
    catalogue = images(spark, sf).select("print_id", F.col("file_path").alias("path"))
    camera = emb(spark, sf).selectExpr("print_id", "'cam/' || emb_id || '.png' AS path")
    return X.merge_listings(catalogue, camera)


@query("g20_images_per_class", f"""WITH {V_IMAGES}, {V_EMB}, l AS (SELECT print_id, file_path AS path FROM v_images UNION ALL
 SELECT print_id, 'cam/' || emb_id || '.png' FROM v_emb) SELECT print_id, count(*) AS n_images, min(path) AS first_path FROM l GROUP BY print_id""")
def g20(spark, sf) -> DataFrame:
    return X.images_per_class(_listing(spark, sf))


@query("w05_class_index", "SELECT k AS print_id, row_number() OVER (ORDER BY k) - 1 AS class_idx FROM (SELECT DISTINCT l_partkey AS k FROM lineitem)")
def w05(spark, sf) -> DataFrame:
    return X.class_index(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("print_id")), "print_id")


@query("w13_first_ids", f"WITH {V_CARDS} SELECT print_id, name FROM v_cards ORDER BY print_id LIMIT 50")
def w13(spark, sf) -> DataFrame:
    return cards(spark, sf).select("print_id", "name").orderBy("print_id").limit(50)


@query("w13_gallery", f"""WITH {V_IMAGES} SELECT print_id, file_path, CAST(rn AS INT) AS place FROM (SELECT print_id, file_path,
 row_number() OVER (PARTITION BY print_id ORDER BY file_path) rn FROM v_images) WHERE rn <= 3""")
def w13_gallery(spark, sf) -> DataFrame:
    return X.first_paths(images(spark, sf), "print_id", "file_path", 3)


# --- matching and audit -----------------------------------------------------------------------------


@query("j12_audit", f"""WITH {V_CARDS}, {V_IMAGES}, {V_EMB}
 SELECT 'image_without_card' AS rule, (SELECT count(*) FROM v_images i ANTI JOIN v_cards k USING (print_id)) AS violations
 UNION ALL SELECT 'embedding_without_card', (SELECT count(*) FROM v_emb e ANTI JOIN v_cards k USING (print_id))
 UNION ALL SELECT 'embedding_without_image', (SELECT count(*) FROM v_emb e ANTI JOIN v_images i USING (image_id))
 UNION ALL SELECT 'file_name_not_ending_with_print_id', (SELECT count(*) FROM v_images WHERE NOT suffix(file_path, '_' || print_id || '.jpg'))
 UNION ALL SELECT 'embedding_without_logical_id', (SELECT count(*) FROM v_emb WHERE coalesce(logical_id, '') = '')
 UNION ALL SELECT 'embedding_of_other_model', (SELECT count(*) FROM v_emb WHERE 'm' || (print_id % 3) <> 'm1')
 UNION ALL SELECT 'document_without_label', (SELECT count(*) FROM documents d ANTI JOIN labels l USING (doc_id))
 UNION ALL SELECT 'line_without_supplier_customer', (SELECT count(*) FROM lineitem l ANTI JOIN customer c ON c.c_custkey = l.l_partkey)""")
def j12(spark, sf) -> DataFrame:
    vectors = emb(spark, sf).withColumn("model_id", F.expr("'m' || (print_id % 3)"))
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lines, customers = table(spark, sf, "lineitem"), table(spark, sf, "customer")
    return A.audit(
        A.store_audit(cards(spark, sf), images(spark, sf), vectors, "m1"),
        A.orphans(docs, "doc_id", labels, "doc_id", "document_without_label"),
        A.orphans(lines, "l_partkey", customers, "c_custkey", "line_without_supplier_customer"),
    )


@query("j13_name_match", """WITH q AS (SELECT p_partkey AS query_id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') q FROM part
 UNION ALL SELECT 1000000000 + c_custkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') FROM customer JOIN nation ON n_nationkey = c_nationkey),
 c AS (SELECT regexp_replace(lower(nm), '[^a-z0-9]', '', 'g') AS key, min(nm) AS ref_id FROM (SELECT p_type AS nm FROM part
  UNION ALL SELECT n_name FROM nation UNION ALL SELECT split_part(p_name, ' ', 2) FROM part) GROUP BY 1),
 m AS (SELECT q.query_id, c.key, c.ref_id, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN c.key = q.q THEN 0 ELSE 1 END, c.key) rn,
  CASE WHEN c.key = q.q THEN 'exact' ELSE 'contains' END AS how FROM q JOIN c ON q.q <> '' AND c.key <> '' AND (contains(c.key, q.q) OR contains(q.q, c.key)))
 SELECT q.query_id, m.ref_id, m.key AS ref_key, coalesce(m.how, 'none') AS how FROM q LEFT JOIN m ON m.query_id = q.query_id AND m.rn = 1""")
def j13(spark, sf) -> DataFrame:
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    queries = part.selectExpr("p_partkey AS query_id", "p_name AS query_name").unionByName(
        customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(
            "1000000000 + c_custkey AS query_id", "n_name AS query_name"
        )
    )
    names = (
        part.selectExpr("p_type AS ref_name")
        .unionByName(nation.selectExpr("n_name AS ref_name"))
        .unionByName(part.selectExpr("split_part(p_name, ' ', 2) AS ref_name"))
    )
    return M.match_names(queries, names.select(F.col("ref_name").alias("ref_id"), "ref_name"))


@query("j14_round_robin", """WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
 b AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS s FROM nation)
 SELECT s_suppkey, i, n_nationkey FROM a JOIN b ON b.s = a.i % (SELECT count(*) FROM nation)""")
def j14(spark, sf) -> DataFrame:
    return M.round_robin(table(spark, sf, "supplier"), table(spark, sf, "nation"), "s_suppkey", "n_nationkey")


_STORED = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN page_id || '/f' || (page_id % 50) || '.html'
 WHEN 2 THEN 'missing/f' || (page_id % 50) || '.html' ELSE 'none/x' || page_id END"""


@query("j18_resolve_paths", f"""WITH l AS (SELECT 'data/' || page_id || '/f' || (page_id % 50) || '.html' AS path FROM pages),
 r AS (SELECT page_id, {_STORED} AS path FROM pages), b AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS n, min(path) AS p FROM l GROUP BY 1)
 SELECT r.page_id, CASE WHEN starts_with(r.path, 'http') THEN r.path ELSE coalesce(l.path, b.p) END AS resolved FROM r
 LEFT JOIN l ON l.path = 'data/' || r.path LEFT JOIN b ON b.n = regexp_extract(r.path, '([^/]*)$', 1)""")
def j18(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    listing = pages.selectExpr("'data/' || page_id || '/f' || (page_id % 50) || '.html' AS path")
    rows = pages.selectExpr("page_id", f"{_STORED} AS path")
    return M.resolve_paths(rows, listing, "page_id", "path", "data").select("page_id", "resolved")


@query("ingest_catalogue", f"""SELECT CAST(p_partkey AS VARCHAR) AS print_id, p_name AS name, upper(p_brand) || '_' || (p_partkey % 300) || '_' ||
 CASE p_partkey % 3 WHEN 0 THEN 'en' ELSE 'de' END || '_' || p_partkey || '.jpg' AS file_path FROM part WHERE p_partkey % 3 IN (0, 1) AND ({URI_SQL}) IS NOT NULL""")
def ingest_catalogue(spark, sf) -> DataFrame:
    from prismcat.plans.ingest import ingest

    empty = lambda s: spark.createDataFrame([], s)
    result = ingest(raw_cards(spark, sf), empty(schemas.CARDS), empty(schemas.IMAGES), [F.col("name")], "bulk", C.PRINT_LANGUAGES)
    paths = result.images.select("print_id", "file_path")
    return result.cards.select("print_id", "name").join(paths, "print_id")


@query("stream_catalogue", f"""SELECT CAST(p_partkey AS VARCHAR) AS print_id, p_name AS name FROM part WHERE p_partkey % 3 IN (0, 1) AND ({URI_SQL}) IS NOT NULL""")
def stream_catalogue(spark, sf) -> DataFrame:
    """The same records arriving as JSON-lines files, folded in by micro-batches."""
    from prismcat.sources.keyed import read_keyed
    from prismcat.streaming.catalogue_stream import card_stream, fold_into_catalogue

    folder = _dump_lines(spark, sf)
    target = scratch_path(spark, "stream-table")
    run = fold_into_catalogue(card_stream(spark, folder), target, scratch_path(spark, "stream-progress"), C.PRINT_LANGUAGES)
    run.awaitTermination()
    return read_keyed(spark, target).select("print_id", "name")
