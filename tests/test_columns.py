"""Scalar functions on the awkward values."""

import pytest
from pyspark.sql import functions as F

from prismcat.functions import columns as C
from prismcat.functions import vectors as V


def one(spark, values, ddl, expr):
    """Apply ``expr`` to a one-column table, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["", None, "abc", " 1.5 ", "1.5d", "-2", "1e3", ".5", "5.", "0x10", "1_000", "1f", "--1", " "]
    assert one(spark, texts, "string", C.to_number) == [
        None, None, None, 1.5, None, -2.0, 1000.0, 0.5, 5.0, None, 1000.0, None, None, None
    ]


def test_json_defaults(spark):
    texts = ['["R"]', "[", None, "", '{"a": 1}', "[]"]
    empty = F.array().cast("array<string>")
    got = one(spark, texts, "string", lambda x: C.json_or_default(x, "array<string>", empty))
    assert got == [["R"], [], [], [], [], []]


def test_first_truthy(spark):
    df = spark.createDataFrame([("", None, "c"), (None, "b", "c"), ("a", "", ""), ("", "", None)], "a string, b string, c string")
    got = [r[0] for r in df.select(C.first_truthy(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["c", "b", "a", None]


def test_image_uri(spark):
    cards = [
        ({"large": "L", "normal": "N"}, None), ({"large": "", "border_crop": "B"}, None),
        (None, [{"image_uris": {"normal": "F"}}]), ({}, [{"image_uris": {"large": "G"}}]),
        (None, None), (None, []), ({"small": "s"}, [{"image_uris": {"large": "G"}}]), (None, [{"image_uris": None}]),
    ]
    schema = "u map<string,string>, f array<struct<image_uris:map<string,string>>>"
    df = spark.createDataFrame([(u, f) for u, f in cards], schema)
    got = [r[0] for r in df.select(C.image_uri(F.col("u"), F.col("f"))).collect()]
    assert got == ["L", "B", "F", "G", None, None, None, None]
    other = [r[0] for r in df.select(C.image_uri(F.col("u"), F.col("f"), ["normal"])).collect()]
    assert other[0] == "N"


def test_file_names(spark):
    parts = [("m20", "1/2", "en", "abc"), (None, "", None, ""), ("", None, "de", "x")]
    df = spark.createDataFrame(parts, "s string, n string, l string, i string")
    got = [r[0] for r in df.select(C.canonical_file_name(*[F.col(c) for c in "snli"])).collect()]
    assert got == ["M20_1-2_en_abc.jpg", "UNK_0_xx_unknown.jpg", "UNK_0_de_x.jpg"]


def test_parse_file_names(spark):
    names = ["M20_123_en_abc.jpg", "dir/a_b_c.jpg", "SET-12-Some-Name.png", "plain.jpg", "A_1_x_y_id.jpeg", "a-b.png", ".hidden"]
    got = one(spark, names, "string", C.parse_file_name)
    assert tuple(got[0]) == ("abc", "M20", "123", "en")
    assert tuple(got[1]) == ("a_b_c", "", "", "a_b_c")
    assert got[2]["print_id"].startswith("SET_12_") and len(got[2]["print_id"]) == 14 and got[2]["name"] == "Some-Name"
    assert tuple(got[3]) == ("plain", "", "", "plain")
    assert tuple(got[4]) == ("id", "A", "1", "x_y")
    assert got[5]["print_id"] == "a-b" and got[6]["print_id"] == ".hidden"
    assert one(spark, names, "string", C.parse_file_name) == got


def test_language_from_file_name(spark):
    names = ["M20_123_EN_abc.jpg", "a_b_c.jpg", "a_b_deu_d.png", "x/y_1_2_fr_id.jpg"]
    assert one(spark, names, "string", C.language_from_file_name) == ["en", None, None, "fr"]


def test_paths_and_text(spark):
    paths = ["/srv/app/img/a.jpg", "/srv/other/a.jpg", "\\srv\\app\\b.png", "rel/c.jpg"]
    assert one(spark, paths, "string", lambda x: C.relative_path(x, "/srv/app/")) == [
        "img/a.jpg", "/srv/other/a.jpg", "b.png", "rel/c.jpg"
    ]
    assert one(spark, [None, " a\tb\nc ", ""], "string", C.tsv_text) == ["", "a b c", ""]
    assert one(spark, ["Jötun Grunt #2!", "", None], "string", C.normal_name) == ["jötungrunt2", "", None]


def test_grades(spark):
    scores = [0.81, 0.8, 0.61, 0.6, 0.41, 0.4, 0.0]
    assert one(spark, scores, "double", C.match_grade) == ["excellent", "good", "good", "poor", "poor", "none", "none"]


def test_decimals(spark):
    values = [1234567.5, -0.25, None, float("nan"), float("inf")]
    assert one(spark, values, "double", lambda x: C.fixed_decimals(x, 2, comma=True)) == ["1234567,50", "-0,25", "", "", ""]


def test_asset_key(spark):
    import hashlib

    path = "x/" + "n" * 50 + ".GIF"
    digest = hashlib.md5(path.encode()).hexdigest()[:12]
    assert one(spark, [path], "string", C.asset_key) == ["n" * 40 + f"_{digest}.jpg"]
    assert one(spark, ["a/b.PNG"], "string", C.asset_key)[0].endswith(".png")


def test_unit_vectors(spark):
    got = one(spark, [[3.0, 4.0], [0.0, 0.0], None, []], "array<double>", V.unit)
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1:] == [[0.0, 0.0], None, []]


def test_cosine_of_zero_and_equal_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [1.0, 2.0])], "a array<float>, b array<float>")
    cos = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert cos == pytest.approx([0.0, 1.0])
    dist = [r[0] for r in df.select(V.unit_euclid_from_cosine(V.cosine(F.col("a"), F.col("b")))).collect()]
    assert dist == pytest.approx([2**0.5, 0.0], abs=1e-7)


def test_dimension_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    assert df.where(V.has_dim(F.col("v"), 2)).count() == 1
    with pytest.raises(Exception, match="expected 2"):
        df.select(V.check_dim(F.col("v"), 2)).collect()
