"""Scalar column expressions: casts, JSON, names, paths, formatting, grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Image variants in order of preference, allowed print languages, image suffixes.
IMAGE_VARIANTS = ["large", "normal", "border_crop"]
PRINT_LANGUAGES = ["en", "de"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png"]
# Match grades by strict lower bound of the similarity.
GRADES = [("excellent", 0.8), ("good", 0.6), ("poor", 0.4)]
NO_GRADE = "none"
# Fixed value: spellings Python's float() accepts for a finite number.
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def to_number(c: Column) -> Column:
    """Text to double; NULL, blank or unparseable text gives NULL."""
    plain = F.regexp_replace(F.trim(c), "_", "")
    return F.when(c.rlike(_NUMBER), plain.try_cast("double"))


def json_text(c: Column) -> Column:
    """Nested value to compact JSON text, NULL stays NULL."""
    return F.to_json(c)


def json_or_default(c: Column, ddl: str, default: Column) -> Column:
    """Parse JSON text; NULL or broken text gives the default.

    ``from_json`` alone would return a half-filled value for truncated text.
    """
    return F.coalesce(F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, ddl)), default)


def image_uri(uris: Column, faces: Column, variants: list[str] = IMAGE_VARIANTS) -> Column:
    """First non-empty variant of the card's own URIs, else of its first face."""
    own = F.when(F.size(uris) > 0, uris)
    chosen = F.coalesce(own, F.get(faces, F.lit(0)).getField("image_uris"))
    return first_truthy(*[chosen.getItem(v) for v in variants])


def canonical_file_name(set_code: Column, number: Column, lang: Column, print_id: Column) -> Column:
    """``{SET}_{NUMBER}_{LANG}_{ID}.jpg`` with a stand-in for every missing part."""
    stem = F.concat_ws(
        "_",
        F.upper(first_truthy(set_code, F.lit("UNK"))),
        F.replace(first_truthy(number, F.lit("0")), F.lit("/"), F.lit("-")),
        first_truthy(lang, F.lit("xx")),
        first_truthy(print_id, F.lit("unknown")),
    )
    return F.concat(stem, F.lit(".jpg"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parse_file_name(path: Column) -> Column:
    """struct(print_id, set_code, collector_number, name) from an image file name.

    Underscore names win; dash names get a stable hashed id; anything else is its own id.
    """
    stem = file_stem(path)
    under, dash = F.split(stem, "_"), F.split(stem, "-", 3)
    hashed = F.lpad(F.pmod(F.xxhash64(stem), F.lit(10_000_000)).cast("string"), 7, "0")

    def parts(print_id: Column, set_code: Column, number: Column, name: Column) -> Column:
        return F.struct(
            print_id.alias("print_id"), set_code.alias("set_code"),
            number.alias("collector_number"), name.alias("name"),
        )

    return (
        F.when(
            F.size(under) >= 4,
            parts(
                F.element_at(under, -1), F.get(under, F.lit(0)), F.get(under, F.lit(1)),
                F.array_join(F.slice(under, F.lit(3), F.greatest(F.size(under) - 3, F.lit(0))), "_"),
            ),
        )
        .when(
            F.size(dash) == 3,
            parts(
                F.concat_ws("_", F.get(dash, F.lit(0)), F.get(dash, F.lit(1)), hashed),
                F.get(dash, F.lit(0)), F.get(dash, F.lit(1)), F.get(dash, F.lit(2)),
            ),
        )
        .otherwise(parts(stem, F.lit(""), F.lit(""), stem))
    )


def language_from_file_name(path: Column) -> Column:
    """The second-last underscore part when it is a two-letter code."""
    parts = F.split(file_stem(path), "_")
    code = F.get(parts, F.size(parts) - 2)
    return F.when((F.size(parts) >= 4) & (F.length(code) == 2), F.lower(code))


def relative_path(path: Column, root: str) -> Column:
    """P10: forward slashes, project root stripped."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.rstrip("/") + "/"
    return F.when(posix.startswith(prefix), F.substring(posix, len(prefix) + 1, 2**31 - 1)).otherwise(posix)


def normal_name(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def tsv_text(c: Column) -> Column:
    """NULL to empty, tabs and line feeds to blanks, trimmed."""
    return F.trim(F.translate(F.coalesce(c, F.lit("")), "\t\n", "  "))


def normal_header(name: str) -> str:
    """Column header to a lower-case identifier."""
    out = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in name.lower())
    return "_".join(out.split())


def by_alias(df: DataFrame, *aliases: str) -> Column:
    """First non-empty value among the alias columns the table actually has."""
    present = [F.trim(F.col(a)) for a in aliases if a in df.columns]
    return first_truthy(*present) if present else F.lit(None).cast("string")


def language_allowed(lang: Column, languages: list[str]) -> Column:
    """No languages given means all are allowed."""
    return lang.isin(*languages) if languages else F.lit(True)


def match_grade(similarity: Column) -> Column:
    """Strict lower bounds, so a score exactly on a bound gets the lower grade."""
    steps = [(F.lit(label), similarity > bound) for label, bound in GRADES]
    first = F.when(steps[0][1], steps[0][0])
    return reduce(lambda w, s: w.when(s[1], s[0]), steps[1:], first).otherwise(F.lit(NO_GRADE))


def any_flag(*flags: Column) -> Column:
    """At least one flag set."""
    return reduce(lambda a, b: a | b, [f != 0 for f in flags])


def asset_key(path: Column) -> Column:
    """P20: short readable stem plus a digest of the whole path; unknown suffixes become .jpg."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))
    kept = F.when(suffix.isin(*[f".{s}" for s in IMAGE_SUFFIXES]), suffix).otherwise(F.lit(".jpg"))
    return F.concat(
        F.substring(file_stem(path), 1, 40), F.lit("_"), F.substring(F.md5(path.cast("binary")), 1, 12), kept
    )


def fixed_decimals(x: Column, decimals: int = 6, comma: bool = False) -> Column:
    """Fixed decimals without thousands separators; NULL, NaN and infinities are blank."""
    text = F.format_string(f"%.{decimals}f", x)
    text = F.replace(text, F.lit("."), F.lit(",")) if comma else text
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit("")).otherwise(text)
