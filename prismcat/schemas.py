"""Table schemas and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D = T.StringType(), T.DoubleType()


def _struct(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


# Field names of the bulk card records and the price keys they carry.
PRICE_KEYS = ["usd", "usd_foil", "eur", "eur_foil", "tix"]
CARD_RAW = _struct(
    ("id", _S), ("oracle_id", _S), ("name", _S), ("set", _S), ("set_name", _S),
    ("collector_number", _S), ("lang", _S), ("type_line", _S), ("oracle_text", _S),
    ("mana_cost", _S), ("cmc", _D), ("rarity", _S),
    ("colors", T.ArrayType(_S)), ("color_identity", T.ArrayType(_S)),
    ("image_uris", T.MapType(_S, _S)), ("legalities", T.MapType(_S, _S)),
    ("prices", T.MapType(_S, _S)),
    ("card_faces", T.ArrayType(_struct(("image_uris", T.MapType(_S, _S))))),
)

CARDS = _struct(
    ("print_id", _S), ("logical_id", _S), ("name", _S), ("set_code", _S), ("set_name", _S),
    ("collector_number", _S), ("lang", _S), ("type_line", _S), ("oracle_text", _S),
    ("mana_cost", _S), ("cmc", _D), ("rarity", _S),
    ("colors", T.ArrayType(_S)), ("color_identity", T.ArrayType(_S)),
    ("image_uris", T.MapType(_S, _S)), ("legalities", T.MapType(_S, _S)),
    *[(f"price_{k}", _D) for k in PRICE_KEYS],
)

IMAGES = _struct(
    ("image_id", _S), ("print_id", _S), ("logical_id", _S), ("file_path", _S),
    ("source", _S), ("language", _S), ("is_training", T.BooleanType()),
)

EMBEDDINGS = _struct(
    ("emb_id", _S), ("print_id", _S), ("logical_id", _S), ("image_id", _S),
    ("mode", _S), ("aug_index", T.IntegerType()), ("emb", T.ArrayType(T.FloatType())),
    ("model_id", _S), ("created_at", T.TimestampType()),
)

# aug_index of a stored centroid row (fixed value).
CENTROID_INDEX = 999


def image_key(print_id: Column, path: Column) -> Column:
    """Image id: digest of the unique (print, path) pair. 64-bit hashes would collide at this scale."""
    return F.md5(F.concat_ws("\u0001", print_id.cast("string"), path).cast("binary"))


def embedding_key(print_id: Column, mode: Column, aug_index: Column) -> Column:
    """Embedding id: the unique (print, mode, index) spelled out."""
    return F.concat_ws("#", print_id.cast("string"), mode, aug_index.cast("string"))


def evolve(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Add declared columns that are missing as typed NULLs; keep extra columns at the end."""
    have = set(df.columns)
    wanted = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in declared.fields
    ]
    extra = [F.col(c) for c in df.columns if c not in set(declared.fieldNames())]
    return df.select(*wanted, *extra)
