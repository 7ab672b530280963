"""Image jobs: Spark distributes the image rows, one small numpy helper handles one image.

Input rows have the image source's columns: origin, height, width, nChannels, mode, data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType

from prismcat.functions import pixels as P
from prismcat.functions.vectors import unit
from prismcat.sources.images import IMAGE_STRUCT

# Fixed value: OpenCV type code of 8-bit BGR, as the image source uses it.
BGR_MODE = 16
# Fixed value: default encoder input (height, width).
INPUT_HW = (320, 224)


# Results held in a task before they are handed back to Spark.
_FLUSH_BYTES, _FLUSH_ROWS = 16_000_000, 2000


def _size(values: tuple) -> int:
    return sum(getattr(v, "nbytes", 0) or (len(v) if isinstance(v, bytes) else 8) for v in values)


def map_images(images: DataFrame, per_image: Callable, schema: str) -> DataFrame:
    """Apply ``per_image(row, rgb) -> iterator of tuples`` to every image.

    One image is decoded at a time, and results leave the task in frames of bounded size.
    """
    names = [part.strip().split(" ")[0] for part in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                rgb = P.from_struct(row.height, row.width, row.nChannels, row.data)
                for values in per_image(row, rgb):
                    out.append(values)
                    held += _size(values)
                    if held > _FLUSH_BYTES or len(out) >= _FLUSH_ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return images.mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    return schema.replace("<", "(").split(",")


def _struct_row(origin: str, rgb: np.ndarray) -> tuple:
    return (origin, rgb.shape[0], rgb.shape[1], 3, BGR_MODE, P.to_bytes(rgb))


def crop_images(images: DataFrame, box: dict, target_hw: tuple[int, int] | None = None) -> DataFrame:
    """Relative crop, fitted into the target keeping the aspect ratio, black borders."""
    settings = dict(box)
    if target_hw:
        settings.update(target_height=target_hw[0], target_width=target_hw[1])
    return map_images(
        images, lambda row, rgb: [_struct_row(row.origin, P.crop_letterbox(rgb, settings))], IMAGE_STRUCT
    )


def crop_roi(images: DataFrame, box: dict) -> DataFrame:
    """Plain relative crop of at least one pixel, for query photos."""
    return map_images(images, lambda row, rgb: [_struct_row(row.origin, P.crop_roi(rgb, box))], IMAGE_STRUCT)


def image_tensors(images: DataFrame, size_hw: tuple[int, int] = INPUT_HW) -> DataFrame:
    """(origin, tensor): resized, scaled to 0..1, channel-normalised, channels first."""
    def one(row, rgb):
        yield row.origin, P.normalise(P.to_tensor(P.resize(rgb, *size_hw))).ravel().astype(np.float32)

    return map_images(images, one, "origin string, tensor array<float>")


def image_statistics(images: DataFrame) -> DataFrame:
    """I03 per image: luminance, channel means, sharpness."""
    def one(row, rgb):
        yield (row.origin, *P.statistics(rgb).values())

    schema = (
        "origin string, mean_luminance double, std_luminance double, mean_r double, mean_g double, "
        "mean_b double, laplacian_var double"
    )
    return map_images(images, one, schema)


def domain_statistics(per_image: DataFrame, domain: str | None = None) -> DataFrame:
    """I03 per domain: number of readable images and the mean of every statistic."""
    names = ["mean_luminance", "std_luminance", "mean_r", "mean_g", "mean_b", "laplacian_var"]
    grouped = per_image.groupBy(domain) if domain else per_image.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("images"), *[F.avg(n).alias(n) for n in names])


def range_hints(reference: DataFrame, camera: DataFrame) -> DataFrame:
    """Augmentation ranges that would move the reference domain towards the camera domain.

    Both inputs are one-row results of ``domain_statistics``.
    """
    fields = F.struct("mean_luminance", "std_luminance")
    one = camera.withColumn("_r", reference.select(fields).scalar())
    floor = F.lit(1e-6)
    # fixed values below: limits and factors of the ranges
    bright = F.col("mean_luminance") / F.greatest(F.col("_r.mean_luminance"), floor)
    contrast = F.col("std_luminance") / F.greatest(F.col("_r.std_luminance"), floor)
    detail = F.sqrt(F.col("laplacian_var") + floor)
    return one.select(
        F.greatest(F.lit(0.4), bright - F.col("std_luminance")).alias("brightness_min"),
        F.least(F.lit(1.6), bright + F.col("std_luminance")).alias("brightness_max"),
        F.greatest(F.lit(0.6), contrast * 0.8).alias("contrast_min"),
        F.least(F.lit(1.6), contrast * 1.2).alias("contrast_max"),
        F.greatest(F.lit(0.2), 1.0 / (detail + floor)).alias("blur_sigma_max"),
        F.greatest(
            F.lit(0.005), F.abs(F.col("mean_luminance") - F.col("_r.mean_luminance")) / 3
        ).alias("noise_std_max"),
    )


def _with_seeds(images: DataFrame, n: int, seed: int) -> DataFrame:
    """One seed per variant from the path, so a retried task draws the same effects again."""
    seeds = F.transform(
        F.sequence(F.lit(0), F.lit(n)), lambda v: F.xxhash64(F.col("origin"), v, F.lit(seed))
    )
    return images.withColumn("seeds", seeds)


def augment_images(images: DataFrame, n: int, cfg: dict | None = None, seed: int = 42) -> DataFrame:
    """The original (variant 0) and n camera-like variants of every image.

    Pixels stay in the task that read them; ``image_splits`` keeps the tasks of a folder scan small.
    """
    settings = cfg or P.camera_config()

    def one(row, rgb):
        for variant, s in enumerate(row.seeds):
            out = rgb if variant == 0 else P.camera_like(rgb, int(s), settings)
            yield (*_struct_row(row.origin, out), variant)

    return map_images(_with_seeds(images, n, seed), one, IMAGE_STRUCT + ", variant int")


def effect_images(images: DataFrame, effect: Callable, seed: int = 42) -> DataFrame:
    """One named effect on every image: ``effect(rgb, rng) -> rgb``."""
    def one(row, rgb):
        rng = np.random.default_rng(int(row.seeds[0]) & 0xFFFFFFFFFFFFFFFF)
        yield _struct_row(row.origin, effect(rgb, rng))

    return map_images(_with_seeds(images, 0, seed), one, IMAGE_STRUCT)


def training_views(images: DataFrame, cfg: dict, seed: int = 42) -> DataFrame:
    """(origin, tensor) of one randomised training view per image."""
    def one(row, rgb):
        yield row.origin, P.training_view(rgb, int(row.seeds[0]), cfg).ravel().astype(np.float32)

    return map_images(_with_seeds(images, 0, seed), one, "origin string, tensor array<float>")


def variant_tensors(
    images: DataFrame, n: int, size_hw: tuple[int, int], box: dict | None = None, cfg: dict | None = None, seed: int = 42
) -> DataFrame:
    """I04 + I01 + I02 in one pass, so that pixels cross the Python boundary once: (origin, variant, tensor)."""
    settings = cfg or P.camera_config()

    def one(row, rgb):
        for variant, s in enumerate(row.seeds):
            view = rgb if variant == 0 else P.camera_like(rgb, int(s), settings)
            view = P.resize(P.crop_letterbox(view, box), *size_hw)
            yield row.origin, variant, P.normalise(P.to_tensor(view)).ravel().astype(np.float32)

    schema = "origin string, variant int, tensor array<float>"
    return map_images(_with_seeds(images, n, seed), one, schema)


def encode(
    tensor: Column, make_model: Callable, shape: list[int], batch_size: int = 64, element: DataType = FloatType()
) -> Column:
    """Unit vectors from a user-supplied model: ``make_model() -> (batch ndarray -> ndarray)``.

    The model is built once per Python worker and sees ``batch_size`` rows at a time.
    """
    predict = predict_batch_udf(
        make_model, return_type=ArrayType(element), batch_size=batch_size, input_tensor_shapes=[shape]
    )
    return unit(predict(tensor))
