"""Image files as pixels and tensors, decoded by Spark's image source (PNG, JPEG, GIF, BMP)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.imaging import resize, tensor


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _argb(data: pd.Series, channels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Packed ARGB ints of rows of grey, BGR or BGRA bytes."""

    def one(d, c, h, w):
        if d is None or c not in (1, 3, 4) or h <= 0 or w <= 0:
            return None
        p = np.frombuffer(d, np.uint8).reshape(-1, c).astype(np.uint32)
        b, g, r, a = (p[:, 0], p[:, 0], p[:, 0], 255) if c == 1 else (p[:, 0], p[:, 1], p[:, 2], p[:, 3] if c == 4 else 255)
        return (np.uint32(a) << 24 | r << 16 | g << 8 | b).astype(np.uint32).view(np.int32)

    return pd.Series([one(*x) for x in zip(data, channels, height, width, strict=True)])


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """uri, width, height, pixels (row-major ARGB) of each file; null pixels where a file can't be decoded."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    ok = F.col("height") > 0
    return raw.select(F.col("origin").alias("uri"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"), F.when(ok, _argb("data", "nChannels", "height", "width")).alias("pixels"))


def image_tensors(images: DataFrame, width: int, height: int, mean: Column, std: Column, layout: str = "NCHW") -> DataFrame:
    """images with tensor: pixels stretched to width by height, then normalised; null where there are no pixels."""
    fitted = resize(F.col("pixels"), F.col("width"), F.col("height"), width, height)
    return images.withColumn("_fitted", fitted).withColumn("tensor", tensor(F.col("_fitted"), mean, std, layout)).drop("_fitted")
