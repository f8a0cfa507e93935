"""Image tensors from ARGB pixels: channel unpacking, normalisation, layouts, shapes, bilinear resize."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def triplet(values: Column, default: float) -> Column:
    return F.array(*[F.coalesce(F.get(values, F.lit(i)).cast("double"), F.lit(default)) for i in range(3)])


def channel(pixels: Column, shift: int, mean: Column, std: Column) -> Column:
    return F.transform(pixels, lambda p: (F.shiftright(p, shift).bitwiseAND(255) / F.lit(255.0) - mean) / std)


def tensor(pixels: Column, mean: Column, std: Column, layout: str = "NCHW", channels: int = 3) -> Column:
    """Floats of one image of packed ARGB ints; alpha is ignored. Under 3 channels drops green and blue. Of a null image null,
    of an empty one no floats."""
    m, s = triplet(mean, 0.0), triplet(std, 1.0)
    planes = [channel(pixels, shift, m[i], s[i]) for i, shift in enumerate((16, 8, 0))][: max(1, min(channels, 3)) if channels >= 3 else 1]
    if layout == "NCHW":
        return F.flatten(F.array(*planes, *[F.transform(pixels, lambda _: F.lit(0.0)) for _ in range(channels - 3)]))
    zipped = F.arrays_zip(*[p.alias(f"c{i}") for i, p in enumerate(planes)])
    return F.flatten(F.transform(zipped, lambda z: F.array(*[z[f"c{i}"] for i in range(len(planes))])))


def tensor_shape(layout: str, batch: Column, channels: Column, height: Column, width: Column) -> Column:
    cast = [x.cast("long") for x in ((batch, channels, height, width) if layout == "NCHW" else (batch, height, width, channels))]
    return F.array(*cast)


def resize(pixels: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Bilinear stretch of row-major ARGB pixels, each channel on its own; the aspect ratio isn't kept. Null where the image
    or a side is null, a side isn't positive, or the pixels aren't width times height."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        fits = [a is not None and not pd.isna(b) and not pd.isna(c) and b > 0 and c > 0 and len(a) == b * c for a, b, c in zip(p, w, h, strict=True)]
        return pd.Series([_stretch(np.asarray(a, np.int64), int(b), int(c), to_width, to_height) if ok else None for ok, a, b, c in zip(fits, p, w, h, strict=True)])

    return run(pixels, width, height)


def _stretch(pixels: np.ndarray, w: int, h: int, tw: int, th: int) -> np.ndarray:
    parts = np.stack([(pixels.reshape(h, w) >> k) & 255 for k in (24, 16, 8, 0)]).astype(np.float64)
    y, x = np.clip((np.arange(th) + 0.5) * h / th - 0.5, 0, h - 1), np.clip((np.arange(tw) + 0.5) * w / tw - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None], (x - x0)[None, :]
    rows = lambda r: parts[:, r][:, :, x0] * (1 - fx) + parts[:, r][:, :, x1] * fx
    out = np.rint(rows(y0) * (1 - fy) + rows(y1) * fy).astype(np.int64)
    return (out[0] << 24 | out[1] << 16 | out[2] << 8 | out[3]).astype(np.uint32).view(np.int32).reshape(-1)
