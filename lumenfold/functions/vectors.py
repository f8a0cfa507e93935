"""Vector functions: normalisation, dot products, and little-endian float32 blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """v over its norm as double; a vector without a positive norm (zero, NaN) is unchanged."""
    return F.when(sum_of_squares(v) > 0, F.transform(v, lambda x: x.cast("double") / F.sqrt(sum_of_squares(v)))).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(a: Column, b: Column) -> Column:
    """The canonical score: the dot product in double precision, rounded, so order doesn't hang on summation order."""
    return F.round(dot(a, b), DIGITS)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def passes(score_: Column, threshold: float) -> Column:
    """A threshold at or below 0 is off, so negative scores pass; NaN never does."""
    return ~F.isnan(score_) & (score_ >= threshold) if threshold > 0 else ~F.isnan(score_)


def clamp_threshold(value: float, most: float | None = None) -> float:
    return max(0.0, value if most is None else min(value, most))


@F.pandas_udf(T.BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _from_blob(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


def from_blob(b: Column) -> Column:
    """Floats of a little-endian blob; null where the length isn't a multiple of 4, so callers can drop such rows."""
    return _from_blob(b)


def float_index(offset: Column) -> Column:
    return F.floor(offset / F.lit(4)).cast("long")
