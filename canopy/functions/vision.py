"""Image sharpness: population variance of the 3x3 Laplacian.

Stencil ``[[0,1,0],[1,-4,1],[0,1,0]]`` with reflect-101 borders (the
defaults of the usual computer-vision Laplacian with aperture 1), variance
over all pixels.  Undecodable frames score 0.0 and are kept.

Three forms:

* :func:`add_blur_score` -- column expressions over a flat pixel array
  (higher-order functions, runs inside whole-stage codegen, no shuffle).
* :func:`blur_pixels_udf` -- the same on numpy, Arrow-batched pandas UDF.
* :func:`blur_image_udf` -- decoded image struct (Spark ``image`` source,
  BGR bytes) -> grey -> score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Grey conversion weights (ITU-R BT.601), applied to R, G, B.
GREY_R, GREY_G, GREY_B = 0.299, 0.587, 0.114


def _reflect(i: Column, n: Column) -> Column:
    return F.when(i < 0, -i).when(i >= n, F.lit(2) * n - 2 - i).otherwise(i)


def add_blur_score(df: DataFrame, pixels: str, width: int, out: str = "blur_score") -> DataFrame:
    """Append the blur score of a row-major grey image given as an array column.

    Three projections (pixels as doubles, Laplacian array, mean) keep each
    intermediate array computed once per row; Catalyst does not merge
    projections that would duplicate a non-trivial expression.  Null and empty
    arrays, part rows and frames of fewer than two rows or columns score 0.0.
    """
    w = F.lit(width)
    staged = df.withColumn("__px", F.col(pixels).cast("array<double>"))
    px = F.col("__px")
    n = F.size(px)
    h = (n / width).cast("int")

    def at(r, c):
        return F.element_at(px, r * w + c + 1)

    def lap(k):
        r = (k / width).cast("int")
        c = k % width
        up = at(_reflect(r - 1, h), c)
        down = at(_reflect(r + 1, h), c)
        left = at(r, _reflect(c - 1, w))
        right = at(r, _reflect(c + 1, w))
        return (up + down + left + right) - F.lit(4.0) * at(r, c)

    staged = staged.withColumn("__lap", F.when(
        (n > 0) & (n % width == 0) & (h >= 2) & F.lit(width >= 2), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lap))
        .otherwise(F.array().cast("array<double>")))
    laps = F.col("__lap")
    m = F.size(laps)
    staged = staged.withColumn("__mean", F.when(m > 0, F.aggregate(laps, F.lit(0.0), lambda a, x: a + x) / m))
    mean = F.col("__mean")
    var = F.aggregate(laps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / m
    return (staged.withColumn(out, F.when(m > 0, var).otherwise(F.lit(0.0)))
            .drop("__px", "__lap", "__mean"))


def laplacian_var_np(img: np.ndarray) -> float:
    """Reference implementation on a 2-D array."""
    if img is None or img.size == 0 or img.ndim != 2 or min(img.shape) < 2:
        return 0.0
    a = img.astype(np.float64)
    p = np.pad(a, 1, mode="reflect")  # reflect without repeating the edge = reflect-101
    lap = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) - 4.0 * a
    return float(lap.var())


def make_blur_pixels_udf(width: int):
    @F.pandas_udf(DoubleType())
    def blur_pixels(arrs: pd.Series) -> pd.Series:
        out = np.zeros(len(arrs))
        for i, a in enumerate(arrs):
            if a is None or len(a) == 0 or len(a) % width:
                continue
            out[i] = laplacian_var_np(np.asarray(a, dtype=np.float64).reshape(-1, width))
        return pd.Series(out)
    return blur_pixels


def grey_from_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    if height is None or height <= 0 or width is None or width <= 0 or not data:
        return None
    buf = np.frombuffer(data, dtype=np.uint8)
    if buf.size != height * width * channels:
        return None
    if channels == 1:
        return buf.reshape(height, width)
    img = buf.reshape(height, width, channels).astype(np.float64)
    grey = GREY_B * img[..., 0] + GREY_G * img[..., 1] + GREY_R * img[..., 2]
    return np.clip(np.rint(grey), 0, 255).astype(np.uint8)


@F.pandas_udf(DoubleType())
def blur_image_udf(height: pd.Series, width: pd.Series, channels: pd.Series,
                   data: pd.Series) -> pd.Series:
    """Blur score of decoded images (``image`` source columns); invalid -> 0.0."""
    out = np.zeros(len(data))
    for i in range(len(data)):
        try:
            g = grey_from_bgr(data.iat[i], int(height.iat[i]), int(width.iat[i]),
                              int(channels.iat[i]))
            out[i] = laplacian_var_np(g) if g is not None else 0.0
        except Exception:  # unreadable frame: score 0.0, row kept
            out[i] = 0.0
    return pd.Series(out)
