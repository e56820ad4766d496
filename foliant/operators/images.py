"""Image operators on gray images held as bytes: columns height, width, pixels (a byte each, in rows)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a histogram's class follows from.
LOW_SPREAD, MOSTLY = 0.02, 0.6

Operator = Callable[[np.ndarray], np.ndarray]


def autocontrast(x: np.ndarray) -> np.ndarray:
    """Darkest to black, lightest to white."""
    lo, hi = int(x.min(initial=255)), int(x.max(initial=0))
    return x if hi <= lo else np.rint((x.astype(float) - lo) * 255 / (hi - lo)).astype(np.uint8)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, n // 2, mode="edge"), (n, n))


def median(x: np.ndarray, n: int = 3) -> np.ndarray:
    return np.median(_windows(x, n), axis=(2, 3)).astype(np.uint8)


def unsharp(x: np.ndarray, amount: float = 1.5, n: int = 3) -> np.ndarray:
    """What the mean of its surroundings lacks is added to each pixel."""
    return np.clip(np.rint(x + amount * (x - _windows(x.astype(float), n).mean(axis=(2, 3)))), 0, 255).astype(np.uint8)


def threshold(x: np.ndarray) -> int:
    """Otsu's: the level that parts the histogram with the greatest variance between its sides."""
    counts = np.bincount(x.ravel(), minlength=256).astype(float)
    below, total = counts.cumsum(), (counts * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((total[-1] * below / below[-1] - total) ** 2 / (below * (below[-1] - below)))
    return int(between.argmax())


def binarize(x: np.ndarray) -> np.ndarray:
    return np.where(x > threshold(x), 255, 0).astype(np.uint8) if x.size else x


def despeckle(x: np.ndarray) -> np.ndarray:
    """Dark pixels without a dark neighbour become light."""
    dark = x < 128
    around = _windows(dark.astype(np.uint8), 3).sum(axis=(2, 3)) - dark
    return np.where(dark & (around == 0), 255, x).astype(np.uint8)


def rotate(x: np.ndarray, degrees: int) -> np.ndarray:
    """By quarter turns."""
    return np.ascontiguousarray(np.rot90(x, degrees // 90))


def downscale(x: np.ndarray, most: int = 1600) -> np.ndarray:
    """Means of equal squares, so that no side is longer than `most`."""
    n = -(-max(x.shape) // most) if x.size else 1
    h, w = x.shape[0] // n * n, x.shape[1] // n * n
    return x if n == 1 else x[:h, :w].reshape(h // n, n, w // n, n).mean(axis=(1, 3)).astype(np.uint8)


def skew(x: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """The angle in degrees at which rows of dark pixels are sharpest, by profiles of sheared images."""
    ys, xs = np.nonzero(x < 128)
    if not len(ys):
        return 0.0
    best = (-1.0, 0.0)
    for angle in np.arange(-most, most + step / 2, step):
        rows = np.rint(ys - xs * np.tan(np.deg2rad(angle))).astype(int)
        profile = np.bincount(rows - rows.min()).astype(float)
        if (sharp := float((profile**2).sum())) > best[0]:
            best = (sharp, float(angle))
    return best[1]


def deskew(x: np.ndarray) -> np.ndarray:
    """Columns are shifted by the skew."""
    angle = skew(x)
    if not angle:
        return x
    out = np.full_like(x, 255)
    for i, shift in enumerate(np.rint(np.arange(x.shape[1]) * np.tan(np.deg2rad(angle))).astype(int)):
        column = x[max(0, shift) : x.shape[0] + min(0, shift), i]
        out[max(0, -shift) : max(0, -shift) + len(column), i] = column
    return out


OPERATORS: dict[str, Operator] = {f.__name__: f for f in (autocontrast, median, unsharp, binarize, despeckle, deskew, downscale)}


def apply(df: DataFrame, names: list[str], pixels: str = "pixels") -> DataFrame:
    """A chain of operators by name on every image: height, width and pixels are replaced; null images stay null."""
    chain = [OPERATORS[n] for n in names]

    @F.pandas_udf("height int, width int, pixels binary")
    def work(height: pd.Series, width: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for h, w, c in zip(height, width, content, strict=True):
            if c is None:
                out.append((None, None, None))
                continue
            x = np.frombuffer(c, np.uint8).reshape(int(h), int(w))
            for f in chain:
                x = f(x)
            out.append((*x.shape, x.tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "pixels"])

    kept = [c for c in df.columns if c not in ("height", "width", "pixels")]
    return df.select(*kept, work("height", "width", pixels).alias("__i")).select(*kept, "__i.*")


def histogram_class(spread: Column, dark: Column, light: Column) -> Column:
    """low_contrast, dark, light or normal: from the spread of a histogram and its shares of dark and light pixels."""
    return F.when(spread < LOW_SPREAD, "low_contrast").when(dark > MOSTLY, "dark").when(light > MOSTLY, "light").otherwise("normal")


def whole_page(pages: DataFrame) -> DataFrame:
    """Where no layout model is at hand: one region a page, of half confidence."""
    return pages.select("doc_id", "page_num", F.lit("text").alias("region_type"), F.array(F.lit(0), F.lit(0), "width", "height").alias("bbox"), F.lit(0.5).alias("confidence"))
