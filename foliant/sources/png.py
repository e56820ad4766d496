"""PNG images as gray pixels, by the standard library: 8 bits, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import files

# Fixed by the format: the signature, and samples by pixel of each colour type.
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}


def encode(x: np.ndarray) -> bytes:
    """A gray image."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((x.shape[0], x.shape[1] + 1), np.uint8)
    rows[:, 1:] = x
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Gray pixels; colours by their luma, transparency left out."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body, at = data[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"IHDR":
            wide, high, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace or colour not in SAMPLES:
                raise ValueError("only 8 bits, not interlaced, without a palette")
        elif kind == b"IDAT":
            packed.append(body)
    n = SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(high, wide * n + 1)
    out, before = np.zeros((high, wide * n), np.uint8), np.zeros(wide * n, np.uint8)
    for y in range(high):
        how, line = rows[y, 0], rows[y, 1:]
        if how == 0:
            out[y] = line
        elif how == 1:
            out[y] = np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            out[y] = line + before
        else:
            row, up = [0] * n + line.tolist(), [0] * n + before.tolist()
            for i in range(n, len(row)):
                a, b, c = row[i - n], up[i], up[i - n]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[i] = (row[i] + guess) & 255
            out[y] = row[n:]
        before = out[y]
    pixels = out.reshape(high, wide, n).astype(float)
    return np.rint(pixels[:, :, 0] if n < 3 else pixels[:, :, :3] @ (0.299, 0.587, 0.114)).astype(np.uint8)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Image files as documents of one page: path, page_num, height, width, pixels, error."""

    @F.pandas_udf("height int, width int, pixels binary, error string")
    def read(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                x = decode(bytes(c))
                out.append((*x.shape, x.tobytes(), None))
            except Exception as e:
                out.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["height", "width", "pixels", "error"])

    return files(spark, path, "*.png").select("path", F.lit(1).alias("page_num"), read("content").alias("i")).select("path", "page_num", "i.*")
