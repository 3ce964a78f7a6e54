"""Pixels: decoding, perceptual hash, sharpness and exposure."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.media import quality_score


def decode_png(data: bytes) -> np.ndarray | None:
    """Grey levels of a non-interlaced 8-bit PNG (grey, RGB, with or without alpha), else null."""
    if data is None or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, head = 8, b"", None
    try:
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + n]
            head, body = (struct.unpack(">IIBBBBB", part), body) if kind == b"IHDR" else (head, body + part if kind == b"IDAT" else body)
            at += 12 + n
        width, height, depth, color, _, _, interlaced = head
        bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
        if depth != 8 or interlaced or not bands:
            return None
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * bands)
    except (struct.error, zlib.error, ValueError, TypeError):
        return None
    out = np.zeros((height, width * bands), np.int64)
    zero = np.zeros(width * bands, np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else zero
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(len(line)):
                left = out[y, x - bands] if x >= bands else 0
                corner = up[x - bands] if x >= bands else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                out[y, x] = (line[x] + guess) & 255
    pixels = out.reshape(height, width, bands)
    return pixels[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114]) if bands >= 3 else pixels[..., 0].astype(float)


def shrink(grey: np.ndarray, size: int) -> np.ndarray:
    """Mean of equal areas, size x size."""
    rows = np.linspace(0, grey.shape[0], size + 1)
    cols = np.linspace(0, grey.shape[1], size + 1)

    def along(a: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)])
        whole = edges.astype(int).clip(0, len(a))
        at = total[whole] + (edges - whole)[:, None] * a[np.minimum(whole, len(a) - 1)]
        return np.diff(at, axis=0) / np.diff(edges)[:, None]

    return along(along(grey, rows).T, cols).T


def perceptual_hash(grey: np.ndarray) -> str:
    """64 bits in hex: low frequencies of the cosine transform of a 32 x 32 picture above their median."""
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 64)
    low = (basis @ shrink(grey, 32) @ basis.T)[:8, :8]
    return f"{int(''.join('1' if x else '0' for x in (low > np.median(low)).ravel()), 2):016x}"


def sharpness(grey: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian."""
    if min(grey.shape) < 3:
        return 0.0
    inner = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    return float(inner.var())


def image_features(images: DataFrame) -> DataFrame:
    """(path, width, height, phash, sharpness, mean, md5, sha256, quality) of pictures (path, content); unreadable ones have null pixels' values."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                g = decode_png(data)
                rows.append((path, None, None, None, None, None) if g is None else (path, g.shape[1], g.shape[0], perceptual_hash(g), sharpness(g), float(g.mean() / 255)))
            out = pd.DataFrame(rows, columns=["path", "width", "height", "phash", "sharpness", "mean"])
            yield out.astype({"width": "Int64", "height": "Int64"})

    sums = images.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    seen = images.select("path", "content").mapInPandas(look, "path string, width long, height long, phash string, sharpness double, mean double")
    return seen.join(sums, "path").withColumn("quality", quality_score(F.col("sharpness"), F.col("mean"), F.col("width") * F.col("height") / 1e6))
