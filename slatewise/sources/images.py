"""Fingerprints of decoded images, with numpy over Arrow batches. Vector files are not drawn: they give an error row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.shipping import ship

PRINTS = "filename string, size bigint, ahash bigint, phash bigint, moments array<float>, width int, height int, error string"
LONGEST = 256


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box-averaged (or repeated, when larger) to height x width."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        low, high = edges[:-1, None], edges[1:, None]
        cells = np.arange(n)[None, :]
        part = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
        return part / part.sum(axis=1, keepdims=True)

    rows = np.tensordot(weights(image.shape[0], height), image.astype(np.float32), axes=(1, 0))
    return np.tensordot(rows, weights(image.shape[1], width), axes=(1, 1)).transpose(0, 2, 1)


def on_background(rgba: np.ndarray) -> np.ndarray:
    """RGB on white if an opaque pixel has a channel below 240 or none is opaque, else on black."""
    alpha = rgba[..., 3:4].astype(float)
    opaque = alpha[..., 0] > 10
    dark = (rgba[..., :3] < 240).any(axis=2) & opaque
    ground = 255.0 if dark.any() or not opaque.any() else 0.0
    return rgba[..., :3] * (alpha / 255) + ground * (1 - alpha / 255)


def _bits(flags: np.ndarray) -> int:
    return int(np.packbits(flags.ravel(), bitorder="little").view("<i8")[0])


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def fingerprint(rgba: np.ndarray) -> tuple[int, int, list[float]]:
    """aHash of 8 x 8 greys, pHash of the low 8 x 8 of a 32 x 32 DCT, nine colour moments of 256 x 256."""
    rgb = on_background(rgba)
    grey = (rgb @ np.array([0.299, 0.587, 0.114]))[..., None]
    small = np.round(resized(grey, 8, 8)[..., 0], 6)
    c = _cosines(32)
    low = np.round((c @ resized(grey, 32, 32)[..., 0] @ c.T)[:8, :8], 6).ravel()
    x = resized(rgb, LONGEST, LONGEST).reshape(-1, 3) / 255
    mean = x.mean(axis=0)
    d = x - mean
    moments = np.stack([mean, np.sqrt((d**2).mean(axis=0)), np.cbrt((d**3).mean(axis=0))], axis=1).ravel()
    return _bits(small > round(float(small.mean()), 6)), _bits(low > np.sort(low[1:])[31]), moments.tolist()


def fingerprints(spark: SparkSession, files: str) -> DataFrame:
    """One row per file: rasters through Spark's image reader; what that can't read, vector files among it, has an error."""
    ship(spark)
    sizes = spark.read.format("binaryFile").load(files).select("path", F.col("length").alias("size"))
    rasters = spark.read.format("image").option("dropInvalid", True).load(files)
    fields = rasters.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                pixels = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
                if r.nChannels == 1:
                    pixels = np.repeat(pixels, 3, axis=2)
                alpha = pixels[..., 3:4] if r.nChannels == 4 else np.full((*pixels.shape[:2], 1), 255, np.uint8)
                rows.append((r.path, *fingerprint(np.concatenate([pixels[..., 2::-1], alpha], axis=2)), r.width, r.height))
            yield pd.DataFrame(rows, columns=["path", "ahash", "phash", "moments", "width", "height"])

    prints = fields.mapInPandas(run, "path string, ahash bigint, phash bigint, moments array<float>, width int, height int")
    joined = sizes.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(prints, "path", "left")
    return joined.select(S.basename(F.col("path")).alias("filename"), "size", "ahash", "phash", "moments", "width", "height", F.when(F.col("ahash").isNull(), "render failed").alias("error"))
