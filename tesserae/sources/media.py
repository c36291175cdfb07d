"""Media files: listings, wave files and stored vectors."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import file_stem
from tesserae.workspace import ship

# --- fixed values: suffixes of media files --------------------------------------------------------------------------
IMAGES = ("jpg", "jpeg", "png", "webp")
SOUNDS = ("wav", "mp3", "m4a", "flac")


def listing(spark: SparkSession, root: str, suffixes=IMAGES) -> DataFrame:
    """(path, suffix, stem, length) of the files below a folder with one of the suffixes in any case; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    s = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return df.withColumn("suffix", s).where(F.col("suffix").isin(*suffixes)).withColumn("stem", file_stem("path"))


def counts_by_suffix(spark: SparkSession, root: str, suffixes) -> DataFrame:
    return listing(spark, root, suffixes).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


def image_records(spark: SparkSession, root: str, dataset: str, emotion: str = "neutral") -> DataFrame:
    """Records of an image-only pool: one per image, unlabelled."""
    return listing(spark, root, IMAGES).select(
        F.lit(dataset).alias("source_dataset"), F.col("stem").alias("sample_id"), F.col("path").alias("image_path"),
        F.lit("unlabeled").alias("raw_label"), F.lit(emotion).alias("unified_emotion"))


def decode_wave(content: bytes | None) -> tuple[np.ndarray, int] | None:
    """(samples in [-1, 1], rate) of 8-, 16- or 32-bit PCM, channels averaged; None if it cannot be read."""
    try:
        with wave.open(io.BytesIO(content or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, np.int16 if width == 2 else np.int32).astype(float) / float(1 << (8 * width - 1))
    else:
        return None
    return x.reshape(-1, channels).mean(axis=1), rate


def sound_descriptor(x: np.ndarray, size: int = 64) -> np.ndarray:
    """``size`` numbers for a sound: 16 statistics of its wave and spectrum, then its log spectrum resampled, scaled to length 1."""
    if x.size == 0:
        return np.zeros(size)
    mag = np.abs(np.fft.rfft(x))
    f, total = np.arange(mag.size), mag.sum() or 1.0
    centre = (f * mag).sum() / total
    spread = np.sqrt(((f - centre) ** 2 * mag).sum() / total)
    d = np.diff(x) if x.size > 1 else np.zeros(1)
    stats = np.array([
        x.mean(), x.std(), x.min(), x.max(), np.abs(x).mean(), np.sqrt((x**2).mean()), (np.diff(np.signbit(x)) != 0).mean() if x.size > 1 else 0.0,
        d.mean(), d.std(), mag.mean(), mag.std(), mag.max(), centre / max(mag.size, 1), spread / max(mag.size, 1), np.median(np.abs(x)), np.percentile(np.abs(x), 95)])
    log = np.log1p(mag)
    tail = np.interp(np.linspace(0, 1, size - stats.size), np.linspace(0, 1, log.size), log)
    v = np.concatenate([stats, tail])
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def sound_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(path, rate, seconds, vector) of the wave files below a folder; unreadable ones have nulls."""
    ship(spark)

    @F.pandas_udf("rate int, seconds double, vector array<double>")
    def describe(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            got = decode_wave(c)
            rows.append((None, None, None) if got is None else (got[1], got[0].size / got[1], sound_descriptor(got[0]).tolist()))
        return pd.DataFrame(rows, columns=["rate", "seconds", "vector"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    return files.select("path", describe("content").alias("d")).select("path", "d.*")


def stored_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(path, vector) of the array files below a folder, flattened; unreadable ones are null."""
    ship(spark)

    @F.pandas_udf("array<float>")
    def read(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            try:
                out.append(np.load(io.BytesIO(c), allow_pickle=False).astype(np.float32).reshape(-1).tolist())
            except Exception:
                out.append(None)
        return pd.Series(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    return files.select("path", read("content").alias("vector"))


def stub_vectors(df: DataFrame, key: str, size: int = 64, name: str = "vector") -> DataFrame:
    """Adds a pseudo-random unit vector that depends on the key only; a null key gives null."""
    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def make(keys: pd.Series) -> pd.Series:
        import hashlib

        out = []
        for k in keys:
            if k is None:
                out.append(None)
                continue
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big"))
            v = rng.standard_normal(size).astype(np.float32)
            out.append((v / np.linalg.norm(v)).astype(float).tolist())
        return pd.Series(out)

    return df.withColumn(name, make(F.col(key)))
