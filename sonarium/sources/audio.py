"""Audio files as tables."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from sonarium.functions.fixed import MEDIA_TYPES
from sonarium.functions.rows import extension, file_name, media_type


def _glob() -> str:
    """Accepted extensions in any case, so that other files are dropped while listing."""
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in MEDIA_TYPES]
    return "*.{" + ",".join(any_case) + "}"


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob())
        .load(folder)
    )


def list_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size, time and media type of the audio files below a folder; the contents are not read."""
    path = F.col("path")
    return audio_files(spark, folder).select(
        "path",
        file_name(path).alias("filename"),
        extension(path).alias("extension"),
        media_type(path).alias("media_type"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )


INFO_TYPE = StructType(
    [StructField("duration", DoubleType()), StructField("sample_rate", IntegerType()), StructField("channels", IntegerType())]
)


@F.pandas_udf(INFO_TYPE)
def wav_info(content: pd.Series) -> pd.DataFrame:
    """Duration (2 decimals), rate and channels from a WAV header; zeros for a file that cannot be read."""
    rows = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as w:
                rows.append((round(w.getnframes() / w.getframerate(), 2), w.getframerate(), w.getnchannels()))
        except Exception:
            rows.append((0.0, 0, 0))
    return pd.DataFrame(rows, columns=INFO_TYPE.names)


def _channels(data: bytes) -> np.ndarray | None:
    """Samples (channel, frame) of 8, 16, 24 or 32 bit WAV data in [-1, 1]; None for a file that cannot be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            raw, width, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()
        if width == 1:
            flat = (np.frombuffer(raw, "u1").astype("float64") - 128.0) / 128.0
        else:
            # shorter samples become the high bytes of 32 bits
            wide = np.zeros((len(raw) // width, 4), "u1")
            wide[:, 4 - width :] = np.frombuffer(raw, "u1").reshape(-1, width)
            flat = wide.view("<i4")[:, 0] / 2147483648.0
        return flat.reshape(-1, channels).T
    except Exception:
        return None


@F.pandas_udf(ArrayType(DoubleType()))
def wav_samples(content: pd.Series) -> pd.Series:
    """The mean of all channels of WAV data; null for a file that cannot be read."""
    return pd.Series([None if (x := _channels(data)) is None else x.mean(axis=0) for data in content], dtype=object)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def wav_channels(content: pd.Series) -> pd.Series:
    """Every channel of WAV data; null for a file that cannot be read."""
    return pd.Series([None if (x := _channels(data)) is None else [c.tolist() for c in x] for data in content], dtype=object)


@F.pandas_udf(BinaryType())
def encode_wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """One waveform in [-1, 1] as 16-bit mono WAV data, to be stored by any Spark sink."""
    out = []
    for x, r in zip(samples, rate):
        if x is None:
            out.append(None)
            continue
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(int(r))
            w.writeframes(np.clip(np.round(np.asarray(x) * 32767), -32768, 32767).astype("<i2").tobytes())
        out.append(buffer.getvalue())
    return pd.Series(out)


def read_waves(files: DataFrame, every_channel: bool = False) -> DataFrame:
    """One row per file of :func:`audio_files`: path, the mean of its channels (or each channel), sample rate.

    A file that cannot be read stays, with a null wave.
    """
    samples = wav_channels if every_channel else wav_samples
    read = files.select("path", samples("content").alias("wave"), wav_info("content").alias("_i"))
    return read.select("path", "wave", F.col("_i.sample_rate").alias("rate"))


def clip_info(files: DataFrame) -> DataFrame:
    """Size, duration, sample rate and channels of each file of :func:`audio_files`."""
    return files.select("path", F.col("length").alias("size"), wav_info("content").alias("_i")).select("path", "size", "_i.*")
