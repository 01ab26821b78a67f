"""Samples as rows: peaks by bin, channel means, channel layout, and PCM bytes to numbers."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BINS, MOST_BINS = 64, 4096


def channel_mean(samples: DataFrame, asset: str = "asset_id") -> DataFrame:
    """(asset, sample_idx, value): the mean over channels."""
    return samples.groupBy(asset, "sample_idx").agg(F.avg("value").alias("value"))


def waveform_peaks(samples: DataFrame, bins: int = 1400, asset: str = "asset_id") -> DataFrame:
    """(asset, bin, peak) for every bin of every asset: the largest absolute value, 0.0 for empty bins.

    Bin ``b`` begins at sample ``floor(b * (n / bins))``; with fewer samples than
    bins, some are empty. A sample's bin is found by arithmetic and moved by one where rounding put it across an edge,
    so peaks are one aggregation, with partial maxima before the shuffle.
    """
    bins = max(LEAST_BINS, min(bins, MOST_BINS))
    sizes = samples.groupBy(asset).agg((F.max("sample_idx") + 1).alias("n"))
    step = F.col("n") / F.lit(float(bins))
    edge = lambda b: F.when(b >= bins, F.col("n")).otherwise(F.floor(b * step))
    i = F.col("sample_idx")
    near = samples.join(sizes, asset).withColumn("b", F.least(F.ceil((i + 1) / step) - 1, F.lit(bins - 1).cast("long")))
    moved = near.withColumn("bin", F.when(i < edge(F.col("b")), F.col("b") - 1).when(i >= edge(F.col("b") + 1), F.col("b") + 1).otherwise(F.col("b")))
    peaks = moved.groupBy(asset, "bin").agg(F.max(F.abs("value")).alias("peak"))
    grid = sizes.select(asset, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(peaks, [asset, "bin"], "left").select(asset, "bin", F.coalesce("peak", F.lit(0.0)).alias("peak"))


def durations(samples: DataFrame, rate: int, asset: str = "asset_id") -> DataFrame:
    return samples.groupBy(asset).agg((F.count("*") / rate).alias("duration"))


def stereo(samples: DataFrame, asset: str = "asset_id") -> DataFrame:
    """Two channels: one channel twice, or the first two of more."""
    n = samples.groupBy(F.col(asset).alias("_asset")).agg((F.max("channel") + 1).alias("n"))
    counted = samples.join(n, F.col(asset).eqNullSafe(F.col("_asset"))).drop("_asset")
    targets = F.when(F.col("n") == 1, F.array(F.lit(0), F.lit(1))).when(F.col("channel") < 2, F.array(F.col("channel").cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return counted.withColumn("channel", F.explode(targets)).drop("n")


def decode_pcm(raw: bytes, width: int) -> np.ndarray:
    """Little-endian PCM of 1 to 4 bytes as numbers from -1 to 1; single bytes are unsigned."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return ((x ^ 0x800000) - 0x800000).astype(np.float32) / 8388608.0
    if width not in (2, 4):
        raise ValueError(f"samples of {width} bytes")
    return np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << 8 * width - 1)


def decode_wav(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, sample_rate, n_samples, samples array<float>) of WAV files, channels averaged; one row each, none for other files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        x = decode_pcm(w.readframes(w.getnframes()), w.getsampwidth()).reshape(-1, w.getnchannels()).mean(1)
                        rate = w.getframerate()
                except (wave.Error, EOFError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([rate], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], ["path", "sample_rate", "n_samples", "samples"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(read, "path string, sample_rate int, n_samples long, samples array<float>")


def encode_wav(rows: DataFrame, samples: str = "samples", rate: int = 44100, wav: str = "wav") -> DataFrame:
    """Adds 16-bit mono WAV bytes of an array of numbers from -1 to 1."""

    @F.arrow_udf("binary")
    def write(values: pa.Array) -> pa.Array:
        out = []
        for v in values:
            x = np.clip(np.asarray(v.as_py() or [], np.float32), -1, 1)
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes((x * 32767).astype("<i2").tobytes())
            out.append(buffer.getvalue())
        return pa.array(out, pa.binary())

    return rows.withColumn(wav, write(samples))
