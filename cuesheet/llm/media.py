"""Media columns: texts or bytes as WAV, spectra, and peak-pair fingerprints.

``store_wav`` writes a binary column as mono 8-bit WAV files; ``read_wav``
reads such files back and adds the samples and the fingerprint of each. The
fingerprint is an array of (frame, code) pairs: the strongest peaks of a
short-time Fourier transform, each paired with the next few peaks, with
``code`` holding both frequencies and the frame distance.

Null payloads are stored as empty ones, and null files are read as such; equal payloads give equal files and
fingerprints, silence has no peaks, and rows are never merged or dropped.
Other columns pass through; added columns are named by the caller. Each row is
worked on alone, so memory is bounded by one Arrow batch.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.common import fresh, table, text_batches

RATE = 8000
FRAME = 576
HOP = 288
PEAKS = 3
FAN_OUT = 3
SPAN = 16

PAIRS = T.ArrayType(T.StructType([T.StructField("frame", T.IntegerType(), False), T.StructField("code", T.IntegerType(), False)]), False)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One mono WAV file of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def peaks_of(samples: bytes, frame: int = FRAME, hop: int = HOP, peaks: int = PEAKS) -> tuple[np.ndarray, np.ndarray]:
    """(frame numbers, frequency bins) of the strongest local maxima, by frame and bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    none = np.zeros(0, np.int64)
    if x.size < frame:
        return none, none
    found = []
    window = np.hanning(frame).astype(np.float32)
    views = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    for lo in range(0, len(views), 1024):  # bounds the spectra of a very long text
        power = np.abs(np.fft.rfft((views[lo : lo + 1024] - views[lo : lo + 1024].mean(1, keepdims=True)) * window, axis=1))
        mid = power[:, 1:-1]
        # rounded, so that equal spectra rank alike on any machine
        height = np.where((mid > power[:, :-2]) & (mid >= power[:, 2:]), np.round(mid, 2), 0.0)
        best = np.sort(np.argsort(-height, axis=1, kind="stable")[:, :peaks], axis=1)
        row, col = np.nonzero(np.take_along_axis(height, best, 1) > 0)
        found.append((row + lo, best[row, col] + 1))
    return np.concatenate([f for f, _ in found]), np.concatenate([b for _, b in found])


def pair_up(frames: np.ndarray, bins: np.ndarray, fan_out: int = FAN_OUT, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Each peak with the ``fan_out`` peaks that come next, at most ``span`` frames on: (frame, code)."""
    at, codes = [], []
    for k in range(1, fan_out + 1):
        i = np.arange(max(0, frames.size - k))
        j = i + k
        gap = frames[j] - frames[i]
        near = gap <= span
        at.append(frames[i][near])
        codes.append((bins[i] << 15 | bins[j] << 5 | gap)[near])
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return at[order].astype(np.int32), codes[order].astype(np.int32)


def store_wav(df: DataFrame, payload: Column, wav_col: str = "wav", rate: int = RATE) -> DataFrame:
    """Add ``wav_col``: the bytes of ``payload`` as a WAV file (null: an empty one)."""

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([to_wav(v or b"", rate) for v in values.to_pylist()], pa.binary())

    text_batches(df.sparkSession)
    return df.withColumn(wav_col, encode(payload))


def read_wav(df: DataFrame, wav_col: str = "wav", samples_col: str = "samples", pairs_col: str = "pairs") -> DataFrame:
    """Add what is read back from ``wav_col``: its samples and its (frame, code) pairs, in time order."""
    kind = T.StructType([T.StructField("samples", T.BinaryType()), T.StructField("pairs", PAIRS)])
    arrow = pa.struct([("samples", pa.binary()), ("pairs", pa.list_(pa.field("element", pa.struct([pa.field("frame", pa.int32(), False), pa.field("code", pa.int32(), False)]), False)))])

    @F.arrow_udf(kind)
    def decode(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in values:
            samples, ends, frames, codes = [], [0], [], []
            for v in part.to_pylist():
                samples.append(b"" if v is None else from_wav(v))
                at, code = pair_up(*peaks_of(samples[-1]))
                frames.append(at)
                codes.append(code)
                ends.append(ends[-1] + len(at))
            flat = pa.StructArray.from_arrays([np.concatenate(frames) if frames else np.zeros(0, np.int32), np.concatenate(codes) if codes else np.zeros(0, np.int32)], fields=list(arrow.field("pairs").type.value_type))
            pairs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=arrow.field("pairs").type)
            yield pa.StructArray.from_arrays([pa.array(samples, pa.binary()), pairs], fields=list(arrow))

    text_batches(df.sparkSession)
    (both,) = fresh(df.columns + [samples_col, pairs_col], "_read")
    out = df.withColumn(both, decode(F.col(wav_col)))
    return out.withColumns({samples_col: F.col(f"{both}.samples"), pairs_col: F.col(f"{both}.pairs")}).drop(both)


def padded(text: Column, unit: int = FRAME) -> Column:
    """UTF-8 bytes of ``text``, then bytes 255 up to a positive multiple of ``unit``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    short = F.greatest(F.lit(unit), F.ceil(F.length(raw) / unit) * unit) - F.length(raw)
    return F.concat(raw, F.substring(F.lit(b"\xff" * unit), F.lit(1), short.cast("int")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media = read_wav(store_wav(docs, padded(F.col("text"))))
    return media.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("n_bytes"),
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32)")).alias("tail_crc32"),
        F.length("wav").cast("long").alias("media_bytes"),
        F.sha2("wav", 256).alias("media_sha256"),
        F.concat_ws(" ", F.transform("pairs", lambda p: F.concat_ws(":", p["frame"], F.hex(p["code"])))).alias("feature"),
    )


QUERIES = {"op4_media": op4_media}
