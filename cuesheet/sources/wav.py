"""WAV files as rows of samples, in parts: a Spark data source whose tasks read byte ranges of files.

``spark.read.format("cuesheet_wav")`` gives (path, sample_rate, channel,
sample_idx, second, value), with values from -1 to 1. A file is split into
ranges of ``splitBytes``, whatever its length; a task reads the header and then
the samples that begin in its range, block by block. Files that are one range share
tasks, as many as fit ``splitBytes`` when each has ``OPEN_BYTES`` more. Filters on path, channel,
sample_idx and second are pushed down: files are left out, and only the bytes of the
samples asked for are read. Options:

* ``path``: a file or folder; ``recursive`` takes in folders below it.
* ``mono`` (default): channels are averaged, as channel 0; else a row for each.
* ``start``, ``duration``: seconds. A file is read from sample ``int(start * rate)`` on, ``int(duration * rate)``
  of them at most, all for 0; a file with nothing left is an error.
* ``invalid``: ``fail`` (default) or ``skip`` for files that are no PCM of 1 to 4 bytes, or that have no samples.

Files are opened through pyarrow's file systems, so ``path`` may be any URI that they know.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from cuesheet.operators.audio import decode_pcm

SCHEMA = "path string, sample_rate int, channel int, sample_idx long, second double, value float"
SPLIT_BYTES = 1 << 26
#: What opening a file counts as, in bytes, when files are dealt to tasks.
OPEN_BYTES = 1 << 17
#: Frames (a sample of every channel) that are read at once.
BLOCK = 1 << 16
#: Fixed values of the format: plain PCM, and PCM behind an extended header.
PCM, EXTENSIBLE = 1, 0xFFFE
_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
_NUMBERS = ("channel", "sample_idx", "second")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return fs.LocalFileSystem(), uri


@dataclass
class Header:
    """Where a file's samples are, and how they are laid out."""

    rate: int
    channels: int
    width: int
    start: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.width


class InvalidWav(ValueError):
    pass


def header_of(f: pa.NativeFile, size: int) -> Header:
    """Goes from chunk to chunk, reading their heads only."""
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise InvalidWav("no WAV file")
    number = lambda raw: int.from_bytes(raw, "little")
    shape, long_size, at = None, None, 12
    while at + 8 <= size:
        f.seek(at)
        head = f.read(8)
        name, n = head[:4], number(head[4:])
        if name == b"ds64":
            long_size = number(f.read(16)[8:])
        elif name == b"fmt ":
            shape = f.read(16)
        elif name == b"data":
            if shape is None or len(shape) < 16:
                raise InvalidWav("samples before their layout")
            kind, channels, rate, bits = number(shape[:2]), number(shape[2:4]), number(shape[4:8]), number(shape[14:])
            width = (bits + 7) // 8
            if kind not in (PCM, EXTENSIBLE) or not channels or not rate or not 1 <= width <= 4:
                raise InvalidWav("samples of another kind")
            n = long_size if long_size is not None and n == 0xFFFFFFFF else n
            frames = min(n, size - at - 8) // (channels * width)
            if not frames:
                raise InvalidWav("no samples")
            return Header(rate, channels, width, at + 8, frames)
        at += 8 + n + n % 2
    raise InvalidWav("no samples")


@dataclass
class Part:
    """The samples of a file that begin in a range of its bytes."""

    path: str
    size: int
    low: int
    high: int


@dataclass
class Parts(InputPartition):
    """What one task reads: a range of a long file, or short files."""

    parts: list[Part]


def dealt(parts: Iterable[Part], most: int) -> list[Parts]:
    """One task for each range of a split file; whole files together, up to ``most`` bytes with what opening them counts."""
    alone, together, full = [], [[]], 0
    for p in parts:
        if (p.low, p.high) != (0, p.size):
            alone.append(Parts([p]))
            continue
        cost = p.size + OPEN_BYTES
        if together[-1] and full + cost > most:
            together.append([])
            full = 0
        together[-1].append(p)
        full += cost
    return alone + [Parts(some) for some in together if some]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        get = lambda name, default: options.get(name, default)
        flag = lambda name, default: str(get(name, default)).lower() == "true"
        if not options.get("path"):
            raise ValueError("the path of a WAV file or folder is needed")
        self.path, self.recursive, self.mono = options["path"], flag("recursive", "false"), flag("mono", "true")
        self.skip = get("invalid", "fail") == "skip"
        self.split = max(1, int(get("splitBytes", SPLIT_BYTES)))
        self.start, self.duration = float(get("start", 0.0)), float(get("duration", 0.0))
        self.trimmed = bool(self.start or self.duration)
        self.paths: set[str] | None = None
        self.bounds: list[tuple[str, type, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "path" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif column in _NUMBERS and type(f) in _COMPARE and f.value is not None:
                self.bounds.append((column, type(f), f.value))
            elif not isinstance(f, IsNotNull):  # no column has nulls
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = located(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [found] if found.is_file else sorted(system.get_file_info(fs.FileSelector(path, recursive=self.recursive)), key=lambda i: i.path)
        parts = []
        for info in infos:
            uri = self.path if found.is_file else f"{self.path.rstrip('/')}/{info.path[len(path.rstrip('/')) + 1 :]}"
            hidden = info.base_name.startswith((".", "_"))
            if not info.is_file or hidden or not info.base_name.lower().endswith(".wav") or (self.paths is not None and uri not in self.paths):
                continue
            cuts = [*range(0, max(info.size, 1), self.split), info.size]
            parts += [Part(uri, info.size, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return dealt(parts, self.split) or [Parts([])]

    def window(self, h: Header) -> tuple[int, int]:
        """The samples of a file that options and filters leave: a range that may be a sample too wide at its ends."""
        first = max(0, min(int(self.start * h.rate), h.frames))
        wanted = int(self.duration * h.rate) if self.duration > 0 else h.frames
        last = first + min(wanted, h.frames - first)
        if self.trimmed and first == last:
            raise ValueError("no samples are left between start and end")
        for column, kind, value in self.bounds:
            if column == "channel" or not math.isfinite(value):
                continue
            at = value * h.rate if column == "second" else value
            if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                first = max(first, math.floor(at) - 1)
            if kind in (EqualTo, LessThan, LessThanOrEqual):
                last = min(last, math.ceil(at) + 2)
        return first, last

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for part in partition.parts:
            for batch in self._samples(part):
                held.append(batch)
                rows += batch.num_rows
                if rows >= BLOCK:
                    yield pa.concat_batches(held)
                    held, rows = [], 0
        if held:
            yield pa.concat_batches(held)

    def _samples(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, path = located(part.path)
        with system.open_input_file(path) as f:
            try:
                h = header_of(f, part.size)
            except InvalidWav as e:
                if self.skip:
                    return
                raise InvalidWav(f"{part.path}: {e}") from e
            first, last = self.window(h)
            at = lambda byte: max(0, -(-(byte - h.start) // h.frame_bytes))
            first, last = max(first, at(part.low)), min(last, at(part.high))
            for low in range(first, last, BLOCK):
                high = min(low + BLOCK, last)
                f.seek(h.start + low * h.frame_bytes)
                yield from self._rows(part.path, h, low, f.read((high - low) * h.frame_bytes))

    def _rows(self, path: str, h: Header, low: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        value = decode_pcm(raw, h.width).reshape(-1, h.channels)
        if self.mono:
            value = value.mean(1, dtype=np.float32, keepdims=True)
        n, channels = value.shape
        column = {"channel": np.tile(np.arange(channels, dtype=np.int32), n), "sample_idx": np.repeat(np.arange(low, low + n), channels)}
        column["second"] = column["sample_idx"] / h.rate
        kept = np.ones(n * channels, bool)
        for name, kind, bound in self.bounds:
            kept &= _COMPARE[kind](column[name], bound)
        rows = int(kept.sum())
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * rows, pa.string()), pa.array(np.full(rows, h.rate, np.int32)), *(pa.array(column[c][kept]) for c in _NUMBERS), pa.array(value.ravel()[kept].astype(np.float32))],
                ["path", "sample_rate", *_NUMBERS, "value"],
            )


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cuesheet_wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WavReader:
        return WavReader(dict(self.options))


def read_wav(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Samples of WAV files. Filters reach Python data sources of this session from now on."""
    spark.dataSource.register(WavSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(WavSource.name()).options(**{k: str(v) for k, v in options.items()}).load(path)
