"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: application -> (JVM, Hadoop configuration, folder): what to remove at the end.
_HELD: dict[str, tuple] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: What is being told of new tables, by ``recording``.
_RECORDS: list[list[str]] = []
#: Rows of a key or two up to which a table is broadcast to whole rows, so that they need no shuffle.
FEW = 1 << 20
#: Rows that a task gets, about, where ``dealt`` hands them out.
TASK_ROWS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder of its
    own (tests); a cluster without it is an error, since a folder on one
    machine would not be seen by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="cuesheet-")
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables."""
    sc = spark.sparkContext
    if sc.applicationId not in _HELD:
        _HELD[sc.applicationId] = (sc._jvm, sc._jsc.hadoopConfiguration(), f"{shared_dir(spark)}/cuesheet/{sc.applicationId}")
    return _HELD[sc.applicationId][2]


def _remove(jvm: object, conf: object, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that still read them must have been written."""
    held = _HELD.pop(spark.sparkContext.applicationId, None)
    if held:
        _remove(*held)


@atexit.register
def _release_all() -> None:
    while _HELD:
        held = _HELD.popitem()[1]
        try:
            _remove(*held)
        except Exception:  # noqa: BLE001, S110 - the JVM may have gone first
            pass


def scratch(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one, for files that are no table; removed like ``cut``'s tables."""
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    What follows starts from the files, so a lost executor costs no recomputed
    lineage, and work used twice is done once. The table stays until
    ``discard``, ``release`` or the end of the driver's process.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            jvm, conf, _ = _HELD[df.sparkSession.sparkContext.applicationId]
            _remove(jvm, conf, path)


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of the tables that ``cut`` writes meanwhile, for ``remove``."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS.remove(record)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables by path; those that are gone already don't matter."""
    held = _HELD.get(spark.sparkContext.applicationId)
    for path in paths if held else []:
        _remove(held[0], held[1], path)


def few(written: DataFrame, most: int = FEW) -> DataFrame:
    """A written table, to be broadcast if it has ``most`` rows at most; else joined as Spark plans it."""
    return F.broadcast(written) if written.count() <= most else written


def dealt(key: str, rows: int, *tables: DataFrame) -> list[DataFrame]:
    """Tables dealt out by ``key`` alike, to a task for each ``TASK_ROWS`` of ``rows``.

    What is joined, grouped and windowed by the key from there on is one stage, whose operators all hold
    memory at once. Spark would merge its partitions down to the number of cores, so that a task's memory grew with the input.
    """
    n = max(1, -(-rows // TASK_ROWS))
    return [df.repartition(n, key) for df in tables]


def numbered(df: DataFrame, keys: str | list[str | Column], pos: str = "pos", within: str | None = None) -> DataFrame:
    """Adds places from 0 in the order of ``keys``, without bringing all rows together.

    With ``within``, the first of ``keys``, rows of each of its values are numbered
    by themselves. A range sort gives partitions in order. They are written with
    the place of each row in its partition, and the sizes of the partitions
    before are added: one row for each, and, with ``within``, for each partition
    that a value is in, which are broadcast if they are few.
    """
    keys = [keys] if isinstance(keys, str) else keys
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    at, part, group, first, size, before = (mark + name for name in ("at", "part", "group", "first", "size", "before"))
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # its upper bits are the partition, its lower ones the place there
    own = cut(parts.withColumn(at, F.monotonically_increasing_id()), "numbered")
    of = F.shiftright(at, 33)
    sizes = own.select(at, of.alias(part), (F.col(within) if within else F.lit(0)).alias(group)).groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias(size))
    ahead = F.sum(size).over(Window.partitionBy(group).orderBy(part)) - F.col(size)
    offsets = sizes.select(group, part, (ahead - F.col(first)).alias(before))
    on = (of == F.col(part)) & (F.col(within).eqNullSafe(F.col(group)) if within else F.lit(True))
    return own.join(few(cut(offsets, "offsets")) if within else F.broadcast(offsets), on).withColumn(pos, F.col(before) + F.col(at)).drop(part, at, before, group)
