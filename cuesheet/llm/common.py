"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.sources.shared import cut, discard, few

__all__ = ["crc_mod", "cut", "discard", "few", "fresh", "table", "text_batches"]


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold few rows from now on: texts are long, and a batch is held whole in Python and the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with none of ``taken`` (Spark ignores case)."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out
