"""Folders of files as DataFrames, read by Spark so that any file system will do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions.scalars import has_extension


def _named(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("name", F.element_at(F.split(path, "/"), -1)).withColumn("folder", F.regexp_replace(path, "/[^/]*$", ""))


def file_listing(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool = False, required: bool = False) -> DataFrame:
    """(folder, name, path, length, modified) of the files with one of the extensions; contents are not read.

    A folder that doesn't exist has no files; if they are ``required``, that, and a folder without any, is an error.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if required:
            raise FileNotFoundError(f"the folder doesn't exist: {folder}") from e
        found = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    if required and found.where(has_extension(F.element_at(F.split("path", "/"), -1), extensions)).isEmpty():
        raise FileNotFoundError(f"the folder has no file that ends in one of {', '.join(extensions)}: {folder}")
    return _named(found).where(has_extension("name", extensions)).select("folder", "name", "path", "length", F.col("modificationTime").alias("modified"))


def relative_path(path: str, root: str) -> Column:
    """The part of a path below ``root``, with forward slashes."""
    return F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, name, text): each ``.txt`` file as one row, without white space at its ends."""
    read = spark.read.text(folder, wholetext=True, pathGlobFilter="*.[tT][xX][tT]").withColumn("path", F.input_file_name())
    return _named(read).select("folder", "name", F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))


def binary_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """(folder, name, path, content) of the files with one of the extensions."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return _named(found).where(has_extension("name", extensions)).select("folder", "name", "path", "content")


def images(spark: SparkSession, folder: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded pictures: (origin, height, width, n_channels, data); those that can't be read are left out, or null."""
    read = spark.read.format("image").option("dropInvalid", drop_invalid).load(folder)
    return read.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")


def rgb(pictures: DataFrame, data: str = "data", channels: str = "n_channels", pixels: str = "pixels") -> DataFrame:
    """Adds the pixels of decoded pictures, row by row, as red, green and blue from 0 to 1; gray is all three, and transparency goes."""

    @F.arrow_udf("array<float>")
    def turn(raw: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for v, c in zip(raw.to_pylist(), n.to_pylist(), strict=True):
            if v is None or c is None:
                out.append(None)
                continue
            x = np.frombuffer(v, np.uint8).reshape(-1, c)
            x = np.repeat(x, 3, axis=1) if c == 1 else x[:, 2::-1]
            out.append((x.astype(np.float32) / 255.0).ravel())
        return pa.array(out, pa.list_(pa.float32()))

    return pictures.withColumn(pixels, turn(F.col(data), F.col(channels)))
