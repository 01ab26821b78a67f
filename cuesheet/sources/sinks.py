"""Writing results as files. Rows are written by Spark's own writers, which commit whole tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.operators import audio, library
from cuesheet.sources.file_sink import write_files
from cuesheet.sources.files import file_listing
from cuesheet.sources.shared import cut


def write_prompts(prompts: DataFrame, path: str, name: str = "saved_as", content: str = "content") -> None:
    """Prompts that have a file name, as one text file in a folder for each name."""
    prompts.where(F.col(name).isNotNull()).select(F.col(name).alias("file"), F.col(content).alias("value")).write.partitionBy("file").mode("error").text(path)


def write_media(rows: DataFrame, path: str, columns: tuple[str, ...] = ("folder", "name", "content")) -> None:
    """Files as rows of a table: their folder, name and bytes, partitioned by folder."""
    rows.select(*columns).write.partitionBy(columns[0]).mode("error").parquet(path)


def save_numbered(new: DataFrame, path: str, suffix: str, gaps: bool = False, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Files (folder, pos, content) below ``path`` as ``NNN`` and ``suffix``, all or none; (folder, pos, name) of what was written.

    Numbers go on from the number of files that a folder has, or, with ``gaps``,
    from the smallest one that no name begins with. Only files with one of the ``extensions`` count.
    Should another writer have taken a name meanwhile, nothing is written.
    """
    spark = new.sparkSession
    there = file_listing(spark, path, extensions or (extension_of(suffix),), recursive=True)
    there = there.withColumn("folder", F.regexp_extract("path", f"{path.rsplit('/', 1)[-1]}/(.*)/[^/]*$", 1))
    known = there.select("folder", "name").join(new.select("folder").distinct(), "folder", "left_semi")
    numbers = library.next_number_mex(known) if gaps else library.next_number_count(known)
    all_ = new.select("folder").distinct().join(numbers, "folder", "left").select("folder", F.coalesce("next_number", F.lit(0).cast("long")).alias("next_number"))
    names = cut(library.saved_names(new, all_, suffix=suffix), "names")
    write_files(new.select("folder", "pos", "content").join(names, ["folder", "pos"]), path)
    return names


def extension_of(name: str) -> str:
    return name[name.rindex(".") :].lower()


def save_audio(new: DataFrame, path: str, rate: int, samples: str = "samples") -> DataFrame:
    """Samples (folder, pos, samples) as 16-bit WAV files ``NNN_audio.wav``, numbered behind the audio files that are there."""
    return save_numbered(audio.encode_wav(new, samples, rate, "content"), path, "_audio.wav", extensions=library.MANAGED_AUDIO)


def save_prompts(prompts: DataFrame, path: str, folder: str = "folder") -> None:
    """Checked prompts (folder, saved_as, content, error) as text files; those with an error are left out, and files of the same name replaced."""
    good = prompts.where(F.col("error").isNull()).select(folder, F.col("saved_as").alias("name"), F.encode("content", "UTF-8").alias("content"))
    write_files(good, path, overwrite=True)


def to_json_table(rows: DataFrame, keys: list[str], pos: str, *fields: str) -> DataFrame:
    """(keys, json): rows of a table as a JSON array of arrays, in order of ``pos``; cells keep their types, null is null."""
    cell = lambda f: F.regexp_extract(F.to_json(F.array(f)), r"(?s)^\[(.*)\]$", 1)
    line = F.concat(F.lit("["), F.concat_ws(",", *(cell(f) for f in fields)), F.lit("]"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, line.alias("line")))).alias("x"))
    return listed.select(*keys, F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["line"]), ","), F.lit("]")).alias("json"))
