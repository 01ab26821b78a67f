"""Ordered folders of files as tables: listings, next numbers, and plans of changes.

Nothing here touches files; a plan says what to do, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.scalars import extension, has_extension, leading_number, numbered_name, pad3, sanitized, stem, unquoted
from cuesheet.sources.shared import cut, discard, numbered

#: The extensions each listing takes.
AUDIO = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac", ".wma")
AUDIO_SEGMENTS = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac")
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp")
MERGEABLE = (".mp4", ".webm", ".mov", ".avi")
MANAGED_AUDIO = (".mp3", ".wav", ".ogg", ".flac", ".m4a")
MANAGED_IMAGES = (".png", ".jpg", ".jpeg", ".webp")
MANAGED_VIDEOS = (".mp4", ".mov", ".avi", ".mkv", ".flv", ".wmv", ".webm")
TEXTS = (".txt",)


def listing(files: DataFrame, extensions: tuple[str, ...], folder: str = "folder", most: int | None = None, by_stem: bool = False) -> DataFrame:
    """(folder, pos, name): files with one of the extensions, sorted by name (or stem, then name), the first ``most`` of a folder."""
    kept = files.where(has_extension("name", extensions)).select(folder, "name")
    order = [*([stem("name")] if by_stem else []), "name"]
    if most and most > 0:
        # a limit on the rank of a row lets Spark keep that many rows of a folder in each task before the shuffle
        rank = F.row_number().over(Window.partitionBy(folder).orderBy(*order))
        return kept.withColumn("_n", rank).where(F.col("_n") <= most).select(folder, (F.col("_n") - 1).cast("long").alias("pos"), "name")
    return numbered(kept, [folder, *order], within=folder).select(folder, "pos", "name")


def deep_listing(files: DataFrame, extensions: tuple[str, ...], folder: str = "folder") -> DataFrame:
    """(pos, path): files of all folders with one of the extensions, sorted by their path, with forward slashes."""
    path = F.concat_ws("/", F.replace(F.col(folder), F.lit("\\"), F.lit("/")), "name")
    return numbered(files.where(has_extension("name", extensions)).select(path.alias("path")), "path").select("pos", "path")


def next_number_mex(files: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, next_number): the smallest number that no name begins with.

    Numbers are made distinct and ranked by folder; the first one above its rank leaves a gap before it.
    """
    used = files.select(folder, leading_number("name").alias("k")).where("k is not null").distinct()
    ranked = numbered(used, [folder, "k"], "r", within=folder)
    dense = ranked.groupBy(folder).agg(F.count(F.when(F.col("k") == F.col("r"), 1)).alias("n"))
    return files.select(folder).distinct().join(dense, folder, "left").select(folder, F.coalesce("n", F.lit(0).cast("long")).alias("next_number"))


def next_number_count(files: DataFrame, folder: str = "folder") -> DataFrame:
    return files.groupBy(folder).agg(F.count("*").alias("next_number"))


def free_numbers(files: DataFrame, new: DataFrame, folder: str = "folder") -> DataFrame:
    """``new`` (folder, pos, ...) with ``number``: one after the other, each takes the smallest number that no file's name begins with.

    The ``j``-th used number ``k`` of a folder has ``k - j`` free ones before it,
    so it comes before the new file number ``k - j``. In that common order, a new file's place is its number.
    """
    used = files.select(folder, leading_number("name").alias("k")).where("k is not null").distinct()
    before = numbered(used, [folder, "k"], "j", within=folder).select(folder, (F.col("k") - F.col("j")).alias("_at"), F.lit(0).alias("_new"), F.lit(None).cast(new.select(F.struct(*new.columns).alias("r")).schema["r"].dataType).alias("_row"))
    ahead = numbered(new.select(folder, "pos", F.struct(*new.columns).alias("_row")), [folder, "pos"], "_at", within=folder).select(folder, "_at", F.lit(1).alias("_new"), "_row")
    placed = numbered(before.unionByName(ahead), [folder, "_at", "_new"], "number", within=folder)
    return placed.where("_new = 1").select("_row.*", "number")


def saved_names(new: DataFrame, numbers: DataFrame, folder: str = "folder", suffix: str = ".png") -> DataFrame:
    """New rows (folder, pos) with the names ``NNN`` + suffix, from the folder's next number on."""
    return new.join(numbers, folder).select(folder, "pos", F.concat(pad3(F.col("next_number") + F.col("pos")), F.lit(suffix)).alias("name"))


def uploaded_names(new: DataFrame, numbers: DataFrame, folder: str = "folder") -> DataFrame:
    """Uploaded files (folder, pos, name) as ``NNN_name``, illegal characters left out."""
    return new.join(numbers, folder).select(folder, "pos", F.concat(pad3(F.col("next_number") + F.col("pos")), F.lit("_"), sanitized("name")).alias("name"))


def uploaded_images(new: DataFrame, numbers: DataFrame, folder: str = "folder") -> DataFrame:
    """Uploaded pictures (folder, pos, name) as ``NNN.extension``: the name's own one in lower case if it is a managed one, else ``.png``.

    A name of nothing but illegal characters is an ``error``.
    """
    clean = sanitized(F.coalesce("name", F.lit("")))
    ext = F.concat(F.lit("."), F.lower(F.element_at(F.split(clean, r"\."), -1)))
    full = F.concat(pad3(F.col("next_number") + F.col("pos")), F.when(ext.isin(*MANAGED_IMAGES), ext).otherwise(F.lit(".png")))
    error = F.when(clean == "", "name is empty")
    return new.join(numbers, folder).select(folder, "pos", error.alias("error"), F.when(error.isNull(), full).alias("name"))


def ordered_existing(ordered: DataFrame, existing: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The rows of ``ordered`` (key, pos) whose key exists, in their order, with places from 0."""
    return numbered(ordered.join(existing.select(key), key, "left_semi").withColumnRenamed(pos, "_at"), "_at", pos).drop("_at")


def existing_but(existing: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """What exists and is not kept."""
    return existing.join(kept.select(key), key, "left_anti")


def system_prompt(system: Column, seconds: Column) -> Column:
    """The system prompt, behind a request for the length in seconds where that is above 0."""
    # fixed value: the request's words
    return F.when(seconds > 0, F.concat(F.lit("请您根据要求生成一段总长度"), seconds.cast("string"), F.lit("秒的视频脚本；"), system)).otherwise(system)


def prompt_file(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Adds ``saved_as`` and ``error``: a sanitised name with ``.txt``, or what is missing."""
    clean = F.trim(sanitized(F.coalesce(F.col(name), F.lit(""))))
    error = F.when(clean == "", "name is empty").when(F.trim(F.coalesce(F.col(content), F.lit(""))) == "", "content is empty")
    full = F.when(F.lower(clean).endswith(".txt"), clean).otherwise(F.concat(clean, F.lit(".txt")))
    return df.withColumn("error", error).withColumn("saved_as", F.when(F.col("error").isNull(), full))


def reconcile_plan(existing: DataFrame, ordered: DataFrame, folder: str = "folder", keep_names: bool = False, guard_empty: bool = False) -> DataFrame:
    """(folder, action, old_name, new_name): make a folder hold what ``ordered`` (folder, pos, name) lists, in that order.

    Files that are not listed are deleted; the others are renamed to their
    number among those that exist. A repeated name is skipped the second time,
    but uses up a number. ``keep_names`` puts the number before the name.
    ``guard_empty`` leaves folders alone for which nothing is listed.
    """
    kept = ordered.join(existing.select(folder, "name"), [folder, "name"], "left_semi")
    safe = numbered(kept, [folder, "pos"], "idx", within=folder).groupBy(folder, "name").agg(F.min("idx").alias("idx"))
    new = numbered_name("idx", "name") if keep_names else F.concat(pad3("idx"), extension("name"))
    renames = safe.select(folder, F.lit("rename").alias("action"), F.col("name").alias("old_name"), new.alias("new_name"))
    gone = existing.join(safe.select(folder, "name"), [folder, "name"], "left_anti")
    if guard_empty:
        gone = gone.join(ordered.select(folder).distinct(), folder, "left_semi")
    return renames.unionByName(gone.select(folder, F.lit("delete").alias("action"), F.col("name").alias("old_name"), F.lit(None).cast("string").alias("new_name")))


def delete_plan(existing: DataFrame, gone: DataFrame, folder: str = "folder") -> DataFrame:
    """What stays after single files are deleted."""
    return existing.join(gone.select(folder, "name"), [folder, "name"], "left_anti")


def merge_manifest(listed: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, action, manifest): the ordered list of files to concatenate; one file is a copy."""
    names = F.array_sort(F.collect_list(F.struct("pos", "name")))
    lines = F.array_join(F.transform(names, lambda x: F.concat(F.lit("file '"), x["name"], F.lit("'"))), "\n")
    return listed.groupBy(folder).agg(F.when(F.count("*") == 1, "copy").otherwise("concat").alias("action"), lines.alias("manifest"))


def resolved(path: Column | str, roots: list[str]) -> Column:
    """Candidates for a path, in order: itself where it is absolute, else below each root."""
    p = unquoted(path)
    return F.when(p.startswith("/"), F.array(p)).otherwise(F.array(*(F.concat(F.lit(r.rstrip("/") + "/"), p) for r in roots)))


def resolve_existing(wanted: DataFrame, existing: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """``wanted`` with ``resolved``, the first of a path's candidates that is among ``existing`` (path), or else an ``error``."""
    key = "_wanted"
    named = wanted.withColumn(key, F.col(path))
    tried = named.select(key).distinct().select(key, F.posexplode(resolved(F.coalesce(F.col(key), F.lit("")), roots)).alias("_i", "_candidate"))
    there = tried.join(existing.select(F.col("path").alias("_candidate")), "_candidate", "left_semi")
    first = there.groupBy(F.col(key).alias("_of")).agg(F.min(F.struct("_i", "_candidate"))["_candidate"].alias("resolved"))
    out = named.join(first, F.col(key) == F.col("_of"), "left").drop(key, "_of")
    empty = unquoted(F.coalesce(F.col(path), F.lit(""))) == ""
    error = F.when(empty, "the path is empty").when(F.col("resolved").isNull(), F.concat(F.lit("the file is not found: "), unquoted(path)))
    return out.withColumn("error", error).withColumn("resolved", F.when(F.col("error").isNull(), F.col("resolved")))


def rename_steps(plan: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, step, action, old_name, new_name): a plan of changes in an order in which no file is overwritten.

    ``plan`` has (folder, action, old_name, new_name), old names and new names
    without repeats, and new names that no file has which stays as it is. Deletions are step 0. A
    rename waits for the one that frees its new name, so a step's number is one
    more than how many renames have to come before it. Renames that free one another's names in a
    circle are broken at the smallest old name: that file first gets a temporary
    name, and its new name last. Names that stay have no step.

    Which renames form circles, their smallest names, and how many come before
    each, are found by pointer doubling along new name -> old name: rounds of
    joins, as many as the logarithm of the longest chain, in which every rename
    learns of twice as many.
    """
    moves = cut(plan.where("action = 'rename' and old_name <> new_name").select(folder, "old_name", "new_name"), "renames")
    longest = moves.groupBy(folder).count().agg(F.max("count")).first()[0] or 0

    # where a chain has no end after as many steps as there are names, it is a circle
    at = cut(_followers(moves, folder).withColumn("least", F.col("old_name")), "circles")
    span = 1
    while span < 2 * longest:
        ahead = at.select(folder, F.col("old_name").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        before, at = at, cut(at.join(ahead, [folder, "next"], "left").select(folder, "old_name", F.col("_next").alias("next"), F.least("least", F.coalesce("_least", "least")).alias("least")), "circles")
        discard(before)
        span *= 2
    broken = cut(at.where((F.col("next").isNotNull()) & (F.col("old_name") == F.col("least"))).select(folder, F.col("old_name").alias("_broken")), "broken")

    # the name that is broken out is free at once, so the rename onto it waits for none
    follow = _followers(moves, folder).join(broken, (F.col("next") == F.col("_broken")) & (broken[folder] == moves[folder]), "left").select(moves[folder], "old_name", F.when(F.col("_broken").isNull(), F.col("next")).alias("next"))
    at = cut(follow.withColumn("n", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")), "chains")
    while not at.where("next is not null").isEmpty():
        ahead = at.select(folder, F.col("old_name").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        before, at = at, cut(at.join(ahead, [folder, "next"], "left").select(folder, "old_name", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0).cast("long"))).alias("n")), "chains")
        discard(before)

    first = broken.select(folder, F.col("_broken").alias("old_name"), F.lit(True).alias("_circle"))
    numbered_ = moves.join(at.select(folder, "old_name", "n"), [folder, "old_name"]).join(first, [folder, "old_name"], "left")
    apart = F.concat(F.lit("_tmp_"), "old_name")
    renames = numbered_.select(folder, (F.col("n") + 2).alias("step"), F.lit("rename").alias("action"), F.when(F.col("_circle"), apart).otherwise(F.col("old_name")).alias("old_name"), "new_name")
    aside = numbered_.where("_circle").select(folder, F.lit(1).cast("long").alias("step"), F.lit("rename").alias("action"), "old_name", apart.alias("new_name"))
    gone = plan.where("action = 'delete'").select(folder, F.lit(0).cast("long").alias("step"), "action", "old_name", "new_name")
    return renames.unionByName(aside).unionByName(gone)


def _followers(moves: DataFrame, folder: str) -> DataFrame:
    """(folder, old_name, next): each rename with the old name of the one that has to come before it, the one that frees its new name."""
    freed = moves.select(F.col(folder).alias("_folder"), F.col("old_name").alias("next"))
    return moves.join(freed, (moves[folder] == F.col("_folder")) & (F.col("new_name") == F.col("next")), "left").select(moves[folder], "old_name", "next")


def mime_kind(mime: Column | str) -> Column:
    """'audio' or 'video'; null for anything else."""
    m = F.col(mime) if isinstance(mime, str) else mime
    return F.when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video")
