"""Rows as files, in two phases: a Spark data source that writes ``folder``, ``name`` and ``content``.

``df.write.format("cuesheet_files").mode("append").save(path)``: every task
writes its files below a hidden folder of this write, one for each attempt. Once all tasks have ended,
the driver moves the files of the successful attempts to their places and
removes the hidden folder. So neither a killed task nor a failed job leaves a
file behind, and none is seen before all are there. Two files of one name, or
one that is there already, end the commit before anything is moved (``overwrite`` replaces
what is there); should a move fail, those before it are undone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Event

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cuesheet.sources.wav import located

#: Files that the driver moves at once; a move is a request to the file system.
MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: a folder and the number of files in it."""

    folder: str
    files: int


def checked(part: str) -> str:
    """A folder or file name that stays below its root and can be seen."""
    if not part or part.startswith("/") or any(p in ("", ".", "..") or p[0] in "._" for p in part.split("/")):
        raise ValueError(f"no name for a file: {part!r}")
    return part


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool) -> None:
        if not {"name", "content"} <= set(columns):
            raise ValueError("columns name and content are needed")
        self.path, self.overwrite, self.folders = path.rstrip("/"), overwrite, "folder" in columns
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        context = TaskContext.get()
        own = f"{context.partitionId()}-{context.taskAttemptId()}"
        system, root = located(f"{self.staging}/{own}")
        # folders are made one by one: where the write was given up meanwhile, the one above is gone, and stays so
        system.create_dir(root, recursive=False)
        made, n = set(), 0
        for row in iterator:
            target = f"{checked(row.folder)}/{checked(row.name)}" if self.folders else checked(row.name)
            full = f"{root}/{target}"
            levels = target.split("/")
            for k in range(1, len(levels)):
                above = "/".join([root, *levels[:k]])
                if above not in made:
                    system.create_dir(above, recursive=False)
                    made.add(above)
            if system.get_file_info(full).type != fs.FileType.NotFound:
                raise FileExistsError(target)
            with system.open_output_stream(full) as out:
                out.write(row.content or b"")
            n += 1
        return Staged(own, n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, staging = located(self.staging)
        _, root = located(self.path)
        moves: dict[str, str] = {}
        for m in messages:
            if not m or not m.files:
                continue
            base = f"{staging}/{m.folder}"
            found = [i.path for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file]
            if len(found) != m.files:
                raise OSError(f"{m.folder} has {len(found)} files instead of {m.files}")
            for path in found:
                target = f"{root}/{path[len(base) + 1 :]}"
                if target in moves:
                    raise FileExistsError(f"two files are called {target}")
                moves[target] = path
        folders = {t.rsplit("/", 1)[0] for t in moves}
        known = {i.path for f in folders for i in system.get_file_info(fs.FileSelector(f, allow_not_found=True))}
        there = moves.keys() & known
        if there and not self.overwrite:
            raise FileExistsError(f"{len(there)} files are there already, as {min(there)}")
        done: list[tuple[str, str]] = []
        failed = Event()

        def place(k: int, target: str) -> None:
            if failed.is_set():
                return
            try:
                if target in there:
                    kept = f"{staging}/replaced-{k}"
                    system.move(target, kept)
                    done.append((kept, target))
                system.move(moves[target], target)
                done.append((target, moves[target]))
            except Exception:
                failed.set()
                raise

        try:
            for folder in sorted(folders):
                system.create_dir(folder, recursive=True)
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(place, *zip(*enumerate(moves), strict=True)) if moves else [])
        except Exception:
            for now, before in reversed(done):
                system.move(now, before)
            raise
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self, tries: int = 5) -> None:
        """Remove what is staged; tasks that have not been told yet may still be writing there."""
        system, staging = located(self.staging)
        for left in reversed(range(tries)):
            try:
                if system.get_file_info(staging).type != fs.FileType.NotFound:
                    system.delete_dir(staging)
                return
            except OSError:
                if not left:
                    raise
                time.sleep(0.2)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cuesheet_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        writer = FileWriter(self.options["path"], schema.names, overwrite)
        system, staging = located(writer.staging)
        system.create_dir(staging, recursive=True)
        return writer


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows (name, content), and folder if they have it, as files below ``path``."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSink)
    columns = [c for c in ("folder", "name", "content") if c in rows.columns]
    rows.select(*columns).write.format(FileSink.name()).mode("overwrite" if overwrite else "append").save(path)
