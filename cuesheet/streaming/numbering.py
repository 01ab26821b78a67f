"""Numbers for files that arrive as a stream: every upload takes the smallest number that its folder has not used.

Events are (folder, seq, kind, name). A ``file`` event is a file that is there,
whose leading digits, if it has any, use up a number; an ``upload`` is given one. Events of a
folder come in the order of ``seq``; however they are cut into batches, the
numbers are the same.

The state of a folder is a map of blocks, a bitmap of ``BLOCK`` numbers each, and
the first block that may have a free one. A block is read when a number
in it comes up, so an event touches a few kilobytes of state however many files there are.
Numbers beyond 64 bits are nobody's next one, and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BLOCK = 1 << 15
_DIGITS = re.compile(r"[0-9]+")


class Numbering(StatefulProcessor):
    """Marks used numbers, and finds the smallest unused one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "bits binary")
        self.first = handle.getValueState("first", "block long")

    def _bits(self, block: int) -> np.ndarray:
        if self.blocks.containsKey((block,)):
            return np.unpackbits(np.frombuffer(self.blocks.getValue((block,))[0], np.uint8))
        return np.zeros(BLOCK, np.uint8)

    def _mark(self, number: int) -> None:
        block, at = divmod(number, BLOCK)
        bits = self._bits(block)
        if not bits[at]:
            bits[at] = 1
            self.blocks.updateValue((block,), (np.packbits(bits).tobytes(),))

    def _next(self) -> int:
        """The smallest unused number; blocks found full are never looked at again."""
        block = before = self.first.get()[0] if self.first.exists() else 0
        while (bits := self._bits(block)).all():
            block += 1
        if block != before:
            self.first.update((block,))
        return block * BLOCK + int(bits.argmin())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        given = []
        for seq, kind, name in zip(events["seq"], events["kind"], events["name"], strict=True):
            if kind == "upload":
                number = self._next()
                given.append((key[0], int(seq), name, number))
            else:
                digits = _DIGITS.match(name or "")
                number = int(digits[0]) if digits else -1
            if 0 <= number < 1 << 63:
                self._mark(number)
        yield pd.DataFrame(given, columns=["folder", "seq", "name", "number"])

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """Let this session keep such states in RocksDB, as they have to be."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def numbered_uploads(events: DataFrame) -> DataFrame:
    """(folder, seq, name, number) of every upload among ``events`` (folder, seq, kind, name); for streams and tables alike."""
    state_store(events.sparkSession)
    slim = events.select("folder", "seq", "kind", "name")
    return slim.groupBy("folder").transformWithStateInPandas(Numbering(), "folder string, seq long, name string, number long", "Append", "None")
