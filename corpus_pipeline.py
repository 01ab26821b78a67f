"""The corpus pipeline: five stages from raw documents to a mixed training order.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; all
but the last return the columns of ``documents``, the last adds the mixing
slot and order. Stage outputs are written as tables in the shared folder and
read again, so a stage works on exactly what the one before it kept.

A stage's result reads the intermediate tables of its operator. It has to be
written before the next stage is called: that stage then begins by removing
those tables, unless its ``docs`` still read one of them. So the disk holds
the intermediate tables of one stage at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from cuesheet.llm.common import cut, discard, table
from cuesheet.sources.shared import recording, remove

#: Documents without letters, or with a smaller share of 4-grams in any learned language, are rejected.
MIN_LANGUAGE_SCORE = 0.2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Application -> the tables of its last stage.
_LEFT: dict[str, list[str]] = {}


def one_at_a_time(stage: Stage) -> Stage:
    """``stage``, beginning with the removal of the last one's tables."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        if left:
            files = docs.inputFiles()
            read = [path for path in left if any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files)]
            if not read:
                remove(spark, left)
                left.clear()
        with recording() as made:
            out = stage(spark, docs, sf_dir)
        left += made
        return out

    return run_stage


@one_at_a_time
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return language_id.keep_identified(docs, MIN_LANGUAGE_SCORE)


@one_at_a_time
def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out


@one_at_a_time
def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return near_dedup.keep_one(docs)


@one_at_a_time
def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@one_at_a_time
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_documents),
    ("decontaminate", decontaminate_documents),
    ("mixing", mix_sources),
]

#: Language prediction, components of near copies and the schedule are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
