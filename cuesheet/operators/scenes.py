"""Loosely typed JSON tables, and lookups by position.

JSON is read as a variant, so rows may be arrays or bare strings; what is no
JSON array has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cuesheet.functions.scalars import affixed


def exploded(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """(keys, pos, value): the elements of a JSON array as variants."""
    v = F.try_parse_json(F.col(json_col))
    kept = df.select(*keys, v.alias("_v")).where(F.expr("schema_of_variant(_v) like 'ARRAY%'"))
    return kept.select(*keys, F.expr("variant_get(_v, '$', 'array<variant>')").alias("_a")).select(*keys, F.posexplode("_a").alias("pos", "value"))


def _get(path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(value, '{path}', '{kind}')")


def _is_text() -> Column:
    return F.expr("schema_of_variant(value) = 'STRING'")


def parse_prompts(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """(keys, seq, prompt) from an array of strings; seq is from 1."""
    return exploded(df, json_col, *keys).select(*keys, (F.col("pos") + 1).cast("long").alias("seq"), F.coalesce(_get("$", "string"), F.lit("")).alias("prompt"))


def parse_scenes_v1(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """Rows of [duration, prompt, audio_idx, image_idx, tail_pos, transition], or just a prompt."""
    rows = exploded(df, json_col, *keys)
    pick = lambda path, kind, default: F.coalesce(F.when(~_is_text(), _get(path, kind)), F.lit(default))
    return rows.select(
        *keys,
        (F.col("pos") + 1).cast("long").alias("seq"),
        pick("$[0]", "double", 5.0).alias("duration"),
        F.when(_is_text(), _get("$", "string")).otherwise(F.coalesce(_get("$[1]", "string"), F.lit(""))).alias("prompt"),
        pick("$[2]", "bigint", 0).alias("audio_idx"),
        pick("$[3]", "bigint", -1).alias("image_idx"),
        pick("$[4]", "bigint", -1).alias("tail_pos"),
        pick("$[5]", "bigint", 1).alias("transition"),
    )


#: How text may spell a whole number and any other one, as far as letters and digits go.
WHOLE = r"^[+-]?[0-9]+(_[0-9]+)*$"
NUMBER = r"(?i)^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)$"


def _cell(n: int, kind: str) -> tuple[Column, Column, Column]:
    """(value, empty, missing) of element ``n`` of a row: what it converts to, whether it counts as false, and whether it is absent or null."""
    raw = F.expr(f"try_variant_get(value, '$[{n}]', 'variant')")
    text, shape = _get(f"$[{n}]", "string"), F.schema_of_variant(raw)
    missing = F.coalesce(shape == "VOID", F.lit(True))
    spelled = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    plain = F.replace(spelled, F.lit("_"), F.lit(""))
    nested = shape.startswith("ARRAY") | shape.startswith("OBJECT")
    amount = text.try_cast("double")
    empty = (
        F.when(missing, True)
        .when(shape == "STRING", text == "")
        .when(shape == "BOOLEAN", text == "false")
        .when(nested, F.to_json(raw).isin("[]", "{}"))
        .otherwise(F.coalesce(amount == 0, F.lit(False)))
    )
    if kind == "string":
        value = F.when(nested, F.to_json(raw)).otherwise(text)
    elif kind == "bigint":
        # a number loses its fraction, but text has to spell a whole one
        whole = F.when(shape == "BIGINT", _get(f"$[{n}]", "bigint")).otherwise(F.when(F.abs(amount) < 2.0**63, amount.cast("long")))
        value = F.when(shape == "STRING", F.when(spelled.rlike(WHOLE), plain.try_cast("long"))).when(shape == "BOOLEAN", (text == "true").cast("long")).when(~nested, whole)
    else:
        value = F.when(shape == "STRING", F.when(spelled.rlike(NUMBER), plain.try_cast("double"))).when(shape == "BOOLEAN", (text == "true").cast("double")).when(~nested, amount)
    return value, empty, missing


def parse_scenes_v2(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """Rows of [audio_duration, prompt, audio_idx, audio_start, image_idx, tail_pos, transition], or just a prompt.

    Empty cells (null, "", 0, false, [] and {}) have the default, and reading
    goes on; as transition only null has. Numbers may be spelled as text: "0" is
    no empty cell. From the first cell on that can't be converted, all have
    their defaults; so have rows that are neither arrays nor text. Whole numbers
    beyond 64 bits can't be converted.
    """
    rows = exploded(df, json_col, *keys)
    fields = [("audio_duration", "double", 15.0), ("prompt", "string", ""), ("audio_idx", "bigint", 0), ("audio_start", "double", 0.0), ("image_idx", "bigint", -1), ("tail_pos", "bigint", -1), ("transition", "bigint", 1)]
    ok, cols = F.expr("schema_of_variant(value) like 'ARRAY%'"), []
    for n, (name, kind, default) in enumerate(fields):
        got, empty, missing = _cell(n, kind)
        skip = missing if name == "transition" else empty
        ok = ok & (skip | got.isNotNull())
        value = F.when(ok & ~skip, got).otherwise(F.lit(default).cast(kind))
        cols.append((F.when(_is_text(), _get("$", "string")).otherwise(value) if name == "prompt" else value).alias(name))
    return rows.select(*keys, (F.col("pos") + 1).cast("long").alias("seq"), *cols)


#: The fields of a timeline's rows, as they are called in JSON.
TIMELINE_FIELDS = {"row_idx": "索引编号", "start_s": "开始时间", "end_s": "结束时间", "prompt": "提示词文本"}


def parse_timeline(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """(keys, seq, row_idx, start_s, end_s, prompt) from an array of objects; seq is from 1.

    Absent fields have their defaults; from the first field that is no number
    on, so have all that follow. Elements that are no objects have defaults only.
    """
    rows = exploded(df, json_col, *keys)
    ok, cols = F.expr("schema_of_variant(value) like 'OBJECT%'"), []
    for (name, field), default in zip(TIMELINE_FIELDS.items(), (0, 0.0, 15.0, ""), strict=True):
        raw = F.expr(f"""try_variant_get(value, '$["{field}"]', 'variant')""")
        text = F.expr(f"""try_variant_get(value, '$["{field}"]', 'string')""")
        kind = F.schema_of_variant(raw)
        if name == "prompt":
            got = F.coalesce(text, F.lit(""))
        else:
            spelled = F.trim(text)
            is_number = spelled.rlike(r"^[+-]?[0-9]+$") if name == "row_idx" else spelled.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$")
            number = F.when(kind == "STRING", F.when(is_number, spelled.try_cast("double"))).when(kind == "BOOLEAN", (text == "true").cast("double")).otherwise(text.try_cast("double"))
            got = number.cast("long") if name == "row_idx" else number
            # a field that is there has to be a number, and null is none
            ok = ok & (raw.isNull() | got.isNotNull())
            got = F.coalesce(got, F.lit(default))
        cols.append(F.when(ok, got).otherwise(F.lit(default)).alias(name))
    return rows.select(*keys, (F.col("pos") + 1).cast("long").alias("seq"), *cols)


def _keyframes(json: Column) -> tuple[Column, Column]:
    """(list, shape): the variant that should be a list of seconds, and what it is; null without one in an object."""
    v = F.try_parse_json(json)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    found = F.when(is_object, F.try_variant_get(v, "$.keyframes", "variant")).otherwise(v)
    return found, F.schema_of_variant(found)


def _seconds(value: Column) -> Column:
    """Numbers, true and false, and numbers spelled as text, as seconds; null for anything else."""
    text = F.try_variant_get(value, "$", "string")
    shape = F.schema_of_variant(value)
    spelled = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    number = F.when(spelled.rlike(NUMBER), F.replace(spelled, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(shape == "STRING", number).when(shape == "BOOLEAN", (text == "true").cast("double")).otherwise(F.try_variant_get(value, "$", "double"))


def keyframe_problem(json: Column) -> Column:
    """Why a text has no list of seconds; null if it has one, is empty, or is an object without ``keyframes``."""
    found, shape = _keyframes(json)
    listed = F.try_variant_get(found, "$", "array<variant>")
    bad = F.exists(F.transform(listed, _seconds), lambda x: x.isNull())
    empty = F.trim(F.coalesce(json, F.lit(""))) == ""
    no_list = (shape.isNotNull() & ~shape.startswith("ARRAY")) | (shape == "VOID")
    return (
        F.when(empty, F.lit(None).cast("string"))
        .when(F.try_parse_json(json).isNull(), "the keyframes are no JSON")
        .when(no_list, "the keyframes are no list")
        .when(bad, "a keyframe is no number")
    )


def parse_keyframes(df: DataFrame, json_col: str, *keys: str, strict: bool = True) -> DataFrame:
    """(keys, pos, sec) from an array of seconds, or the ``keyframes`` of an object; not below 0.

    What ``keyframe_problem`` names is an error; without ``strict``, lists that
    can't be read are empty, and elements that are no numbers are left out. Empty text has no keyframes.
    Where rows have been checked and filtered before, read without ``strict``: Spark may evaluate the error before the filter.
    """
    found, _ = _keyframes(F.col(json_col))
    listed = F.transform(F.try_variant_get(found, "$", "array<variant>"), _seconds)
    if strict:
        problem = keyframe_problem(F.col(json_col))
        listed = F.when(problem.isNotNull(), F.raise_error(problem).cast("array<double>")).otherwise(listed)
    both = df.select(*keys, listed.alias("_a"))
    return both.select(*keys, F.posexplode("_a").alias("pos", "sec")).where("sec is not null").select(*keys, F.col("pos").cast("long").alias("pos"), F.greatest("sec", F.lit(0.0)).alias("sec"))


def input_problem(file: Column, found: Column, keyframes: Column) -> Column:
    """What is wrong with a run's inputs before it begins; null where nothing is. No file and no keyframes are fine."""
    return F.when((F.coalesce(file, F.lit("")) != "") & ~found, "the file is not found").otherwise(keyframe_problem(keyframes))


def reduced(row: Column, reuse: Column) -> Column:
    """The row that is looked up where rows are used again every ``reuse``."""
    return F.when(reuse > 1, F.pmod(row, reuse)).when(reuse == 1, F.lit(0).cast("long")).otherwise(row)


def lookup_row(wanted: DataFrame, rows: DataFrame, defaults: dict[str, object], keys: tuple[str, ...] = (), pos: str = "pos") -> DataFrame:
    """Each wanted (keys, i) with the columns of the row at that position, or ``defaults``."""
    cond = F.col("w.i") == F.col(f"r.{pos}")
    for k in keys:
        cond &= F.col(f"w.{k}") == F.col(f"r.{k}")
    joined = wanted.alias("w").join(rows.alias("r"), cond, "left")
    return joined.select("w.*", *(F.coalesce(F.col(f"r.{c}"), F.lit(d)).alias(c) for c, d in defaults.items()), F.col(f"r.{pos}").isNotNull().alias("found"))


def or_own(index: Column, row: Column) -> Column:
    """An index below 0 is the row's own."""
    return F.when(index < 0, row).otherwise(index)


def wrap_lookup(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Each wanted i with the file at ``i`` modulo the number of files (numbered ``pos`` from 0)."""
    at = wanted.withColumn("n_files", files.agg(F.count("*")).scalar()).withColumn("at", F.pmod("i", "n_files"))
    return at.join(files.withColumnRenamed("pos", "at"), "at")


def strict_lookup(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Each wanted i with the file at that position; an index out of range is an error."""
    ok = (F.col("i") >= 0) & (F.col("i") < F.col("n_files"))
    at = wanted.withColumn("n_files", files.agg(F.count("*")).scalar()).withColumn("at", F.when(ok, F.col("i")).otherwise(F.raise_error(F.lit("index out of range")).cast("long")))
    return at.join(files.withColumnRenamed("pos", "at"), "at")


def move_row(rows: DataFrame, item: int, step: int, group: str = "group_id", pos: str = "pos") -> DataFrame:
    """Row ``item`` of each group swapped with its neighbour, if it has one there."""
    n = F.count("*").over(Window.partitionBy(group))
    fits = (F.lit(item) >= 0) & (F.lit(item) < n) & (F.lit(item + step) >= 0) & (F.lit(item + step) < n)
    p = F.col(pos)
    return rows.withColumn(pos, F.when(fits & (p == item), p + step).when(fits & (p == item + step), p - step).otherwise(p))


def delete_row(rows: DataFrame, item: int, group: str = "group_id", pos: str = "pos") -> DataFrame:
    """Without row ``item`` of each group, numbered anew; a group's only row stays."""
    n = F.count("*").over(Window.partitionBy(group))
    kept = rows.withColumn("_n", n).where((F.col(pos) != item) | (F.col("_n") <= 1)).drop("_n")
    return kept.withColumn(pos, (F.row_number().over(Window.partitionBy(group).orderBy(pos)) - 1).cast("long"))


def with_affixes(df: DataFrame, prefix: str, suffix: str, text: str = "prompt") -> DataFrame:
    return df.withColumn(text, affixed(F.lit(prefix), F.col(text), F.lit(suffix)))


def replay(rows: DataFrame, log: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, pos, item): the ``rows`` (group, pos, item) of each group after all edits of its ``log`` (group, seq, op, item, step).

    In order of ``seq``: ``move`` swaps an item with its neighbour before it
    (step -1) or behind it (1), if there is one; ``delete`` takes an item out, but a group's last one stays;
    ``insert`` puts a new item at the end. An edit of an item that isn't
    there, or an insert of one that is, does nothing. Items of a group are
    distinct, and nothing else of a row takes part: join the rest by item.

    Edits depend on those before, so a group is replayed in one go: its items
    as a chain in which every edit changes a few links, whatever the length. Rows come sorted, so a task holds one group's items, and streams its edits.
    """
    kind = rows.schema["item"].dataType
    start = rows.select(group, F.lit(0).alias("_kind"), F.col("pos").cast("long").alias("_at"), F.lit("insert").alias("op"), F.col("item").cast(kind), F.lit(0).alias("step"))
    edits = log.select(group, F.lit(1).alias("_kind"), F.col("seq").cast("long").alias("_at"), "op", F.col("item").cast(kind), F.col("step").cast("int"))
    ordered = start.unionByName(edits).repartition(group).sortWithinPartitions(group, "_kind", "_at").select(group, "op", "item", "step")
    fields = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInArrow(_replay(group, ordered.schema), f"{group} {fields[group]}, pos long, item {fields['item']}")


def _replay(group: str, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, here = Chain(), None

        def give() -> Iterator[pa.RecordBatch]:
            items = list(chain)
            if items:
                yield pa.RecordBatch.from_arrays([pa.array([here[0]] * len(items), types[group]), pa.array(range(len(items)), pa.int64()), pa.array(items, types["item"])], [group, "pos", "item"])

        for batch in batches:
            for g, op, item, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (g,):
                    if here:
                        yield from give()
                    chain, here = Chain(), (g,)
                chain.edit(op, item, step)
        if here:
            yield from give()

    return run


class Chain:
    """Distinct items in an order, as links; the class itself stands before the first and behind the last one."""

    def __init__(self) -> None:
        self.after: dict[object, object] = {Chain: Chain}
        self.before: dict[object, object] = {Chain: Chain}

    def __iter__(self) -> Iterator[object]:
        item = self.after[Chain]
        while item is not Chain:
            yield item
            item = self.after[item]

    def _join(self, *items: object) -> None:
        for a, b in zip(items, items[1:], strict=False):
            self.after[a], self.before[b] = b, a

    def edit(self, op: str, item: object, step: int | None) -> None:
        there = item in self.after
        if op == "insert" and not there:
            self._join(self.before[Chain], item, Chain)
        elif op == "delete" and there and len(self.after) > 2:
            self._join(self.before.pop(item), self.after.pop(item))
        elif op == "move" and there and step in (-1, 1):
            a = item if step == 1 else self.before[item]
            b = self.after[a]
            if a is not Chain and b is not Chain:
                self._join(self.before[a], b, a, self.after[b])
