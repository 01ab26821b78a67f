"""Planning concepts as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.sources.shared import dealt, numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    """Microseconds of a time without zone, as if it were UTC; whatever the session's zone is."""
    # the cast reads the wall clock in the session's zone; this reads it in UTC
    return F.unix_micros(F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, t0, total): users as assets, their span in seconds."""
    e = table(spark, sf_dir, "events").select("user_id", micros().alias("us"))
    return e.groupBy(F.col("user_id").alias("asset_id")).agg(F.min("us").alias("t0"), ((F.max("us") - F.min("us")) / F.lit(1e6)).alias("total"))


def markers(spark: SparkSession, sf_dir: str, event_type: str = "purchase") -> DataFrame:
    """(asset_id, pos, sec, total): a user's events of one type as markers, in order of time."""
    events = table(spark, sf_dir, "events")
    e = events.where(F.col("event_type") == event_type).select(F.col("user_id").alias("asset_id"), "ts", "event_id", micros().alias("us"))
    e, spans = dealt("asset_id", events.count(), e, assets(spark, sf_dir))
    pos = F.row_number().over(Window.partitionBy("asset_id").orderBy("ts", "event_id")) - 1
    return e.join(spans, "asset_id").select("asset_id", pos.cast("long").alias("pos"), ((F.col("us") - F.col("t0")) / F.lit(1e6)).alias("sec"), "total")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, channel, sample_idx, value): a user's event values in order of time, as one channel."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), "ts", "event_id", "value")
    i = F.row_number().over(Window.partitionBy("asset_id").orderBy("ts", "event_id")) - 1
    return e.select("asset_id", F.lit(0).alias("channel"), i.cast("long").alias("sample_idx"), "value")


def timeline_rows(spark: SparkSession, sf_dir: str, seconds: float = 2.5) -> DataFrame:
    """(scene_idx, seq, start_s, end_s, prompt): turns of a conversation as prompts, one after the other."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("scene_idx"), F.col("turn").alias("seq"), (F.col("turn") * seconds).alias("start_s"), ((F.col("turn") + 1) * seconds).alias("end_s"), F.col("text").alias("prompt"))


def order_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, pos, length): quantities of an order's lines as pixel lengths."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("length"))
    pos = F.row_number().over(Window.partitionBy("group_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return li.select("group_id", pos.cast("long").alias("pos"), "length")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, frame_idx, vec_id, value): embeddings of a label as a sequence of frames."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq_id"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("value"))
    # a few labels hold all rows
    return numbered(e, ["seq_id", "vec_id"], "frame_idx", within="seq_id").select("seq_id", "frame_idx", "vec_id", "value")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, name): parts as media files: a folder for each brand, a number and an extension from the key and size."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*(F.lit(x) for x in (".png", ".WAV", ".mp4", ".txt", ".jpg", ".mp3"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("folder"), F.concat(F.format_string("%03d_", F.col("p_partkey") % 97), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), ext).alias("name"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w, h): part sizes and prices as picture sizes."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 37 + 41).cast("long").alias("w"), (F.floor("p_retailprice") + 17).cast("long").alias("h"))
