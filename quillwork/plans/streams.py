"""Token streams derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.plans.ship import ship

START, END, FRAME = 5000, 5001, 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame_seq, pos, id): one stream a user, sign-ups and purchases being markers."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    id_ = F.when(kind == "signup", START).when(kind == "purchase", END).otherwise(F.col("event_id") % 1000).cast("long")
    placed = read(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), id_.alias("id"), (F.row_number().over(order) - 1).alias("pos"))
    return placed.select("stream_id", F.floor(F.col("pos") / FRAME).cast("long").alias("frame_seq"), F.col("pos").cast("long").alias("pos"), "id")


def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, pos, id): one stream an order, its part keys in line order."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("id"))


def frames_of(tokens: DataFrame) -> DataFrame:
    """(stream_id, frame_seq, ids, done, finish_reason): the last frame of a stream is done."""
    framed = tokens.groupBy("stream_id", "frame_seq").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("t"))
    last = Window.partitionBy("stream_id")
    framed = framed.select("stream_id", "frame_seq", F.transform("t", lambda x: x["id"]).alias("ids"), (F.col("frame_seq") == F.max("frame_seq").over(last)).alias("done"))
    reason = F.when(F.col("done"), F.when(F.col("stream_id") % 2 == 0, "stop").otherwise("length"))
    return framed.withColumn("finish_reason", reason)


#: The same derivation for the SQL side.
EVENT_TOKENS_SQL = f"""
tok AS (SELECT stream_id, pos // {FRAME} AS frame_seq, pos, id FROM (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CASE event_type WHEN 'signup' THEN {START} WHEN 'purchase' THEN {END} ELSE event_id % 1000 END AS id FROM events)),
frames AS (
  SELECT stream_id, frame_seq, ids, done, CASE WHEN done THEN CASE WHEN stream_id % 2 = 0 THEN 'stop' ELSE 'length' END END AS finish_reason
  FROM (SELECT *, frame_seq = max(frame_seq) OVER (PARTITION BY stream_id) AS done
        FROM (SELECT stream_id, frame_seq, list(id ORDER BY pos) AS ids FROM tok GROUP BY ALL)))"""


def joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
