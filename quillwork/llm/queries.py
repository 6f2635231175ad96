"""The registered queries of this package: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import chat, decontaminate, jaccard, mixing, quality, sharding, suffixes, topk, toxicity, warc
from quillwork.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
#: Characters of a conversation up to which it is written as JSON.
JSON_CHARS = 1_000_000


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.score(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    told = chat.turns_of_table(rows)
    # Conversations become records of two layouts, in turn, and are read by their fingerprints.  JSON readers bound the
    # length of a text, so very long conversations stay in the table's layout, as do those that use the other layout's names for roles.
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"]))
    plain = F.exists("turns", lambda t: t["role"].isin("human", "gpt")) | (size > JSON_CHARS)
    record = F.when(plain, None).when(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0, chat.as_messages(F.col("turns"))).otherwise(chat.as_conversations(F.col("turns")))
    told = told.select("conv_id", F.when(plain, F.col("turns")).alias("own"), record.alias("record"))
    turns = F.coalesce("own", chat.turns_of_json(F.col("record")))
    made = told.select("conv_id", chat.render(turns).alias("r"))
    made = made.select("conv_id", "r.formatted", "r.loss")
    back = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), keep=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_warc": op2_warc,
        "op3_jaccard": op3_jaccard,
        "op4_decontamination": op4_decontamination,
        "op5_topk": op5_topk,
        "op6_suffix_tree": op6_suffix_tree,
        "op7_toxicity": op7_toxicity,
        "op8_chat": op8_chat,
        "op9_sharding": op9_sharding,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    from quillwork.llm import sql

    return sql.ORACLES
