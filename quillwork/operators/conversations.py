"""Checks of conversations: opening runs of example pairs, role claims, prefills, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.operators.safety import rules as R

THRESHOLD, LONGEST = 5, 200


def many_shot(messages: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(conv_id, pairs, suspicious): user and assistant pairs at the start, after leading system turns.

    Only running positions and minima by conversation are needed, no list of turns.
    """
    upto = Window.partitionBy("conv_id").orderBy("turn", "role")
    led = messages.select("conv_id", "turn", "role", F.sum((F.col("role") != "system").cast("int")).over(upto).alias("seen"))
    rest = led.filter("seen > 0").withColumn("k", F.row_number().over(upto))
    expected = F.when(F.col("k") % 2 == 1, "user").otherwise("assistant")
    first_bad = F.min(F.when(~F.col("role").eqNullSafe(expected), F.col("k")))
    runs = rest.groupBy("conv_id").agg((F.coalesce(first_bad, F.count("*") + 1) - 1).alias("n"))
    counted = messages.select("conv_id").distinct().join(runs, "conv_id", "left").select("conv_id", F.floor(F.coalesce("n", F.lit(0)) / 2).alias("pairs"))
    return counted.withColumn("suspicious", F.col("pairs") >= threshold)


def role_claims(content: Column) -> Column:
    """First match of each role-claim pattern."""
    found = F.array(*[F.when(content.rlike(R.java(p)), F.regexp_extract(content, R.java(p), 0)) for p in R.ROLE_CLAIMS])
    return F.filter(found, lambda x: x.isNotNull())


def prefill(text: Column, from_user: Column) -> Column:
    """struct(ok, reason)."""
    claims = role_claims(text)
    reason = F.when(from_user, "user-influenced prefill content is forbidden: assistant_prefill must be application-controlled").when(
        F.size(claims) > 0, F.concat(F.lit("prefill contains role-claim pattern: "), F.array_join(claims, ", "))
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def lengths(messages: DataFrame, longest: int = LONGEST) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages")).withColumn("within", F.col("n_messages") <= longest)
