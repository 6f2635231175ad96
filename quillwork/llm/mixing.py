"""Mixing sources to target weights.

Every document gets a hash-random key; documents are sorted by key within their
source, running sums of sizes (in words) are computed over that order without
any task seeing a whole source, and each source is cut where its budget of words
ends.  A source whose target is above its size is repeated: whole epochs first,
then the cut in the next one.

Shares: sources in code-point order, null last, take the weights in turn.  Each
gets its weight's share of the total; a share above ``max_epochs`` times the
source's size stops there and the excess is shared by weight among the others,
until none is above.  That fixed point is found in one pass over the sources in
order of (cap / weight): those with the lowest ratios are the capped ones.

Null and empty texts have size 0 and are never taken.  A null source is a source
of its own, the last.  Documents without an id are keyed by their text.  Equal
rows are separate documents, counted together until they are returned, so that no
task holds a large group of them.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm.rows import expanded
from quillwork.llm.words import spaced_count
from quillwork.plans.materialize import broadcast_if_small, materialize, scratch
from quillwork.plans.ranks import bucket_of, running

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1:"
ROWS_PER_BUCKET = 4096


def shares(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds weight and target to sources(source, source_size); one row a source.

    The windows run over sources, of which there are few, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    state = weighed.withColumns(
        {
            "_cap": cap,
            "_left": F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)),
            "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        }
    ).withColumn("_capped", F.col("weight") * F.col("_left") > F.col("_cap") * F.col("_weights"))
    # Sources after the first that isn't capped share what is left by then.
    first = F.min(F.when(~F.col("_capped"), F.struct(cap / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("_left"), F.col("_weights")))).over(everything)
    done = state.withColumn("_first", first)
    level = F.col("weight") * F.col("_first._left") / F.col("_first._weights")
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(level, F.col("_cap")))
    return done.select("source", "source_size", F.col("weight").cast("int").alias("weight"), target.alias("target"))


#: What orders the documents of a source: the hash-random key first, the others for rows whose keys are equal.
ORDER = ["key", "doc_id", "size", "tie"]


def order_columns(seed: str) -> list[Column]:
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))).cast("binary"))
    return [key.alias("key"), F.col("doc_id"), spaced_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")]


def planned(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str, rows_per_bucket: int) -> DataFrame:
    """A row for equal documents of a source: copies of them, before (words of earlier ones), and the source's epochs and rest.

    rest: words that the mix takes beyond whole epochs.  Texts don't move.
    """
    alike = docs.select("source", *order_columns(seed)).groupBy("source", *ORDER).agg(F.count("*").alias("copies"))
    alike = materialize(alike, "mix-sizes")
    totals = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("_rows"))
    totals = materialize(totals, "mix-sources")
    plan = shares(totals.select("source", "source_size"), weights, max_epochs).join(
        totals.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))
    )
    plan = materialize(plan.drop("source"), "mix-shares")
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    # One row a source, counted before it is broadcast.
    joined = alike.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_bucket", bucket_of(unit, F.col("_rows"), rows_per_bucket)
    )
    summed = running(joined, ["source"], "_bucket", [F.col(c) for c in ORDER], F.col("size") * F.col("copies"), "before")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return summed.withColumns({"epochs": whole, "rest": budget - whole * F.col("source_size")})


def cuts_of(rows: DataFrame) -> DataFrame:
    """A row a source of planned() rows: its epochs, and the last documents that begin before its cut."""
    # Of equal documents, those that begin before the cut.
    begun = F.least(F.col("copies"), F.ceil((F.col("rest") - F.col("before")) / F.col("size")).cast("long"))
    begun = F.when((F.col("size") > 0) & (F.col("rest") > F.col("before")), begun)
    cut = F.max(F.when(begun.isNotNull(), F.struct(*ORDER, begun.alias("begun"), "copies")))
    cuts = rows.groupBy("source").agg(F.max("epochs").alias("_epochs"), cut.alias("_cut"))
    return materialize(cuts.withColumnRenamed("source", "_s"), "mix-cuts")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target, taken, epochs and the columns behind them.

    taken counts words over all epochs and adds up to each source's rounded target
    exactly, as the document that the cut falls in counts in part.
    """
    each = expanded(planned(docs, weights, max_epochs, seed, rows_per_bucket), F.col("copies"), "_nth")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("_nth") * F.col("size")))
    out = each.withColumn("part", part.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "weight", "epochs", "part", "key")


def compose(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The mix itself: each document as often as mix() takes it, whole.

    A document that is taken in part is there whole: documents are atomic here, so a
    source exceeds its target by less than one document.  Documents without words
    have nothing to weigh and stay once.  All that a row needs to know is where its
    source's cut lies, a row a source, so texts are not shuffled.
    """
    with scratch(docs.sparkSession) as keep:
        cuts = keep(cuts_of(planned(docs, weights, max_epochs, seed, rows_per_bucket)))
    placed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("source").alias("_source"), F.struct(*order_columns(seed)).alias("_at"))
    # A row a source, counted before it is broadcast.
    told = placed.join(broadcast_if_small(cuts), F.col("_source").eqNullSafe(F.col("_s")))
    last = F.struct(*[F.col(f"_cut.{c}").alias(c) for c in ORDER])
    is_last = F.col("_cut").isNotNull() & F.col("_at").eqNullSafe(last)
    split = F.col("_cut.begun") < F.col("_cut.copies")
    more = F.when(F.col("_cut").isNotNull() & ((F.col("_at") < last) | (is_last & ~split)), 1).otherwise(0)
    times = F.when(F.col("_at.size") == 0, 1).otherwise(F.col("_epochs") + more)
    out = told.withColumn("_times", times.cast("int")).filter("_times > 0")
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
    if cuts.filter(split).limit(1).count():  # equal documents on both sides of a cut
        one = told.filter(is_last & split).groupBy("_source").agg(F.first("_doc").alias("_doc"), F.first("_cut.begun").alias("_begun"))
        out = out.unionByName(expanded(one, F.col("_begun"), "_n").select("_doc.*"))
    return out
