"""Benchmark decontamination with a positional inverted index.

The training side is indexed by term: a posting is (term, document, position).
For every window of ``width`` consecutive item words, its two rarest terms by
their counts over all training documents are its anchors.  Their posting lists
are intersected after adjusting for the offset: postings of two anchors that
point to the same document and the same start of the item (position minus offset
in the item) meet in one group.  Survivors are verified word for word in the
document, which makes the result exact.  With ``slop`` the rare terms may meet
within that many words, in any order, which gives proximity matches.

Of the index only postings of anchor terms are written: no other list is ever
read.  The benchmark side is broadcast only if its counted rows are few, else the
joins shuffle.  Everything is DataFrame functions.

Null texts and texts without words have no words, match nothing and yield rows
with zeros.  Items without words yield no windows.  Items with fewer words than
``width`` are one window.  Equal rows give equal results each.  Documents are told
apart by a hash of id and text, and verification runs on each row's own words, so
null or repeated ids do no harm.  Other columns are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm.words import MARKS, ascii_lower, between
from quillwork.plans.materialize import broadcast_if_small, materialize, scratch

WIDTH = 10
ANCHORS = 2


def words_of(text: Column) -> Column:
    return F.coalesce(between(ascii_lower(text), MARKS), F.array().cast("array<string>"))


def item_words(items: DataFrame) -> DataFrame:
    """item_id and its words, for items that have words; equal items once."""
    return items.select("item_id", words_of(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).distinct()


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the given terms occurs in docs, 0 where it doesn't."""
    found = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(broadcast_if_small(terms), "term").groupBy("term").count()
    return terms.join(found, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("count"))


def anchors_of(words: DataFrame, counts: DataFrame, width: int, anchors: int = ANCHORS) -> DataFrame:
    """(term, item_id, offset): for each window of each item the offsets of its rarest terms, once an item."""
    placed = words.select("item_id", "item_words", F.posexplode("item_words").alias("offset", "term")).join(counts, "term")
    size = F.size("item_words")
    starts = F.sequence(F.greatest(F.lit(0), F.col("offset") - width + 1), F.least(F.col("offset"), F.greatest(size - width, F.lit(0))))
    in_window = Window.partitionBy("item_id", "item_words", "start").orderBy("count", "term", "offset")
    ranked = placed.select("item_id", "item_words", "offset", "term", "count", F.explode(starts).alias("start")).withColumn(
        "rank", F.row_number().over(in_window)
    )
    return ranked.filter(F.col("rank") <= anchors).select("term", "item_id", "item_words", "offset").distinct()


def postings(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The index: (key, doc_id, pos, item_id, offset) for each posting of an anchor, and a row with a null item a document.

    The position of that last row is the document's number of words, so one pass
    over the texts yields the index and the list of documents.
    """
    end = "\n"  # no word
    words = F.concat(words_of(F.col("text")), F.array(F.lit(end)))
    listed = docs.select("doc_id", row_key().alias("key"), F.posexplode(words).alias("pos", "term"))
    lookup = anchors.select("term", "item_id", "item_words", "offset").unionByName(
        anchors.sparkSession.range(1).select(
            F.lit(end).alias("term"), F.lit(None).cast(anchors.schema["item_id"].dataType).alias("item_id"),
            F.lit(None).cast("array<string>").alias("item_words"), F.lit(None).cast("int").alias("offset"),
        )
    )
    lookup = lookup.withColumn("item", F.when(F.col("item_id").isNotNull() | F.col("item_words").isNotNull(), F.xxhash64("item_id", "item_words")))
    return listed.join(broadcast_if_small(lookup.select("term", "item", "offset")), "term").select("key", "doc_id", "pos", "item", "offset")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(all documents, matches).

    documents: key, doc_id, n_words, a row for each row of docs.
    matches: key, item_id, and starts, the positions in the document of each window
    found.  With slop: the positions from which all terms of a window occur within
    width + slop words.
    """
    items_ = materialize(item_words(items).withColumn("item", F.xxhash64("item_id", "item_words")), "bench-items")
    terms = items_.select(F.explode("item_words").alias("term")).distinct()
    counts = materialize(term_counts(docs, terms), "bench-counts")
    anchors = materialize(anchors_of(items_, counts, width), "bench-anchors")
    index = materialize(postings(docs, anchors), "bench-postings")
    listed = index.filter("item is null").select("key", "doc_id", F.col("pos").cast("long").alias("n_words"))

    lists = index.filter("item is not null")
    shift = F.col("pos") - F.col("offset")
    if slop:
        # Any order within the span: hits a span apart at most fall into the same or neighbouring cells.
        span = width + slop
        cell = F.floor(F.col("pos") / span).cast("int")
        meet = lists.select("key", "item", "offset", F.explode(F.array(cell, cell + 1)).alias("at")).distinct()
    else:
        meet = lists.select("key", "item", "offset", shift.alias("at"))
    met = meet.groupBy("key", "item", "at").agg(F.count_distinct("offset").alias("n"))
    # Items carry whole texts, so they are joined by shuffling unless Spark knows them to be small.
    found = met.join(items_, "item")
    found = found.filter(F.col("n") >= F.least(F.lit(ANCHORS), F.size("item_words")))
    found = materialize(found.select("key", "item", "item_id", "item_words", "at").distinct(), "bench-candidates")

    texts = docs.select(row_key().alias("key"), "text").join(broadcast_if_small(found.select("key").distinct()), "key", "left_semi")
    texts = texts.dropDuplicates(["key"]).select("key", words_of(F.col("text")).alias("words"))
    joined = texts.join(found, "key")
    last = F.greatest(F.size("item_words") - width, F.lit(0))
    w = F.least(F.size("item_words"), F.lit(width))
    windows = F.sequence(F.lit(0), last)
    if slop:
        span_ = F.lit(width + slop)
        spots = F.sequence(F.greatest(F.lit(0), (F.col("at") - 1) * span_), F.least(F.size("words") - 1, (F.col("at") + 1) * span_))

        def near(s: Column) -> Column:
            here = F.slice("words", s + 1, span_)
            return F.exists(windows, lambda o: F.size(F.array_except(F.slice("item_words", o + 1, w), here)) == 0)

        starts = F.filter(spots, near)
    else:

        def same(o: Column) -> Column:
            at = F.col("at") + o
            here = F.when(at >= 0, F.slice("words", F.greatest(at, F.lit(0)) + 1, w)).otherwise(F.array().cast("array<string>"))
            return here == F.slice("item_words", o + 1, w)

        starts = F.transform(F.filter(windows, same), lambda o: F.col("at") + o)
    hits = joined.select("key", "item_id", w.alias("width"), starts.alias("starts")).filter(F.size("starts") > 0)
    return listed, hits


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    listed, hits = matches(docs, items, width)
    hits = materialize(hits, "bench-hits")
    covered = hits.select("key", F.explode("starts").alias("start"), "width").distinct()
    words = covered.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("pos")).distinct()
    n_hit = words.groupBy("key").agg(F.count("*").alias("n_hit"))
    # One entry an item of the benchmark at most, so the list is bounded by the benchmark.
    names = hits.select("key", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    listed_items = names.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = n_hit.join(listed_items, "key")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return listed.join(found, "key", "left").select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_col).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_col, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    with scratch(docs.sparkSession) as keep:
        _, hits = matches(docs, items, width)
        bad = keep(materialize(hits.select("key").distinct(), "bench-bad"))
    bad = broadcast_if_small(bad)  # keys of contaminated documents only, counted before
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), row_key().alias("key"))
    return keyed.join(bad, "key", "left_anti").select("_doc.*")
