"""Grouped prefix join on word shingles by Jaccard similarity.

Two documents link when 100 * |intersection| >= percent * |union| of their sets of
distinct shingles; linked documents are put into components.

1. Each text becomes a set of 64-bit shingle hashes.  Equal sets are one from here
   on.  Shingles in the lowest part of the hash space are counted over the whole
   corpus: a set with so many shingles that no other set holds that its prefix is
   full of them can't reach the similarity with any other and is done.
2. The rest are candidates, which a second count among them over more of the hash
   space thins out.  Over what is left all shingles are counted, which orders
   shingles from rare to frequent.  The prefix of a set is its first
   n - ceil(t n) + 1 shingles in that order; shingles that only one candidate holds
   take places in it but can't match.
3. Sets with the same size and the same prefix form a group.  Group pairs that
   share a prefix shingle are filtered by size and by position.
4. Pairs are expanded to members and verified on the whole sets.

Large clusters of near copies would still give a square of pairs in step 4.  So
pairs are first made with one hub for each prefix shingle, the group with the
earliest position there, and of each group's members with its first; components
of what links are formed, and only then all pairs follow whose components differ.
No link between components is lost, as pairs left out have one component already.

Null and empty texts and texts without words have empty sets and link with
nothing.  Equal rows and texts link.  A component's id is its smallest document
id, null if none of its rows has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.components import components
from quillwork.llm.shingles import row_key, with_sets
from quillwork.plans.materialize import broadcast_if_small, discard, materialize, release, scratch

WIDTH, PERCENT = 3, 90
#: Hub rounds before all remaining pairs are made; any number gives the same result.
HUB_ROUNDS = 2


def ceil_div(a: Column, b: int | Column) -> Column:
    """Whole-number ceiling, for positive values."""
    return F.floor((a + b - 1) / b).cast("int")


def prefix_length(n: Column, percent: int) -> Column:
    return n - ceil_div(n * percent, 100) + 1


def alone(tokens: DataFrame) -> DataFrame:
    """(sid, alone): how many of a set's tokens (sid, h) no other set holds; sets without any are left out."""
    single = tokens.groupBy("h").agg(F.min("sid").alias("sid"), F.max("sid").alias("other")).filter("sid = other")
    return single.groupBy("sid").agg(F.count("*").alias("alone"))


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, rep, row) of the distinct sets that may reach the similarity with another set."""
    single = alone(sets.select("sid", F.explode("low").alias("h")))
    distinct = sets.filter("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), F.min("key").alias("row"))
    return distinct.join(single, "sid", "left").filter(F.coalesce("alone", F.lit(0)) < prefix_length(F.col("n"), percent)).select("sid", "n", "rep", "row")


def still_alive(full: DataFrame, percent: int, share: float) -> DataFrame:
    """Rows of full(sid, n, low) that a second count, among candidates and over a larger part of the hash space, leaves."""
    # Hashes are unsigned, so the sign bit is turned before they are compared.
    limit = min(int(share * 2**64) - 2**63, 2**63 - 1)
    part = F.filter("low", lambda h: h.bitwiseXOR(F.lit(-(2**63))) <= F.lit(limit))
    single = alone(full.select("sid", F.explode(part).alias("h")))
    gone = single.join(full.select("sid", "n"), "sid").filter(F.col("alone") >= prefix_length(F.col("n"), percent)).select("sid")
    return full.join(gone, "sid", "left_anti")


def prefixes(full: DataFrame, percent: int) -> DataFrame:
    """(sid, n, alone, prefix) from (sid, n, low with the whole set): rarest shared shingles, after `alone` places."""
    tokens = full.select("sid", F.explode("low").alias("h"))
    counts = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(counts, "h").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
    joined = full.select("sid", "n").join(shared, "sid").withColumn("alone", F.col("n") - F.size("shared"))
    room = prefix_length(F.col("n"), percent) - F.col("alone")
    return joined.filter(room > 0).select("sid", "n", "alone", F.transform(F.slice("shared", 1, room), lambda s: s["h"]).alias("prefix"))


def verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that reach the similarity, on whole sets."""
    left = full.select(F.col("sid").alias("a"), F.col("low").alias("set_a"))
    right = full.select(F.col("sid").alias("b"), F.col("low").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    linked = common.cast("long") * 100 >= F.lit(percent).cast("long") * (F.size("set_a") + F.size("set_b") - common)
    return both.filter(linked).select("a", "b")


def passes(percent: int) -> Column:
    """Size and position filters for entries x and y of one shingle (columns n, pos and n2, pos2)."""
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    need = ceil_div((F.col("n") + F.col("n2")) * percent, 100 + percent)
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    # The smaller set of a pair is found by its shorter index prefix.
    index = F.when(F.col("n") <= F.col("n2"), F.col("pos")).otherwise(F.col("pos2")) < small - ceil_div(small * (2 * percent), 100 + percent) + 1
    either = F.when(F.col("n") == F.col("n2"), F.lit(True)).otherwise(index)
    return (small * 100 >= large * percent) & (rest >= need) & either


def links(full: DataFrame, percent: int, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """(node, component) over the sids of full (sid, n, low with the whole set)."""
    spark = full.sparkSession
    entries = materialize(prefixes(full, percent), "jaccard-prefixes")
    release(spark)
    # Sets with shingles of their own in the prefix can't have the prefix of another set.
    alike = [F.col("n"), F.col("prefix"), F.when(F.col("alone") > 0, F.col("sid")).otherwise(0).alias("own")]
    named = entries.groupBy(*alike).agg(F.min("sid").alias("gid"), F.first("alone").alias("alone"))
    groups = materialize(named, "jaccard-groups")
    keyed = entries.withColumn("own", F.when(F.col("alone") > 0, F.col("sid")).otherwise(0))
    members = materialize(keyed.join(groups.select("n", "prefix", "own", "gid"), ["n", "prefix", "own"]).select("sid", "gid"), "jaccard-members")
    posted = groups.select("gid", "n", "alone", F.posexplode("prefix").alias("place", "h")).select("gid", "n", (F.col("alone") + F.col("place")).alias("pos"), "h")
    posted = materialize(posted, "jaccard-postings")

    found: DataFrame | None = None
    labels: DataFrame | None = None

    def merged(more: DataFrame) -> DataFrame:
        nonlocal found
        new = materialize(verify(more, full, percent), "jaccard-links")
        if found is not None:
            old, part, new = found, new, materialize(found.union(new), "jaccard-links")
            discard(old)
            discard(part)
        found = new
        return components(found)

    for turn in range(hub_rounds + 1):
        if labels is None:
            named_members = members.withColumn("comp", F.col("sid"))
        else:
            named_members = members.join(labels, F.col("sid") == F.col("node"), "left").select("sid", "gid", F.coalesce("component", "sid").alias("comp"))
        named_members = materialize(named_members, "jaccard-named")
        by_group = named_members.groupBy("gid").agg(F.min("comp").alias("comp"), F.max("comp").alias("comp_max"))
        at = posted.join(by_group, "gid")
        # Shingles whose groups all lie in one component have nothing more to say.
        spread = at.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp_max").alias("c1"), F.min(F.struct("pos", "gid", "n", "comp")).alias("hub"))
        spread = spread.filter("c0 <> c1")
        if turn < hub_rounds:
            if turn:
                # A hub of another component than the first one's.
                hubs = spread.select("h", F.col("hub.comp").alias("first"))
                second = at.join(hubs, "h").filter(F.col("comp") != F.col("first")).groupBy("h").agg(F.min(F.struct("pos", "gid", "n", "comp")).alias("hub"))
                spread = second
            hub = spread.select("h", F.col("hub.gid").alias("gid2"), F.col("hub.n").alias("n2"), F.col("hub.pos").alias("pos2"), F.col("hub.comp").alias("comp2"))
            pairs = at.join(hub, "h").filter((F.col("gid") != F.col("gid2")) & (F.col("comp") != F.col("comp2")) & passes(percent))
            pairs = pairs.select(F.greatest("gid", "gid2").alias("a"), F.least("gid", "gid2").alias("b"))
            inside = named_members.filter("sid <> gid").join(named_members.select(F.col("sid").alias("gid"), F.col("comp").alias("comp2")), "gid")
            inside = inside.filter("comp <> comp2").select(F.greatest("sid", "gid").alias("a"), F.least("sid", "gid").alias("b"))
            pairs = pairs.union(inside).distinct()
        else:
            counts = at.join(spread.select("h"), "h").groupBy("h", "comp").count()
            major = counts.groupBy("h").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"))
            here = at.join(major, "h")
            minor = here.filter((F.col("comp") != F.col("major")) | (F.col("comp") != F.col("comp_max")))
            other = here.select("h", F.col("gid").alias("gid2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"), F.col("comp_max").alias("max2"))
            differ = (F.col("comp") != F.col("comp2")) | (F.col("comp") != F.col("comp_max")) | (F.col("comp2") != F.col("max2"))
            group_pairs = minor.join(other, "h").filter((F.col("gid") != F.col("gid2")) & differ & passes(percent))
            group_pairs = group_pairs.select(F.greatest("gid", "gid2").alias("g1"), F.least("gid", "gid2").alias("g2")).distinct()
            # Members of one group that aren't in one component yet.
            split = by_group.filter("comp <> comp_max").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
            one = named_members.select(F.col("gid").alias("g1"), F.col("sid").alias("a"), F.col("comp").alias("ca"))
            two = named_members.select(F.col("gid").alias("g2"), F.col("sid").alias("b"), F.col("comp").alias("cb"))
            expanded = group_pairs.union(split).join(one, "g1").join(two, "g2").filter("ca <> cb and a <> b")
            pairs = expanded.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = materialize(pairs, "jaccard-pairs")
        before, labels = labels, merged(pairs)
        for done in (pairs, named_members, *([] if before is None else [before])):
            discard(done)
        release(spark)
    for done in (entries, groups, members, posted):
        discard(done)
    return labels


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, first) for each row of docs.

    key: hash of id and text; first: the key of the row that stands for the
    component: the one with the smallest id, of rows without ids the smallest key.
    """
    spark = docs.sparkSession
    share = min(1.0, 1.5 * (100 - percent) / 100)
    rows = docs.select("doc_id", "text").withColumn("key", row_key())
    wide = materialize(with_sets(rows, width, share, percent), "jaccard-wide")
    chosen = materialize(candidates(wide, percent), "jaccard-candidates")
    sets = materialize(wide.drop("low"), "jaccard-sets")
    discard(wide)
    release(spark)
    # Keys and ids of candidates, counted before they are broadcast.
    texts = rows.join(broadcast_if_small(chosen.select(F.col("row").alias("key"))), "key", "left_semi")
    full = with_sets(texts, width, 1.0, percent).select("sid", "n", "low")
    full = materialize(full, "jaccard-full")
    if full.count() > full.select("sid").distinct().count():  # equal rows: one of each is enough
        full = materialize(full.groupBy("sid").agg(F.first("n").alias("n"), F.first("low").alias("low")), "jaccard-full")
    alive = materialize(still_alive(full, percent, min(1.0, 3 * share)), "jaccard-alive")
    discard(full)
    release(spark)
    labels = links(alive, percent)

    distinct = sets.filter("n > 0").groupBy("sid", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("best"))
    placed = distinct.join(labels, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "sid"))
    placed = materialize(placed.select("sid", "n", "comp", "best"), "jaccard-placed")
    heads = placed.groupBy("comp").agg(F.min("best").alias("head"))
    named = placed.join(heads, "comp").select("sid", "n", F.col("head.doc_id").alias("_c"), F.col("head.key").alias("_k"))
    out = sets.select("doc_id", "key", "n", "sid").join(named, ["sid", "n"], "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id",
        "key",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("_c")).alias("component_id"),
        F.when(empty, F.col("key")).otherwise(F.col("_k")).alias("first"),
    )


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component; rows with empty sets stay, all of them."""
    with scratch(docs.sparkSession) as keep:
        marked = keep(materialize(joined(docs, width, percent), "jaccard-marked"))
    gone = marked.filter(F.col("key") != F.col("first")).select("key").distinct()
    again = marked.filter((F.col("key") == F.col("first")) & (F.col("n_shingles") > 0)).groupBy("key").count().filter("count > 1").select("key")
    gone, again = materialize(gone, "jaccard-gone"), materialize(again, "jaccard-again")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), row_key().alias("key"))
    kept = keyed.join(broadcast_if_small(gone), "key", "left_anti")
    if again.limit(1).count():
        twice = broadcast_if_small(again)
        kept = kept.join(twice, "key", "left_anti").unionByName(kept.join(twice, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("_doc.*")
