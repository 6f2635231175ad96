"""Minimax contiguous sharding of documents.

Documents with equal texts are a group and stay together.  Groups are ordered by
their place, a 63-bit number made of the CRC-32 and of a second hash of the text, and
the smallest shard capacity for which greedy filling in that order needs no more
shards than there are is found by binary search, over groups and not over anything
coarser; the cuts are made there.  (Two texts of the same place would stay together;
by chance that takes some 2^31 texts.)

The list of groups is as long as the corpus, so it is looked at from afar first: the
places are cut into ``cells`` equal cells, and only the list of their sizes, at most
``cells`` entries whatever the corpus, is searched.  A cell can't be cut finer than
its groups allow, which nobody knows yet, so the search yields two bounds: a capacity
that surely suffices (no cell is cut) and one that surely is needed (cells of several
groups are cut anywhere).  Between them every cut can only fall into a few cells.
Those are cut into smaller ones, all others become solid, and the search is repeated
until both bounds are equal.  Rows are only ever summed up by DataFrame functions.

A group larger than a fair share sets the capacity.  Pure greedy filling would
then leave later shards empty, so the cuts that close a shard near its fair share
of what is left are tried first and taken where they keep within the capacity.

Null texts count no bytes and form one group; equal rows are separate documents
of one group, and are counted together until they are returned, so that no task holds
a large group of them.  A table without rows gives no rows.  Other columns pass
through; output names replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.rows import expanded, identity
from quillwork.plans.materialize import broadcast_if_small, discard, materialize
from quillwork.plans.ranks import bucket_of, running

SHARDS = 16
CELLS = 4096
ROWS_PER_BUCKET = 4096
BITS = 63


@dataclass(frozen=True)
class Cell:
    """Groups with places from low on; solid if it can't or needn't be cut, else it has the places of one value of place >> shift."""

    low: int
    load: int
    solid: bool
    shift: int = 0


def shards_filled(cells: list[Cell], capacity: int) -> float:
    """Shards that greedy filling needs if no cell is cut; without end if it can't be done."""
    n, full = 1, 0
    for c in cells:
        if c.load > capacity:
            return math.inf
        if full + c.load > capacity:
            n, full = n + 1, 0
        full += c.load
    return n


def shards_poured(cells: list[Cell], capacity: int) -> int:
    """Shards that are needed even if cells that aren't solid could be cut anywhere."""
    n, full = 1, 0
    for c in cells:
        if full + c.load <= capacity:
            full += c.load
        elif c.solid:
            n, full = n + 1, c.load
        else:
            more = -(-(full + c.load - capacity) // capacity)
            n, full = n + more, full + c.load - more * capacity
    return n


def least(low: int, high: int, enough) -> int:
    """The smallest number from low to high for which enough holds; it holds for high."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def capacity_bounds(cells: list[Cell], shards: int, low: int, high: int) -> tuple[int, int]:
    """Capacities between which the smallest feasible one lies; low and high are known bounds."""
    solid = max((c.load for c in cells if c.solid), default=0)
    low = least(max(low, solid), max(high, solid), lambda c: shards_poured(cells, c) <= shards)
    return low, least(low, max(high, low), lambda c: shards_filled(cells, c) <= shards)


def cuttable(cells: list[Cell], shards: int, low: int, high: int) -> set[int]:
    """Numbers of the cells in which a cut may fall for a capacity from low to high.

    Filling that starts earlier and holds less cuts earlier, so the kth cut lies
    between that of the lower bound, made before cells, and that of the upper one,
    made as late as possible.
    """
    large = {i for i, c in enumerate(cells) if not c.solid and c.load > low}
    if large:  # first these: cuts behind them aren't known before
        return large
    ends, total = [], 0
    for c in cells:
        total += c.load
        ends.append(total)

    def holding(at: int, i: int) -> int:
        """The first cell from i on that ends beyond at."""
        while i < len(cells) and ends[i] <= at:
            i += 1
        return i

    found, first, last = set(), 0, 0
    early = late = 0
    for _ in range(shards - 1):
        first = holding(early + low, first)
        last = holding(late + high, last)
        found.update(i for i in range(first, min(last + 1, len(cells))) if not cells[i].solid)
        if first == len(cells):
            break
        early = ends[first] - cells[first].load
        late = late + high if last == len(cells) or not cells[last].solid else ends[last] - cells[last].load
    return found


def cuts_of(cells: list[Cell], shards: int, capacity: int) -> list[int]:
    """Places where the shards after the first begin."""

    def fill(near_fair: bool) -> tuple[list[int], int]:
        cuts, full, left, top = [], 0, sum(c.load for c in cells), 0
        for c in cells:
            over = full + c.load > capacity
            if near_fair and len(cuts) < shards - 1:
                over |= full + c.load / 2 > (left + full) / (shards - len(cuts))
            if over and full:
                cuts.append(c.low)
                full = 0
            full += c.load
            left -= c.load
            top = max(top, full)
        return cuts, top

    even, top = fill(True)
    return even if top <= capacity and len(even) < shards else fill(False)[0]


def plan(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """(capacity, cuts) for groups(place, load), which may have several rows a place; (0, []) if there are none."""

    def summed(rows: DataFrame, shift: int) -> list:
        cell = F.expr(f"shiftright(place, {shift})")
        return rows.groupBy(cell.alias("cell")).agg(F.sum("load").alias("load"), (F.min("place") == F.max("place")).alias("solid")).orderBy("cell").collect()

    shift = BITS - max(1, cells.bit_length() - 1)
    listed = [Cell(r.cell << shift, r.load, r.solid or shift == 0, shift) for r in summed(groups, shift)]
    if not listed:
        return 0, []
    total = sum(c.load for c in listed)
    low, high = -(-total // shards), total
    while True:
        low, high = capacity_bounds(listed, shards, low, high)
        open_ = cuttable(listed, shards, low, high) if low < high else set()
        if not open_:
            return high, cuts_of(listed, shards, high)
        large = any(listed[i].load > low for i in open_)
        shift = max(listed[i].shift for i in open_)
        now = {listed[i].low >> shift: i for i in open_ if listed[i].shift == shift}
        finer = max(0, shift - max(1, (cells // len(now)).bit_length() - 1))
        inside = F.expr(f"shiftright(place, {shift})").isin(list(now))
        parts: dict[int, list[Cell]] = {i: [] for i in now.values()}
        for r in summed(groups.filter(inside), finer):
            parts[now[(r.cell << finer) >> shift]].append(Cell(r.cell << finer, r.load, r.solid or finer == 0, finer))
        # A cell that no cut can fall into is as good as solid; where large cells are open, cuts aren't known yet.
        rest = lambda i, c: c if large or i in open_ else Cell(c.low, c.load, True)
        listed = [x for i, c in enumerate(listed) for x in (parts[i] if i in parts else [rest(i, c)])]


def place_of(text: Column) -> Column:
    """From 0 to 2^63 - 1, ordered by the CRC-32; -1 for null."""
    high = F.shiftleft(F.crc32(text.cast("binary")), 31)
    return F.coalesce(high + F.shiftrightunsigned(F.xxhash64(text), 33), F.lit(-1).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, rows_per_bucket: int = ROWS_PER_BUCKET, keep: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; without the other columns but doc_id if not keep.

    Shards and slots are found without the texts; with keep they join their rows once.
    """
    named = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keys = identity(docs) if keep else []
    names = ["doc_id", "size", "text_crc32", "place", *(["_k1", "_k2"] if keep else [])]
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    alike = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place_of(text).alias("place"), *keys)
    alike = materialize(alike.groupBy(*names).agg(F.count("*").alias("copies")), "shard-rows")
    _, cuts = plan(alike.select("place", (F.col("size") * F.col("copies")).alias("load")), shards, cells)
    before = F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= F.col("place"))
    placed = alike.withColumn("shard", F.size(before))
    # A row a shard.
    of_shard = F.broadcast(placed.groupBy("shard").agg(F.count("*").alias("_rows")))
    mixed = F.xxhash64(*names)
    unit = F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53))
    placed = placed.join(of_shard, "shard").withColumn("_bucket", bucket_of(unit, F.col("_rows"), rows_per_bucket))
    numbered = running(placed, ["shard"], "_bucket", [mixed, *map(F.col, names)], F.col("copies"), "slot")
    found = [F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("_nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    if not keep:
        return expanded(numbered, F.col("copies"), "_nth").select("doc_id", "size", "text_crc32", *found)
    numbered = materialize(numbered.select("_k1", "_k2", "size", "text_crc32", "shard", "slot", "copies"), "shard-slots")
    discard(alike)
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in named]).alias("_doc"), *identity(docs))
    # The side of the slots is hashed, so texts are shuffled but not sorted.
    single = rows.join(numbered.filter("copies = 1").withColumn("_nth", F.lit(0)).hint("shuffle_hash"), ["_k1", "_k2"])
    out = single.select("_doc.*", "size", "text_crc32", *found)
    several = numbered.filter("copies > 1")
    if several.limit(1).count():
        keys_ = broadcast_if_small(several.select("_k1", "_k2"))
        one = rows.join(keys_, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first("_doc").alias("_doc"))
        each = expanded(one.join(several, ["_k1", "_k2"]), F.col("copies"), "_nth")
        out = out.unionByName(each.select("_doc.*", "size", "text_crc32", *found))
    return out
