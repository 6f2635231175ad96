"""Exact top-k search by KD-trees, one for each shard.

Vectors are dealt to shards by a hash of their id.  Each shard builds a KD-tree:
nodes are split at the median of their widest dimension, and every node keeps the
tight bounding box of its vectors.  The best score a box can hold for a query
bounds its node, so a best-first traversal opens nodes by falling bound and stops
once no bound beats the kth score so far.  The kth score travels: a query is
first searched in its own shard, and what it finds there is where every other
shard starts from, so those open fewer nodes.

Scores are inner products of the vectors turned into whole numbers,
floor(scale * x).  Ties go to the smaller id.  Queries come in blocks of bounded
size; a shard is sent to each block, never all rows to all rows in one task, and
a block's results are merged by query.  Results are exact, so no recall is lost.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id.  Vectors of other lengths than the query's aren't compared.
Whole numbers must fit: |scale * x| < 2^27, else an error is raised.  Rows that repeat
an id are all candidates, though not of their own id; of those that ask, the one with
the smallest vector does.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.plans.materialize import materialize

K, SCALE, LEAF = 10, 1024, 128
ROWS_PER_SHARD, QUERIES_PER_BLOCK = 16_384, 2_048
#: Sizes of components from which on sums of products could leave what doubles hold exactly.
LARGEST = 1 << 27


class KDTree:
    """Median splits with tight boxes over whole-number vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(self._node(np.arange(len(ids))), np.arange(len(ids)))] if len(ids) else []
        while todo:
            node, rows = todo.pop()
            spread = self.high[node] - self.low[node]
            if len(rows) <= leaf or not spread.any():
                self.rows[node] = rows
                continue
            values = self.vectors[rows, int(np.argmax(spread))]
            middle = len(rows) // 2
            split = np.argpartition(values, middle)
            parts = [np.sort(rows[split[:middle]]), np.sort(rows[split[middle:]])]
            pair = tuple(self._node(p) for p in parts)
            self.children[node] = pair
            todo += list(zip(pair, parts, strict=True))
        self.lows = np.array(self.low) if self.low else np.zeros((0, 1), np.int64)
        self.highs = np.array(self.high) if self.high else np.zeros((0, 1), np.int64)

    def _node(self, rows: np.ndarray) -> int:
        self.low.append(self.vectors[rows].min(0))
        self.high.append(self.vectors[rows].max(0))
        self.children.append(None)
        self.rows.append(None)
        return len(self.low) - 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Best possible inner product of each query with each node's box."""
        # Exact in doubles: sums stay below 2^53 for the lengths and sizes at hand.
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        return up @ self.highs.T.astype(np.float64) + down @ self.lows.T.astype(np.float64)

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the best k other rows, best first, that reach the score `floor`; more may tie with it."""
        if not len(self.ids):
            return []
        best: list[tuple[int, int]] = []  # smallest first: (score, -id)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            least = best[0][0] if len(best) == k else floor
            if floor is not None and least is not None:
                least = max(least, floor)
            if least is not None and -bound < least:
                break
            if (pair := self.children[node]) is not None:
                for child in pair:
                    if least is None or bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            wanted = np.flatnonzero(scores >= least) if least is not None else np.arange(len(rows))
            if len(wanted) > k:
                # Rows are in the order of ids, so a stable sort breaks ties by id.
                wanted = wanted[np.argsort(-scores[wanted], kind="stable")[: k + 1 + int((self.ids[rows] == query_id).sum())]]
            for i in wanted:
                row = int(self.ids[rows[i]])
                if row == query_id:
                    continue
                entry = (int(scores[i]), -row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def whole(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _search(k: int, with_floor: bool):
    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shard):
            tree = KDTree(shard["vec_id"].to_numpy(np.int64), np.stack(shard["v"].to_numpy()).astype(np.int64))
            q = np.stack(queries["v"].to_numpy()).astype(np.int64)
            bounds = tree.bounds(q)
            floors = queries["floor"].to_numpy() if with_floor else [None] * len(q)
            for i, qid in enumerate(queries["query_id"].to_numpy(np.int64)):
                floor = None if floors[i] is None or pd.isna(floors[i]) else int(floors[i])
                out += [(qid, row, score) for score, row in tree.search(int(qid), q[i], bounds[i], k, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, from vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    used = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    used = materialize(used.select("vec_id", whole(F.col("embedding"), scale).alias("v"), is_query.alias("asks")), "topk-vectors")
    rows, too_large = used.agg(F.count("*"), F.max(F.exists("v", lambda x: F.abs(x) >= LARGEST))).first()
    if too_large:
        raise ValueError(f"components must stay below {LARGEST} in size once scaled, or scores wouldn't be exact")
    shards = max(1, -(-rows // rows_per_shard))
    dealt = used.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), "dim": F.size("v")})
    asked = dealt.filter("asks").groupBy("vec_id").agg(F.min(F.struct("v", "shard", "dim")).alias("q")).select("vec_id", "q.*")
    asked = materialize(asked, "topk-queries")
    blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    asked = asked.select(F.col("vec_id").alias("query_id"), "v", "shard", "dim", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"))
    result = "query_id long, vec_id long, score long"

    home = dealt.groupBy("shard", "dim").cogroup(asked.groupBy("shard", "dim")).applyInPandas(_search(k, False), result)
    home = materialize(home, "topk-home")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    everywhere = asked.join(floors, "query_id", "left").select("query_id", "v", "dim", "block", "floor", F.col("shard").alias("home"))
    others = everywhere.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    keyed = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else dealt.withColumn("block", F.lit(0))
    by = ["shard", "dim", "block"]
    away = keyed.groupBy(*by).cogroup(others.groupBy(*by)).applyInPandas(_search(k, True), result)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
