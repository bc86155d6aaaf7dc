"""op8: nearest neighbours by cosine through a permutation index.

PIVOTS distinct vectors of a bounded sample are the pivots. A vector is represented by its PREFIX
nearest pivots in order. Rows are dealt into blocks by a hash of their id; a block holds one inverted
file per pivot, posting (distinct vector, place of the pivot). A query adds up, over its own pivots'
files, how much each posting lowers the footrule distance below that of a vector sharing no pivot;
the ROOT * sqrt(n) of a block's n distinct vectors with the smallest footrule (all ties included) are then
compared by exact cosine in double precision. The best k of all blocks are merged. The formula is the same at
every size; blocks have BLOCK rows on average, so a query reranks a falling share up to one block's size and a fixed
one (6 %) beyond it.

Equal vectors of a block are indexed once, with their smallest k + 1 ids, so a vector copied into a
third of all rows neither fills the candidate list nor hides other neighbours. Queries meet blocks in
chunks of QUERIES, so a task's memory does not grow with the table. Every block sees every query: on vectors without
clusters no pivot rules a block out (with 24 of 1024 lists probed, a query still meets 38 % of 50,000 vectors for a
recall of 0.98), so the work grows as rows times queries, each pair costing a few additions and 6 % of them a cosine.

Defined cases: rows whose id or vector is null, whose vector holds null or non-finite components, is
zero, or has another length than the pivots', take no part. Repeated rows count once; a query's own id
is never its neighbour. Fewer candidates than k: all of them. Ties: smaller vec_id first. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bound of the sample the pivots are taken from; rows of a block; queries that meet it at once.
SAMPLE, PIVOTS, PREFIX = 4096, 256, 96
BLOCK, QUERIES = 16_384, 65_536
#: Of n distinct vectors in a block, ROOT * sqrt(n) are reranked.
ROOT = 8.0


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Indexes of the nearest pivots of each row, nearest first."""
    near = _unit(x) @ pivots.T
    prefix = min(prefix, near.shape[1])
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class BlockIndex:
    """Pivot inverted files over the distinct vectors of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, of = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.x, self.k = x[first].astype(np.float64), k
        self.scale = np.sqrt((self.x * self.x).sum(1))
        by = np.argsort(of, kind="stable")
        ids, of = ids[by], of[by]
        fresh = np.r_[True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])]
        ids, of = ids[fresh], of[fresh]
        start = np.searchsorted(of, np.arange(len(first)))
        keep = np.arange(len(of)) - start[of] <= k
        self.ids, self.of = ids[keep], of[keep]
        self.start = np.searchsorted(self.of, np.arange(len(first) + 1))
        perm = nearest_pivots(self.x, pivots, prefix)
        self.prefix = perm.shape[1]
        by = np.argsort(perm.ravel(), kind="stable")
        self.post, self.place = by // self.prefix, (by % self.prefix).astype(np.int32)
        self.list = np.searchsorted(perm.ravel()[by], np.arange(len(pivots) + 1))

    def search(self, own: int, q: np.ndarray, perm: np.ndarray, root: float = ROOT) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k for query vector q with id `own`."""
        gain = np.zeros(len(self.x), np.int32)
        for place, pivot in enumerate(perm):
            a, b = self.list[pivot], self.list[pivot + 1]
            # footrule sums |place - place'| over both prefixes, a missing pivot standing at place `prefix`
            gain[self.post[a:b]] += (self.prefix - place) + (self.prefix - self.place[a:b]) - np.abs(self.place[a:b] - place)
        want = min(len(gain), int(np.ceil(root * np.sqrt(len(gain)))))
        near = np.flatnonzero(gain >= -np.partition(-gain, want - 1)[want - 1])
        score = (self.x[near] * q).sum(1) / (self.scale[near] * np.sqrt((q * q).sum()))
        best = near[score >= -np.partition(-score, min(len(near), self.k + 1) - 1)[min(len(near), self.k + 1) - 1]]
        score = (self.x[best] * q).sum(1) / (self.scale[best] * np.sqrt((q * q).sum()))
        span = self.start[best + 1] - self.start[best]
        ids = np.concatenate([self.ids[self.start[i] : self.start[i + 1]] for i in best])
        score = np.repeat(score, span)
        ok = ids != own
        ids, score = ids[ok], score[ok]
        top = np.lexsort((ids, -score))[: self.k]
        return ids[top], score[top]


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, root: float = ROOT, block: int = BLOCK, queries: int = QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose id is divisible by `every`."""
    x = F.col("x")
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    clean = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("x")).filter(F.col("id").isNotNull() & sound)
    sample = [(r.id, r.x) for r in clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    schema = "query_id bigint, vec_id bigint, score double"
    final = ["query_id", "rank", "vec_id", "score"]
    spark = vectors.sparkSession
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = [len(v) for _, v in sample]
    width = max(set(sizes), key=lambda n: (sizes.count(n), -n))
    kind = np.float64 if dict(clean.dtypes)["x"] == "array<double>" else np.float32
    chosen = list(dict.fromkeys(tuple(v) for _, v in sample if len(v) == width))[:PIVOTS]
    pivots = _unit(np.array(chosen, kind))
    clean = clean.filter(F.size("x") == width)
    n, n_queries = clean.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    blocks, chunks = -(-n // block), max(1, -(-n_queries // queries))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(int(m) - 1)))
    data = clean.select(F.pmod(F.xxhash64("id"), F.lit(int(blocks))).cast("int").alias("b"), "id", "x").select("b", numbers(chunks).alias("c"), "id", "x")
    asked = clean.filter(F.col("id") % every == 0).select(F.pmod(F.xxhash64("id"), F.lit(int(chunks))).cast("int").alias("c"), "id", "x").select(numbers(blocks).alias("b"), "c", "id", "x")

    def matrix(table: pa.Table) -> np.ndarray:
        col = table.column("x").combine_chunks()
        return np.asarray(col.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, width)

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [], [], []
        if rows.num_rows and wanted.num_rows:
            index = BlockIndex(rows.column("id").to_numpy(), matrix(rows), pivots, PREFIX, k)
            q = matrix(wanted)
            perms = nearest_pivots(q, pivots, PREFIX)
            for own, v, perm in zip(wanted.column("id").to_pylist(), q.astype(np.float64), perms):
                ids, score = index.search(own, v, perm, root)
                out[0].append(np.full(len(ids), own))
                out[1].append(ids)
                out[2].append(score)
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": joined[0].astype(np.int64), "vec_id": joined[1].astype(np.int64), "score": joined[2].astype(np.float64)})

    found = stored(data.groupBy("b", "c").cogroup(asked.groupBy("b", "c")).applyInArrow(run, schema), "ann")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", place).filter(F.col("rank") <= k).select(final)
