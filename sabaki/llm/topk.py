"""Exact top-k inner-product search with KD-trees.

Vectors are turned into integers, dealt to shards and written to the shared folder once.  A shard's
KD-tree splits at the median of its widest dimension and keeps a tight box for each node; the largest
inner product that a box allows bounds all below it.  A query visits leaves best first and stops where
the bound can no longer beat its k-th best score, which it carries from leaf to leaf and from shard to
shard of a task.  Equal vectors of a shard are one point of the tree with its k+1 least ids.

Queries go in blocks of bounded bytes.  A block is sent to all tasks, each of which holds one shard at a
time, and gives k candidates a query and task; so vectors are shuffled once, whatever the number of queries,
and no task or driver holds more than a block and a shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import materialise, table

K = 5
SHARD_ROWS = 8192
#: Components of the queries of a block, and queries, at most (32 MB).
BLOCK_VALUES = 1 << 22
BLOCK_ROWS = 1 << 17
LEAF = 64
QUANTUM = 256
#: Components that aren't longs any more take no part.
LIMIT = float(1 << 63)


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component as a long; null where the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * QUANTUM >= LIMIT))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * QUANTUM).cast("long")))


class KDTree:
    """Leaves of median splits with tight boxes, and the boxes of up to eight neighbours on each level above."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        n = len(x)
        depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
        groups = [np.arange(n)]
        for _ in range(depth):
            halves = []
            for g in groups:
                own = x[g]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(g) and x.shape[1] else 0
                mid = len(g) // 2
                g = g[np.argpartition(own[:, axis], mid)] if 0 < mid and x.shape[1] else g
                halves += [g[:mid], g[mid:]]
            groups = halves
        self.leaves = [g for g in groups if len(g)]
        self.low = np.stack([x[g].min(axis=0) for g in self.leaves])
        self.high = np.stack([x[g].max(axis=0) for g in self.leaves])
        self.levels = [(self.low, self.high)]
        while len(self.levels[-1][0]) > 8:
            low, high = self.levels[-1]
            at = np.arange(0, len(low), 8)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def reach(self, q: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves that some query of the block may have to visit, and their bounds by query.

        Boxes are opened from the top: one whose bound is below the k-th score of every query goes.
        """
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[level]
            bounds = up @ high[nodes].T + down @ low[nodes].T
            open_ = (bounds >= kth[:, None]).any(axis=0)
            nodes, bounds = nodes[open_], bounds[:, open_]
            if level:
                nodes = (nodes[:, None] * 8 + np.arange(8)).reshape(-1)
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return nodes, bounds


class Best:
    """The k best (score, id) of every query of a block; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.full(n, -np.inf)
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Candidates ``ids`` with their ``scores`` for the queries ``rows``, whose own ids are ``own``."""
        good = (scores >= self.kth[rows][:, None]) & (ids[None, :] != own[:, None])
        some = good.any(axis=1)
        if not some.any():
            return
        rows, good = rows[some], good[some]
        s = np.concatenate([self.scores[rows], np.where(good, scores[some], -np.inf)], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, good.shape)], axis=1)
        i = np.where(s > -np.inf, i, np.iinfo(np.int64).max)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
        self.kth[rows] = np.maximum(self.kth[rows], self.scores[rows, -1])


#: Leaves that every query visits by itself, best first, before the block goes through the rest together.
ROUNDS = 2


#: Queries that go through a tree together.
STEP = 2048


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, best: Best) -> bool:
    """Offer the candidates ``x`` to ``best`` of the queries ``q``; False where their products are too large for that."""
    big = float(np.abs(x.astype(float)).max(initial=1)) * float(np.abs(q.astype(float)).max(initial=1)) * max(1, x.shape[1])
    if big >= 1 << 52 or not x.shape[1]:
        return False
    k = best.k
    kind = np.float32 if big < 1 << 23 else np.float64
    order = np.argsort(ids, kind="stable")
    points, inverse = np.unique(x[order], axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    by_point = np.argsort(inverse, kind="stable")  # within a point by id
    start = np.searchsorted(inverse[by_point], np.arange(len(points) + 1))
    sorted_ids = ids[order][by_point]
    points, q = points.astype(kind), q.astype(kind)
    tree = KDTree(points)
    # Of equal vectors the k+1 least ids are enough, as one may be the query's own.
    copies = [sorted_ids[start[p] : min(start[p + 1], start[p] + k + 1)] for p in range(len(points))]
    sizes = np.array([len(c) for c in copies], int)
    leaf_ids = [np.concatenate([copies[p] for p in leaf]) for leaf in tree.leaves]

    def visit(leaf: int, rows: np.ndarray) -> None:
        scores = np.repeat(q[rows] @ points[tree.leaves[leaf]].T, sizes[tree.leaves[leaf]], axis=1)
        best.offer(rows, scores.astype(np.float64), leaf_ids[leaf], q_ids[rows])

    for lo in range(0, len(q), STEP):
        block = np.arange(lo, min(len(q), lo + STEP))
        leaves, bounds = tree.reach(q[block], best.kth[block])
        done = np.zeros(bounds.shape, bool)
        first = np.argsort(-bounds, axis=1, kind="stable")[:, :ROUNDS]
        for r in range(first.shape[1]):
            for at in np.unique(first[:, r]):
                rows = np.flatnonzero((first[:, r] == at) & (bounds[:, at] >= best.kth[block]))
                if len(rows):
                    done[rows, at] = True
                    visit(leaves[at], block[rows])
        for at in np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable"):
            rows = np.flatnonzero((bounds[:, at] >= best.kth[block]) & ~done[:, at])
            if len(rows):
                visit(leaves[at], block[rows])
    return True


def _plain(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> pd.DataFrame:
    """For vectors without components, and products that doubles can't hold: whole numbers, one by one; a sum beyond a long is the nearest long."""
    out = []
    for own, v in zip(q_ids.tolist(), q.tolist(), strict=True):
        scored = ((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in zip(ids.tolist(), x.tolist(), strict=True) if i != own)
        out += [(own, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in heapq.nsmallest(k, scored)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _searched(asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Batches of one task, whole shards after one another, to its k best candidates of each query of ``asked`` (by dimension)."""

    def frame(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(ids), k) for d, (ids, _) in asked.items()}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at: tuple[int, int] | None = None
        emit = lambda p: pa.RecordBatch.from_pandas(p, schema=_FOUND, preserve_index=False)

        def close() -> Iterator[pa.RecordBatch]:
            dim = at[0]
            if dim in asked and held:
                ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                q_ids, q = asked[dim]
                if not search(x, ids, q, q_ids, best[dim]):
                    yield emit(_plain(x, ids, q, q_ids, k))

        for b in batches:
            if not b.num_rows:
                continue
            dims, shards, ids = (b.column(i).to_numpy() for i in range(3))
            ends = np.flatnonzero(np.r_[(dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1]), True]) + 1
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                own = (int(dims[lo]), int(shards[lo]))
                if own != at:
                    if at is not None:
                        yield from close()
                    at, held = own, []
                x = b.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, own[0])
                held.append((ids[lo:hi], x))
        if at is not None:
            yield from close()
        for d, got in best.items():
            row, place = np.nonzero(got.scores > -np.inf)
            yield emit(frame([pd.DataFrame({"query_id": asked[d][0][row], "vec_id": got.ids[row, place], "score": got.scores[row, place].astype(np.int64)})]))

    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query`` holds, its ``k`` best others.

    ``vectors`` has vec_id and embedding; other columns, whatever their names, are not used.  Scores are
    integer inner products of floor(256 * x); ties go to the smaller vec_id.  Rows with a null vec_id, a null
    vector, or a null or non-finite component (or one of 2**55 or more, whose integer isn't a long) take no
    part.  Only vectors of equal length meet.  A query's own vec_id is no candidate; of rows that repeat a
    vec_id and vector, one takes part.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), is_query.alias("is_query"))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])
    rows = materialise(rows, "vectors")
    # A shard is a part of the vectors of one dimension; the counts are joined, as dimensions may be many.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.count(F.lit(1))
    shards = F.greatest(F.ceil(number / shard_rows), F.least(F.lit(tasks), F.ceil(number / 1024)))
    counts = rows.groupBy(F.col("dim").alias("own_dim")).agg(shards.cast("int").alias("shards"))
    dealt = rows.join(counts, F.col("dim") == F.col("own_dim"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).select("dim", "shard", "vec_id", "v")
    # Shards go round the tasks; one task has several of a large table, one after the other.
    task = F.pmod(F.col("shard") + F.hash("dim"), F.lit(tasks))
    dealt = dealt.withColumn("task", task).repartitionById(tasks, "task").drop("task").sortWithinPartitions("dim", "shard")
    shards = materialise(dealt, "shards")

    queries = rows.filter("is_query").select("vec_id", "v", "dim")
    n, values = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest("dim", F.lit(1)).cast("long")), F.lit(0))).first()
    blocks = max(-(-n // block_rows), -(-values // BLOCK_VALUES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(max(1, blocks))).cast("int"))
    queries = materialise(queries.repartition("block"), "queries") if blocks > 1 else queries
    found = None
    for block in range(blocks):
        asked: dict[int, list] = {}
        for r in queries.filter(F.col("block") == block).toLocalIterator():
            asked.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))
        packed = {d: (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64).reshape(len(own), d)) for d, own in asked.items()}
        part = shards.mapInArrow(_searched(packed, k), "query_id long, vec_id long, score long")
        part = part if blocks == 1 else materialise(_best(part, k), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    lists = _lists(found, k)
    return lists.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def _lists(found: DataFrame, k: int) -> DataFrame:
    ranked = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("neg"), F.col("vec_id")))), 1, k)
    return found.groupBy("query_id").agg(ranked.alias("best"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, so that what a block leaves doesn't follow the number of tasks."""
    return _lists(found, k).select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", (-F.col("b.neg")).alias("score"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
