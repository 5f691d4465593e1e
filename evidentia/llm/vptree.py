"""Operator 10: approximate nearest neighbours with vantage-point trees.

Vectors are scaled to length one, where the chord between two is a metric that falls as their cosine
rises. The candidates are dealt into shards; each shard is a tree whose nodes split their points at the
median distance from a vantage point. Blocks of queries go down each tree together: a query enters its
own side first and the other side only if its distance to the boundary, times the factor, is smaller than
the distance of its k-th best so far. At factor one that is the triangle inequality and nothing is lost;
a larger factor prunes more. ``FACTOR`` is one: the search is exact, and recall against brute force is
one up to rounding.

Equal vectors, however many, are one point that keeps its k + 1 smallest ids, which is all that the ties
rule (smaller id first) can ever return. What the shards return is ranked again by the exact cosine of
the original vectors in double precision.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; rows with
a null id neither; rows that repeat an id count once, by the least of their vectors. Vectors of another length than the
query's are no candidates for it. Columns beside vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import bounded_batches, table

FACTOR, K = 1.0, 5
#: Points of a leaf, points of a shard, queries of a block, and queries of a turn.
LEAF, SHARD, BLOCK, TURN = 192, 16_384, 2_048, 65_536
#: Queries of a block whose points at the edge are held at once.
PART = 128
#: Chords this near in the scaled vectors may be in another order in the originals.
SLACK = 1e-7


class VantageTree:
    """A tree over unit vectors; nodes are (vantage, radius, inside, outside), leaves arrays of rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5) -> None:
        self.points = points
        rng = np.random.default_rng(seed)
        self.root: list = [None]
        todo = [(np.arange(len(points)), self.root, 0)]
        while todo:
            rows, into, slot = todo.pop()
            if len(rows) <= leaf:
                into[slot] = rows
                continue
            vantage = points[rows[rng.integers(len(rows))]]
            far = self._chord(points[rows] @ vantage)
            order = np.argsort(far, kind="stable")
            half = len(rows) // 2
            node = [vantage, (far[order[half - 1]], far[order[half]]), None, None]
            into[slot] = node
            todo += [(rows[order[:half]], node, 2), (rows[order[half:]], node, 3)]

    @staticmethod
    def _chord(cosine: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * cosine))

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and chords of the k nearest points of each query (row -1: fewer points), nearest first."""
        best = np.full((len(queries), k), np.inf)
        rows = np.full((len(queries), k), -1, np.int64)
        if not len(self.points):
            return rows, best
        todo: list[tuple[object, np.ndarray, np.ndarray]] = [(self.root[0], np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, who, bound = todo.pop()
            still = bound * factor <= best[who, k - 1] + SLACK
            who, bound = who[still], bound[still]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                far = np.concatenate((best[who], self._chord(queries[who] @ self.points[node].T)), axis=1)
                known = np.concatenate((rows[who], np.broadcast_to(node, (len(who), len(node)))), axis=1)
                pick = np.argsort(far, axis=1, kind="stable")[:, :k]
                best[who], rows[who] = np.take_along_axis(far, pick, 1), np.take_along_axis(known, pick, 1)
                continue
            vantage, (low, high), inside, outside = node
            far = self._chord(queries[who] @ vantage)
            near_in = far < (low + high) / 2
            to_out, to_in = np.maximum(bound, high - far), np.maximum(bound, far - low)
            # the last pushed is searched first: each query's own side comes before its other side
            todo.append((outside, who[near_in], to_out[near_in]))
            todo.append((inside, who[~near_in], to_in[~near_in]))
            todo.append((outside, who[~near_in], bound[~near_in]))
            todo.append((inside, who[near_in], bound[near_in]))
        return rows, best

    def within(self, queries: np.ndarray, radius: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and rows of all points at most the query's radius away."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo: list[tuple[object, np.ndarray, np.ndarray]] = [(self.root[0], np.arange(len(queries)), np.zeros(len(queries)))] if len(self.points) else []
        while todo:
            node, who, bound = todo.pop()
            still = bound * factor <= radius[who] + SLACK
            who, bound = who[still], bound[still]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                at, place = np.nonzero(self._chord(queries[who] @ self.points[node].T) <= radius[who, None])
                found.append((who[at], node[place]))
                continue
            vantage, (low, high), inside, outside = node
            far = self._chord(queries[who] @ vantage)
            todo.append((outside, who, np.maximum(bound, high - far)))
            todo.append((inside, who, np.maximum(bound, far - low)))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(x for _, x in found)])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as (vec_id, v) with double components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.coalesce(fine, F.lit(False)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine of original vectors, summed from the first component to the last."""

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k in range(x.shape[1]):
            total += x[:, k] * y[:, k]
        return total

    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


class _Shard:
    """The points of a shard: one tree for each length of vectors."""

    def __init__(self, rows: list[tuple[list[int], np.ndarray]], k: int, factor: float) -> None:
        self.k, self.factor, self.trees = k, factor, {}
        by_size: dict[int, list] = {}
        for ids, v in rows:
            by_size.setdefault(len(v), []).append((ids, v))
        for size, points in by_size.items():
            original = np.stack([v for _, v in points])
            self.trees[size] = (original, VantageTree(_unit(original)), [i for i, _ in points], np.array([min(i) for i, _ in points], np.int64))

    def search(self, asked: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, float]]:
        """(query, id, cosine) of the k best of each query."""
        out: list[tuple[int, int, float]] = []
        by_size: dict[int, list] = {}
        for own, v in asked:
            by_size.setdefault(len(v), []).append((own, v))
        for size, rows in by_size.items():
            if size not in self.trees:
                continue
            original, tree, ids, least = self.trees[size]
            q = np.stack([v for _, v in rows])
            # one more than k, as the query's own point is among them; all points at the edge within rounding come
            # too (one direction with many norms), and the best k by exact cosine and id go out
            unit = _unit(q)
            _, far = tree.search(unit, self.k + 1, self.factor)
            for first in range(0, len(q), PART):
                part = slice(first, first + PART)
                where, point = tree.within(unit[part], far[part, self.k] + SLACK, self.factor)
                score = _cosine(q[part][where], original[point])
                order = np.lexsort((least[point], -score, where))
                where, point, score = where[order] + first, point[order], score[order]
                start = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else where
                for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(where)]):
                    own = rows[where[lo]][0]
                    # a point's ids beyond its least may come after those of the next of the same cosine
                    last = min(lo + self.k, hi - 1)
                    end = lo + int(np.searchsorted(-score[lo:hi], -score[last], side="right")) if last < hi - 1 else hi
                    near = heapq.nsmallest(self.k, ((-s, int(i)) for p, s in zip(point[lo:end].tolist(), score[lo:end].tolist()) for i in ids[p] if i != own))
                    out += [(own, i, -s) for s, i in near]
        return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD, turn: int = TURN) -> DataFrame:
    """The k nearest rows of ``vectors`` of each row of ``queries`` (both: vec_id, embedding), itself aside.

    The queries are dealt into turns of about ``turn``; a task works through one shard for one turn, in blocks as
    they arrive, so that neither its time nor its memory grows with the numbers of vectors and queries.
    """
    bounded_batches(vectors.sparkSession)
    points = _distinct_points(_by_id(usable(vectors)), k + 1)
    shards, turns = (max(1, -(-x.count() // size)) for x, size in ((vectors, shard), (queries, turn)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = points.select(F.pmod(F.xxhash64("v", F.lit(17)), F.lit(shards)).cast("int").alias("shard"), every(turns).alias("turn"), F.lit(-1).cast("long").alias("asked"), "ids", "v")
    asked = _by_id(usable(queries))
    routed = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int").alias("turn"), F.col("vec_id").alias("asked"), F.lit(None).cast("array<bigint>").alias("ids"), "v")
    # a shard's points come before the queries of its turn: only points have ids
    met = placed.unionByName(routed).withColumn("side", F.col("ids").isNull()).repartition("shard", "turn").sortWithinPartitions("shard", "turn", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, opened, held = None, [], None, []

        def answer() -> Iterator[pa.RecordBatch]:
            found = opened.search(held) if opened is not None else []
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "vec_id", "score"])

        for b in batches:
            heads = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for head, own, ids, v in zip(heads, b.column(2).to_pylist(), b.column(3).to_pylist(), _vectors(b.column(4)), strict=True):
                if head != now or len(held) >= BLOCK:
                    if held:
                        yield from answer()
                    held = []
                    if head != now:
                        now, rows, opened = head, [], None
                if ids is not None:
                    rows.append((ids, v.copy()))
                    continue
                if opened is None and rows:
                    opened, rows = _Shard(rows, k, factor), []
                held.append((own, v.copy()))
        if held:
            yield from answer()

    near = met.select("shard", "turn", "asked", "ids", "v").mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _by_id(rows: DataFrame) -> DataFrame:
    """One vector for each id: the least, where rows repeat an id with several."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _distinct_points(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors with their ``most`` smallest ids; salted, so that a vector of very many rows is many groups first."""
    window = Window.partitionBy("v", "salt").orderBy("vec_id")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = salted.withColumn("n", F.row_number().over(window)).filter(F.col("n") <= most)
    return first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, most).alias("ids"))


ORACLE = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: cast(x AS double))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS size FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5"""


def op10_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id 50 divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
