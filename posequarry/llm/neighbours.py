"""Approximate nearest neighbours from a forest of random-projection trees.

Every tree halves the space at each level by the median along a random
direction. A query walks all trees through one priority queue, nearest cell
first, and takes leaves until they hold enough rows; the rows of those leaves
are then ranked by their exact distance. Leaves are the groups of the join, so
a leaf's rows meet only the queries that chose it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posequarry.llm.common import saved


class Forest:
    """Directions (trees, depth, dim) and the thresholds of all nodes, level by level."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.directions = rng.normal(size=(trees, depth, sample.shape[1]))
        self.thresholds = []
        for along in self.directions:
            levels, node = [], np.zeros(len(sample), np.int64)
            for d in range(depth):
                p = sample @ along[d]
                order = np.lexsort((p, node))
                cut = np.searchsorted(node[order], np.arange(2**d + 1))
                middle = np.minimum((cut[:-1] + cut[1:]) // 2, max(len(sample) - 1, 0))
                level = np.where(cut[1:] > cut[:-1], p[order][middle], 0.0)
                levels.append(level)
                node = node * 2 + (p > level[node])
            self.thresholds.append(levels)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree: (vectors, trees)."""
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for t, along in enumerate(self.directions):
            p = x @ along.T
            for d in range(self.depth):
                out[:, t] = out[:, t] * 2 + (p[:, d] > self.thresholds[t][d][out[:, t]])
        return out

    def search(self, q: np.ndarray, rows: dict[tuple[int, int], int], budget: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) of one queue over all trees, nearest cell first, until ``budget`` rows are in them."""
        p = self.directions @ q / np.linalg.norm(self.directions, axis=2).clip(1e-300)
        scale = np.linalg.norm(self.directions, axis=2).clip(1e-300)
        queue = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        found, held = [], 0
        while queue and held < budget:
            far, t, d, node = heapq.heappop(queue)
            if d == self.depth:
                found.append((t, node))
                held += rows.get((t, node), 0)
                continue
            margin = p[t, d] - self.thresholds[t][d][node] / scale[t, d]
            near = int(margin > 0)
            heapq.heappush(queue, (far, t, d + 1, node * 2 + near))
            heapq.heappush(queue, (max(far, abs(margin)), t, d + 1, node * 2 + 1 - near))
        return found


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    flat = np.concatenate(chunks) if chunks else np.zeros(0)
    return flat.reshape(-1, dim).astype(np.float64)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    trees: int = 8,
    leaf_rows: int = 512,
    budget_rows: int = 8_000,
    budget_share: float = 0.6,
    sample_rows: int = 50_000,
    task_rows: int = 16_384,
    task_queries: int = 4_096,
    seed: int = 7,
) -> DataFrame:
    """The k nearest found for each query: query_id, rank, vec_id, score (Euclidean distance).

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding; a query
    does not find the row with its own id. Vectors that are null, zero, hold a
    null or non-finite component, or are not as long as most, take no part.
    Ties go to the smaller id (null ids take no part). Equal vectors are indexed once, with
    their k + 1 smallest ids, which loses no result and keeps a vector that fills
    a third of the table from filling a leaf. Rows alike in id and vector count once; an id that stands with
    several vectors is a candidate with each. Without usable
    vectors the result is empty; other columns play no part.

    Trees are fitted to ``sample_rows`` vectors at most, all vectors are indexed.
    A search goes on until its leaves hold budget_rows + budget_share * rows
    rows, counting a row again in every tree; the share is what vectors without
    any structure need, and data with structure can do with none. A task ranks about
    ``task_rows`` rows of a leaf for about ``task_queries`` queries.
    """
    usable_rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = usable_rows.groupBy(F.size("embedding").alias("dim")).count()
    most = sizes.orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    alike = usable_rows.filter(F.size("embedding") == dim)
    by_id = W.partitionBy("embedding").orderBy("vec_id")
    distinct = saved(
        alike.withColumn("_at", F.row_number().over(by_id))
        .filter(F.col("_at") <= k + 1)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("rep"), "ids", "embedding"),
        "distinct-vectors",
    )
    asked = queries.select("query_id", F.col("embedding").alias("_asked")).filter(
        F.col("query_id").isNotNull() & usable(F.col("_asked")) & (F.size("_asked") == dim)
    )
    asked = saved(asked.distinct(), "queries")
    # One search per distinct query vector.
    searched = asked.groupBy("_asked").agg(F.min("query_id").alias("q"))
    n = distinct.count()
    sample = distinct.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toArrow()
    depth = max(0, int(np.ceil(np.log2(max(1, min(n / leaf_rows, sample.num_rows / 16))))))
    forest = Forest(_matrix(sample["embedding"], dim), trees, depth, seed)

    def assign(batches):
        for batch in batches:
            part = pa.Table.from_batches([batch])
            leaf = forest.leaves(_matrix(part["embedding"], dim))
            for t in range(trees):
                yield from (
                    part.append_column("tree", pa.array(np.full(len(leaf), t, np.int32)))
                    .append_column("leaf", pa.array(leaf[:, t]))
                    .to_batches()
                )

    kind = dict(distinct.dtypes)["embedding"]
    index = distinct.select("rep", "embedding").mapInArrow(assign, f"rep bigint, embedding {kind}, tree int, leaf bigint")
    sizes = saved(index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("held")), "leaf-sizes")
    held = {(r["tree"], r["leaf"]): r["held"] for r in sizes.toLocalIterator()}
    budget = budget_rows + budget_share * n

    def choose(batches):
        for batch in batches:
            part = pa.Table.from_batches([batch])
            matrix = _matrix(part["embedding"], dim)
            chosen = [forest.search(v, held, budget) for v in matrix]
            at = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
            pairs = np.array([x for c in chosen for x in c], np.int64).reshape(-1, 2)
            yield from (
                part.take(pa.array(at))
                .append_column("tree", pa.array(pairs[:, 0].astype(np.int32)))
                .append_column("leaf", pa.array(pairs[:, 1]))
                .to_batches(max_chunksize=4096)
            )

    asked_kind = dict(asked.dtypes)["_asked"]
    probes = searched.select("q", F.col("_asked").alias("embedding")).mapInArrow(
        choose, f"q bigint, embedding {asked_kind}, tree int, leaf bigint"
    )
    probes = saved(probes, "probes")
    # Only leaves that are probed are ranked: a large one in parts, and one that many queries probe in blocks of these.
    blocks = F.ceil(F.count(F.lit(1)) / task_queries).cast("int").alias("blocks")
    leaves = probes.groupBy("tree", "leaf").agg(blocks).join(sizes, ["tree", "leaf"])
    leaves = saved(leaves.withColumn("parts", F.ceil(F.col("held") / task_rows).cast("int")).drop("held"), "probed-leaves")

    def rank(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and wanted.num_rows:
            x, reps = _matrix(rows["embedding"], dim), rows["rep"].to_numpy()
            y, qs = _matrix(wanted["embedding"], dim), wanted["q"].to_numpy()
            order = np.argsort(reps, kind="stable")
            x, reps = x[order], reps[order]
            step = max(1, (1 << 21) // (len(x) * dim))
            for s in range(0, len(y), step):
                far = np.sqrt(((y[s : s + step, None, :] - x[None]) ** 2).sum(axis=2))
                best = np.argsort(far, axis=1, kind="stable")[:, : k + 1]
                out.append((np.repeat(qs[s : s + step], best.shape[1]), reps[best].ravel(), np.take_along_axis(far, best, 1).ravel()))
        q, rep, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"q": q, "rep": rep, "score": score})

    cell = ["tree", "leaf", "part", "block"]
    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    part, block = (F.pmod(F.xxhash64(key), F.col(n)).cast("int") for key, n in (("rep", "parts"), ("q", "blocks")))
    rows = index.join(leaves, ["tree", "leaf"]).withColumn("part", part).withColumn("block", every("blocks"))
    wanted = probes.join(leaves, ["tree", "leaf"]).withColumn("block", block).withColumn("part", every("parts"))
    rows, wanted = rows.drop("parts", "blocks"), wanted.drop("parts", "blocks")
    near = (
        rows.groupBy(*cell)
        .cogroup(wanted.groupBy(*cell))
        .applyInArrow(rank, "q bigint, rep bigint, score double")
    )
    # The same pair from several trees has one dense rank.
    top = W.partitionBy("q").orderBy("score", "rep")
    firsts = near.withColumn("_at", F.dense_rank().over(top)).filter(F.col("_at") <= k + 1).drop("_at").distinct()
    lists = (
        firsts.join(distinct.select("rep", "ids"), "rep")
        .select("q", "score", F.explode("ids").alias("vec_id"))
        .groupBy("q")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("found"))
    )
    named = searched.join(lists, "q").select(F.col("_asked").alias("_vector"), "found")
    answers = asked.join(named, F.col("_asked") == F.col("_vector")).select(
        "query_id",
        F.posexplode(
            F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        ).alias("at", "hit"),
    )
    return answers.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
