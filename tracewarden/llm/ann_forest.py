"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

* Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product is the
  smallest distance; queries get a zero there.
* ``trees`` trees are fitted on a sample of at most ``FIT`` vectors (smallest hashes of vec_id). A node splits along the
  difference of two of its sample vectors, at the median; leaves hold about 4 sqrt(n) rows. The model is bounded by FIT.
* Every vector is put into its leaf of every tree. A leaf with many rows is cut into blocks of ``BLOCK`` rows by hash.
* A query has one queue for the leaves of all trees, ordered by the squared margins of the planes it would have to cross.
  It takes leaves from the queue until they hold ``reach`` times the number of vectors, so rows that several trees offer count
  again.
* Candidates of a block are scored exactly, in double precision on the given components, and the best of all blocks kept.

Equal vectors are one class with its ``k + 1`` smallest ids, which is all that a result can need; they are found and
scored once, also if a third of all rows are equal.

The default ``reach`` is what a recall above 0.9 costs on vectors drawn from a sphere in 64 dimensions, where the nearest
neighbours are hardly nearer than the rest: more than half of all vectors are scored. Clustered data needs a small part of it.

Null, zero, non-finite vectors and those of another length than the most frequent take no part; of rows with the same id
the smallest vector counts; rows without id are left out. Ties go to the smaller vec_id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import stored

K = 20
TREES = 4
FIT = 65_536
REACH = 1.5
BLOCK = 4096
LEAST_LEAF = 32


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): one finite, non-zero vector of the common length per id."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("v") == (size["size"] if size else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Forest:
    """Per tree a heap of nodes: ``planes`` and ``cuts`` of the inner ones, ``leaf`` number or -1."""

    def __init__(self, sample: np.ndarray, norm: float, trees: int, leaf_rows: int, seed: int = 7):
        self.norm = norm
        rng = np.random.default_rng(seed)
        points = self.lifted(sample)
        self.trees = [self._grown(points, max(1, leaf_rows), rng) for _ in range(trees)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))]

    @staticmethod
    def _grown(points, leaf_rows, rng):
        planes, cuts, kids, leaf, todo, leaves = [], [], [], [], [np.arange(len(points))], 0
        while len(leaf) < len(todo):  # nodes in order of breadth
            rows = todo[len(leaf)]
            plane, cut, sides = np.zeros(points.shape[1]), 0.0, None
            if len(rows) > leaf_rows:
                a, b = points[rng.choice(rows, 2, replace=False)]
                plane = a - b
                plane /= np.linalg.norm(plane) or 1.0
                along = points[rows] @ plane
                cut = float(np.median(along))
                sides = rows[along <= cut], rows[along > cut]
                sides = sides if min(map(len, sides)) else None
            planes.append(plane)
            cuts.append(cut)
            if sides is None:
                leaf.append(leaves)
                kids.append((0, 0))
                leaves += 1
            else:
                leaf.append(-1)
                kids.append((len(todo), len(todo) + 1))
                todo.extend(sides)
        return {"planes": np.array(planes), "cuts": np.array(cuts), "kids": np.array(kids), "leaf": np.array(leaf), "leaves": leaves}

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, as (vectors, trees)."""
        points, out = self.lifted(x), []
        for tree in self.trees:
            at = np.zeros(len(points), np.int64)
            while (inner := tree["leaf"][at] < 0).any():
                here = at[inner]
                right = (points[inner] * tree["planes"][here]).sum(1) > tree["cuts"][here]
                at[inner] = tree["kids"][here, right.astype(int)]
            out.append(tree["leaf"][at])
        return np.stack(out, 1) if out else np.zeros((len(points), 0), np.int64)

    def queue(self, q: np.ndarray) -> np.ndarray:
        """Penalty of every leaf for each query, trees one after the other: squared margins of the planes in between."""
        points, out = np.c_[q, np.zeros(len(q))], []
        for tree in self.trees:
            cost = np.zeros((len(q), len(tree["leaf"])))
            for node in np.flatnonzero(tree["leaf"] < 0):
                gap = points @ tree["planes"][node] - tree["cuts"][node]
                left, right = tree["kids"][node]
                cost[:, left] = cost[:, node] + np.maximum(gap, 0) ** 2
                cost[:, right] = cost[:, node] + np.maximum(-gap, 0) ** 2
            ends = np.flatnonzero(tree["leaf"] >= 0)
            out.append(cost[:, ends[np.argsort(tree["leaf"][ends])]])
        return np.concatenate(out, 1)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(class_id, v, members): equal vectors under their smallest id, with their k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("r", rank).filter(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.col("members")[0].alias("class_id"), "v", "members")


def fitted(items: DataFrame, trees: int = TREES, fit: int = FIT) -> Forest | None:
    """A forest for (class_id, v), or None for no rows."""
    stats = items.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("top")).first()
    if not stats["n"]:
        return None
    sample = items.select("class_id", "v").orderBy(F.xxhash64("class_id"), "class_id").limit(fit).toArrow()
    leaf = max(LEAST_LEAF, 4 * math.isqrt(stats["n"])) * sample.num_rows / stats["n"]
    forest = Forest(matrix(sample["v"]), math.sqrt(stats["top"]), trees, math.ceil(leaf))
    forest.rows = stats["n"]
    return forest


def search(rows: DataFrame, is_query, k: int = K, trees: int = TREES, reach: float = REACH, fit: int = FIT, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each row of ``rows`` that fits the condition ``is_query``."""
    valid = stored(usable(rows))
    items = stored(classes(valid, k))
    forest = fitted(items, trees, fit)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if forest is None:
        return rows.sparkSession.createDataFrame([], schema)
    queries = valid.filter(is_query).join(items.select("class_id", "v"), "v").select(F.col("vec_id").alias("query_id"), "class_id")
    queries = stored(queries)

    def place(batches):
        for batch in batches:
            leaves = forest.placed(matrix(batch.column(1)))
            n, t = leaves.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(leaves.reshape(-1).astype(np.int32)),
                 batch.column(0).take(pa.array(np.repeat(np.arange(n), t))), batch.column(1).take(pa.array(np.repeat(np.arange(n), t)))],
                ["tree", "leaf", "class_id", "v"])

    vector = dict(items.dtypes)["v"]
    placed = items.select("class_id", "v").mapInArrow(place, f"tree int, leaf int, class_id bigint, v {vector}")
    # One row per leaf of the model.
    sizes = np.zeros((trees, max(t["leaves"] for t in forest.trees)), np.int64)
    for r in placed.groupBy("tree", "leaf").count().toLocalIterator():
        sizes[r["tree"], r["leaf"]] = r["count"]
    blocks = np.maximum(-(-sizes // block), 1)
    flat = np.array([(t, i) for t, tree in enumerate(forest.trees) for i in range(tree["leaves"])])
    wanted = reach * forest.rows

    def visit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                order = np.argsort(forest.queue(matrix(some.column(1))), axis=1, kind="stable")
                held = sizes[flat[order][..., 0], flat[order][..., 1]]
                taken = np.cumsum(held, 1) - held < wanted
                row, spot = np.nonzero(taken)
                tree, leaf = flat[order[row, spot]].T
                times = blocks[tree, leaf]
                row, tree, leaf = (np.repeat(x, times) for x in (row, tree, leaf))
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int32)) for x in (tree, leaf, piece)] + [c.take(pa.array(row)) for c in some.columns],
                    ["tree", "leaf", "piece", "class_id", "v"])

    asked = items.join(queries.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "v")
    visits = asked.mapInArrow(visit, f"tree int, leaf int, piece int, class_id bigint, v {vector}")
    names = rows.sparkSession.createDataFrame(
        [(int(t), int(i), int(blocks[t, i])) for t, i in flat], "tree int, leaf int, pieces int")  # a row per leaf of the model
    cut = F.pmod(F.xxhash64("class_id"), F.col("pieces")).cast("int")
    index = placed.join(F.broadcast(names), ["tree", "leaf"]).select("tree", "leaf", cut.alias("piece"), "class_id", "v")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = left["class_id"].to_numpy(), []
        if len(ids) and right.num_rows:
            x, q, asks = matrix(left["v"]), matrix(right["v"]), right["class_id"].to_numpy()
            for a in range(0, len(q), 256):
                near = np.einsum("ij,kj->ik", q[a : a + 256], x)  # the same sum whatever the place in the block
                if len(ids) > k + 1:
                    least = np.partition(near, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                    row, at = np.nonzero(near >= least[:, None])
                else:
                    row, at = (x.reshape(-1) for x in np.indices(near.shape))
                found.append((asks[a + row], ids[at], near[row, at]))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("asker", "class_id", "score"), map(pa.array, columns))))

    keys = ["tree", "leaf", "piece"]
    scored = index.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(score, "asker bigint, class_id bigint, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "class_id")
    top = scored.groupBy("asker", "class_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    members = top.join(items.select("class_id", "members"), "class_id").select("asker", "score", F.explode("members").alias("vec_id"))
    first = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    lists = members.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    named = queries.join(lists, queries["class_id"] == lists["asker"]).select("query_id", F.posexplode(others).alias("pos", "x"))
    return named.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def digest(rows: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 20, against all rows."""
    return search(rows, F.col("vec_id") % 20 == 0)
