"""Hard negatives: rows of another label that score close to, but below, an anchor's nearest rows of its own label.

Scores are whole inner products of ``floor(scale * x)``. Angular triangle filtering decides which pairs are scored:

* ``REFERENCES`` directions are chosen farthest-first from a sample of at most ``FIT`` vectors (and ``FIT_BYTES``); the angle of every vector to every
  direction is stored beside it.
* For angles s and t of two vectors to a direction, the angle between them lies in [|s - t|, min(s + t, 2 pi - s - t)]; the directions
  together give an interval. Its cosines times both norms, widened by more than rounding can do, bound the score.
* Positives: rows of the anchor's label meet it by (label, block). In a block the ``positives`` + 1 best lower bounds give a threshold, and only
  rows whose upper bound reaches it are scored.
* Negatives: anchors now know the windows of scores that they look for, and meet all rows in blocks. Only rows whose interval overlaps a window
  are scored, and of those not such as enough lower bounds inside the window already beat.
* Each block sends its best few, and the best of all blocks are kept.

Blocks hold about ``BLOCK`` rows and ``ASKED`` anchors, dealt by hash, so a label with a third of all rows is many blocks. Equal vectors of one
label are one class with its smallest ids, as many as a result can need, so copies are scored once. Anchors are a share of the rows that the
caller names, so the number of block pairs grows with its square, as the question does.

Rows with a null id or label, a null vector, a null or non-finite component, another length than the most frequent (ties: the shorter; an
empty vector never counts) or a squared length from 2^55 on, whose scores could overflow, take no part. Of rows with one id the smallest
(label, vector) counts. Zero vectors are rows like others. Ties go to the smaller vec_id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import prepared, stored

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score
SCALE = 256

REFERENCES = 16
FIT = 4096
FIT_BYTES = 64 << 20
BLOCK = 4096
ASKED = 512
LIMIT = 2.0**55
SLIP = 1e-6  # more than an angle can be off by rounding


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, q): one whole-numbered vector per id."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                       F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)).filter(finite)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("v") == (size["size"] if size else 0))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, 2.0))
    rows = rows.filter(square < LIMIT).select("vec_id", F.struct("label", F.transform("v", lambda x: F.floor(x * scale)).alias("q")).alias("x"))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.*")


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(class_id, label, q, members): equal vectors of a label under their smallest id, with their ``keep`` smallest ids."""
    rank = F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id"))
    few = rows.withColumn("r", rank).filter(F.col("r") <= keep)
    few = few.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    return few.select(F.col("members")[0].alias("class_id"), "label", "q", "members")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each the farthest from those before it in angle."""
    norms = np.linalg.norm(sample.astype(np.float64), axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles_to(q: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references; those of a zero vector do not matter."""
    x = q.astype(np.float64)
    norms = np.sqrt((x * x).sum(1))
    return norms, np.arccos(np.clip((x @ references.T) / np.where(norms > 0, norms, 1)[:, None], -1, 1))


def score_bounds(norms: np.ndarray, angles: np.ndarray, norm: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers (low, high) that the scores of some rows with a vector of ``norm`` and angles ``own`` lie between."""
    least = np.abs(angles - own).max(1) - SLIP
    most = np.pi - np.abs(np.pi - angles - own).max(1) + SLIP
    size = norms * norm
    margin = 1e-9 * size + 1e-3
    low = np.ceil(size * np.cos(np.minimum(most, np.pi)) - margin)
    high = np.floor(size * np.cos(np.maximum(least, 0)) + margin)
    return low, high


def whole_scores(q: np.ndarray, own: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; doubles hold them while norms allow, since no partial sum exceeds the product of norms."""
    if largest < 2.0**52:
        return (q.astype(np.float64) @ own.astype(np.float64)).astype(np.int64)
    return q @ own


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score, then smallest id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= kth_largest(scores, k))
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))


def near(ids, q, norms, angles, own_q, own_norm, own_angles, k):
    """(ids, scores) of the ``k`` rows with the largest scores."""
    low, high = score_bounds(norms, angles, own_norm, own_angles)
    open_ = np.flatnonzero(high >= kth_largest(low, k))
    scores = whole_scores(q[open_], own_q, own_norm * norms.max())
    best = _first(ids[open_], scores, k)
    return ids[open_][best], scores[best]


def within(ids, q, norms, angles, own_q, own_norm, own_angles, windows, k):
    """Per window (low, high) the (ids, scores) of the ``k`` rows with the largest scores inside it."""
    low, high = score_bounds(norms, angles, own_norm, own_angles)
    wanted = np.zeros(len(ids), bool)
    for a, b in windows:
        inside = (low >= a) & (high <= b)
        wanted |= (high >= max(a, kth_largest(low[inside], k))) & (low <= b)
    open_ = np.flatnonzero(wanted)
    if not len(open_):
        return [(ids[:0], np.zeros(0, np.int64))] * len(windows)
    scores, names, out = whole_scores(q[open_], own_q, own_norm * norms.max()), ids[open_], []
    for a, b in windows:
        fits = np.flatnonzero((scores >= a) & (scores <= b))
        fits = fits[_first(names[fits], scores[fits], k)]
        out.append((names[fits], scores[fits]))
    return out


def _blocks(items: DataFrame, asks: DataFrame, by: list[str], block: int, asked: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (``by``, ``ask_block``, ``row_block``): each block of rows meets each block of askers with the same ``by``."""
    counts = lambda df, name, size: df.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    if by:
        plan = counts(items, "rows", block).join(counts(asks, "asks", asked), by)
        items, asks = items.join(plan, by), asks.join(plan, by)
    else:
        numbers = {"rows": F.lit(counts(items, "n", block).first()["n"]), "asks": F.lit(counts(asks, "n", asked).first()["n"])}
        items, asks = items.withColumns(numbers), asks.withColumns(numbers)
    mine = lambda count: F.pmod(F.xxhash64("class_id"), F.col(count)).cast("int")
    others = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    items = items.withColumn("row_block", mine("rows")).withColumn("ask_block", others("asks")).drop("rows", "asks")
    asks = asks.withColumn("ask_block", mine("asks")).withColumn("row_block", others("rows")).drop("rows", "asks")
    return items, asks


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, references: int = REFERENCES, block: int = BLOCK, asked: int = ASKED,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that fit ``is_anchor``."""
    spark = prepared(rows.sparkSession)
    valid = stored(usable(rows, scale))
    keep = max(positives + 1, negatives)
    plain = stored(classes(valid, keep))
    length = plain.select(F.size("q").alias("n")).first()
    if length is None:
        return _empty(spark, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    bound = max(1, min(FIT, FIT_BYTES // (8 * length["n"])))
    sample = plain.select("class_id", "q").orderBy(F.xxhash64("class_id"), "class_id").limit(bound).toArrow()
    axes = directions(matrix(sample["q"]), references)

    def measure(batches):
        for batch in batches:
            norms, angles = angles_to(matrix(batch.column(2)), axes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(norms), pa.FixedSizeListArray.from_arrays(angles.reshape(-1), angles.shape[1]).cast(pa.list_(pa.float64()))],
                ["class_id", "label", "q", "norm", "angles"])

    shape = "class_id bigint, label string, q array<bigint>, norm double, angles array<double>"
    items = stored(plain.select("class_id", "label", "q").mapInArrow(measure, shape))
    anchors = valid.filter(is_anchor).join(plain.select("class_id", "label", "q"), ["label", "q"])
    anchors = stored(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("class_id").alias("asker")))
    asks = stored(items.join(anchors.select(F.col("asker").alias("class_id")).distinct(), "class_id", "left_semi"))
    if asks.isEmpty():
        return _empty(spark, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    parts = ("q", "norm", "angles")

    def sides(left: pa.Table, right: pa.Table):
        ids, ask_ids = left["class_id"].to_numpy(), right["class_id"].to_numpy()
        q, norm, angles = matrix(left["q"]), left["norm"].to_numpy(), matrix(left["angles"])
        asker = list(zip(ask_ids, matrix(right["q"]), right["norm"].to_numpy(), matrix(right["angles"])))
        return ids, (q, norm, angles), asker

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, data, askers = sides(left, right)
            for asker, *own in askers:
                names, scores = near(ids, *data, *own, positives + 1)
                found.append((np.full(len(names), asker), names, scores))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("asker", "class_id", "score"), map(pa.array, columns))))

    key = ["label", "ask_block", "row_block"]
    left, right = _blocks(items, asks, ["label"], block, asked)
    scored = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(nearest, "asker bigint, class_id bigint, score bigint")
    own_rows = stored(_expanded(scored, plain, ["asker"], positives + 1))  # (asker, score, vec_id, r)

    scores = own_rows.select("asker", "score").distinct().groupBy("asker").agg(F.sort_array(F.collect_list("score")).alias("scores"))
    asks = asks.join(scores, asks["class_id"] == scores["asker"]).drop("asker")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, data, askers = sides(left, right)
            labels = np.array(left["label"].to_pylist(), object)
            others = {}
            for (asker, *own), label, scores in zip(askers, right["label"].to_pylist(), right["scores"].to_pylist()):
                if label not in others:
                    at = np.flatnonzero(labels != label)
                    others = {label: (ids[at], [x[at] for x in data])}  # of one label at a time
                names, rest = others[label]
                if not len(names):
                    continue
                windows = [(-(-low * s // 100), high * s // 100) for s in scores]
                for s, (some, got) in zip(scores, within(names, *rest, *own, windows, negatives)):
                    found.append((np.full(len(some), asker), np.full(len(some), s, np.int64), some, got))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("asker", "positive_score", "class_id", "score"), map(pa.array, columns))))

    key = ["ask_block", "row_block"]
    left, right = _blocks(items, asks, [], block, asked)
    right = right.select("class_id", "label", *parts, "scores", *key)
    scored = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        hard, "asker bigint, positive_score bigint, class_id bigint, score bigint")
    best = _expanded(scored, plain, ["asker", "positive_score"], negatives)

    firsts = own_rows.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    chosen = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.join(firsts, "asker").select("anchor_id", "asker", F.explode(chosen).alias("p"))
    pairs = pairs.select("anchor_id", "asker", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return pairs.join(best, ["asker", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _expanded(scored: DataFrame, plain: DataFrame, by: list[str], k: int) -> DataFrame:
    """(``by``, score, vec_id, r): the ``k`` best rows of the classes found; the k best classes hold them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "class_id"))
    top = scored.withColumn("r", rank).filter(F.col("r") <= k).drop("r")
    members = top.join(plain.select("class_id", "members"), "class_id").select(*by, "score", F.explode("members").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return members.withColumn("r", rank).filter(F.col("r") <= k)


def digest(rows: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; every seventh id has its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
