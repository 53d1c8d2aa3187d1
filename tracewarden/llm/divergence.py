"""How far apart are the sources of a language? Smoothed term shares of groups compared in pairs over a quadtree.

* Terms are counted once: tasks count (group, term) inside their batches, one shuffle by (language, term) adds up, and a term is
  kept where enough documents of the language have it. Counting needs no table of terms in the tasks.
* The matrix groups x kept terms of a language is cut into tiles of about ``TILE_GROUPS`` x ``TILE_TERMS``. A task gets two tiles of the
  same terms and builds a K^2-tree (K = 2) of each: bitmaps of the quadrants that hold a count, level by level, and dense blocks for the
  nonzero leaves.
* Both trees are traversed jointly. Where neither has a count, all pairs of the two row ranges are priced at once: the number
  of terms there times the distance of their shares of an unseen term. Leaves that one of them has are subtracted term by term.
  Inside a tile groups and terms are ordered by their counts, which puts the zeros together. Terms that neither tile has are not
  even in the trees; the number of kept terms of the tile tells how many they are.
* Partial sums of the tiles of a pair are added by one more shuffle.

Shares are whole numbers, ``1 + floor(SCALE (count + s) / (N + s V))``, from decimals of 38 digits; sums are exact.

Every row is a document, whatever its id; null text, language and source are ''. A group without kept terms has count 0 for all. A
language without kept terms has pairs of distance 0 and no terms. Ties go to the smaller name by UTF-8 bytes. An empty
table gives no rows. Texts of any length are read in whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import prepared, stored
from tracewarden.llm.words import LOWER

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50

TILE_GROUPS = 64
TILE_TERMS = 2048
LEAF = 32

SLICE_BYTES = 4 << 20

LETTERS = np.zeros(256, bool)  # [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after A-Z became a-z
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


# ---- Counting ----

def _terms(data: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of consecutive texts that end at ``cuts``, and the number of the text of each."""
    data = LOWER[data]
    inside = LETTERS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = cuts[:-1][cuts[:-1] < len(data)]
    begins[edges] = inside[edges]  # a term ends where its text ends
    starts = np.flatnonzero(begins)
    before = np.cumsum(inside)
    offsets = np.r_[before[starts] - 1, before[-1] if len(before) else 0].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return words, np.searchsorted(cuts, starts, "right") - 1


def _counted(groups: np.ndarray, words: pa.Array, owner: np.ndarray):
    """(group, terms, n, docs) of some texts whose groups are small numbers."""
    coded = words.dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs, n = np.unique(owner * width + coded.indices.to_numpy(), return_counts=True)  # a row per document and term
    cells, of = np.unique(groups[pairs // width] * width + pairs % width, return_inverse=True)
    total = np.zeros(len(cells), np.int64)
    np.add.at(total, of, n)
    docs = np.bincount(of, minlength=len(cells))
    return cells // width, coded.dictionary.take(pa.array(cells % width)), total, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): counts inside batches, several rows for one term and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            width = max(1, len(source.dictionary))
            group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
            texts = batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
                words, owner = _terms(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                cells, terms, n, docs = _counted(group[at:end], words, owner)
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(cells // width)).cast(pa.string()), source.dictionary.take(pa.array(cells % width)).cast(pa.string()),
                     terms.cast(pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
                at = end

    return docs.mapInArrow(run, COUNTS)


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of the terms that at least ``least_docs`` documents of their language have."""
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("spread", spread).filter(F.col("spread") >= least_docs).select("lang", "source", "term", "n")


# ---- The joint traversal ----

class Tree:
    """K^2-tree of a tile: ``levels[l]`` tells which quadrants of side LEAF * 2^l hold a cell, ``blocks`` the nonzero leaves."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, unseen: np.ndarray, height: int, width: int):
        self.unseen = np.zeros(height, np.int64)
        self.unseen[: len(unseen)] = unseen
        self.levels = [np.zeros((height // LEAF, width // LEAF), bool)]
        self.levels[0][rows // LEAF, columns // LEAF] = True
        while self.levels[-1].shape != (1, 1):
            low = self.levels[-1]
            low = np.pad(low, [(0, n % 2 if n > 1 else 0) for n in low.shape])
            a, b = (max(1, n // 2) for n in low.shape)
            self.levels.append(low.reshape(a, low.shape[0] // a, b, low.shape[1] // b).any((1, 3)))
        self.places = np.full(self.levels[0].shape, -1)
        self.places[self.levels[0]] = np.arange(self.levels[0].sum())
        leaf_rows = np.nonzero(self.levels[0])[0]
        self.blocks = np.repeat(self.unseen.reshape(-1, LEAF)[leaf_rows][:, :, None], LEAF, 2)
        self.blocks[self.places[rows // LEAF, columns // LEAF], rows % LEAF, columns % LEAF] = values

    def has(self, level: int, row: int, column: int) -> bool:
        return bool(self.levels[level][row, column])

    def leaf(self, row: int, column: int) -> np.ndarray:
        place = self.places[row, column]
        if place >= 0:
            return self.blocks[place]
        return np.repeat(self.unseen[row * LEAF : (row + 1) * LEAF][:, None], LEAF, 1)


def distances(a: Tree, b: Tree, width: int) -> np.ndarray:
    """Sum of absolute differences of each row of ``a`` and each row of ``b`` over ``width`` columns."""
    out = np.zeros((len(a.unseen), len(b.unseen)), np.int64)
    top = max(len(a.levels), len(b.levels)) - 1
    todo = [(top, 0, 0, 0)]
    while todo:
        level, i, j, c = todo.pop()
        at, bt = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        side = LEAF << level
        n = min(width - c * side, side)
        if n <= 0:
            continue
        rows, columns = slice(i * side, (i + 1) * side), slice(j * side, (j + 1) * side)
        if not a.has(at, i, c) and not b.has(bt, j, c):
            out[rows, columns] += n * np.abs(a.unseen[rows, None] - b.unseen[None, columns])
        elif level == 0:
            x, y = a.leaf(i, c)[:, :n], b.leaf(j, c)[:, :n]
            out[rows, columns] += np.abs(x[:, None, :] - y[None, :, :]).sum(2)
        else:
            half = LEAF << (level - 1)
            for k in (2 * i, 2 * i + 1):
                for m in (2 * j, 2 * j + 1):
                    if k * half < len(a.unseen) and m * half < len(b.unseen):
                        todo += [(level - 1, k, m, d) for d in (2 * c, 2 * c + 1) if d * half < width]
    return out


def _ordered(codes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The place of each code when the heaviest comes first."""
    heavy = np.zeros(size, np.float64)
    np.add.at(heavy, codes, weights)
    place = np.empty(size, np.int64)
    place[np.argsort(-heavy, kind="stable")] = np.arange(size)
    return place


def tile_distances(key, cells, groups):
    """Rows (lang, a, b, value) of one pair of tiles; a and b are sources, each pair once, in any order."""
    lang, left, right = key[0].as_py(), key[1].as_py(), key[2].as_py()
    names = groups["source"].to_pylist()
    order = sorted(range(len(names)), key=lambda k: names[k].encode())
    names = [names[k] for k in order]
    tile, unseen = (groups[c].to_numpy()[order] for c in ("tile", "unseen"))
    width = groups["width"][0].as_py()
    number = {n: k for k, n in enumerate(names)}
    row = np.array([number[n] for n in cells["source"].to_pylist()], np.int64)
    terms = cells["term"].combine_chunks().dictionary_encode() if cells.num_rows else None
    values, n = cells["p"].to_numpy(), cells["n"].to_numpy()
    column = _ordered(terms.indices.to_numpy(), n, len(terms.dictionary))[terms.indices.to_numpy()] if cells.num_rows else row
    up = lambda size: -(-max(1, size) // LEAF) * LEAF
    trees, members = [], []
    for side in (left, right):
        own = np.flatnonzero(tile == side)
        here = np.isin(row, own)
        place = _ordered(np.searchsorted(own, row[here]), n[here], len(own))
        back = np.empty(len(own), np.int64)
        back[place] = own
        members.append(back)
        trees.append(Tree(place[np.searchsorted(own, row[here])], column[here], values[here], unseen[back], up(len(own)), up(width)))
        if left == right:
            trees, members = trees * 2, members * 2
            break
    out = distances(*trees, width)[: len(members[0]), : len(members[1])]
    a, b = np.indices(out.shape)
    if left == right:
        once = a < b
        a, b, out = a[once], b[once], out[once]
    pick = lambda side, at: pa.array([names[k] for k in members[side][at.reshape(-1)]], pa.string())
    return pa.table({"lang": pa.array([lang] * out.size, pa.string()), "a": pick(0, a), "b": pick(1, b), "value": pa.array(out.reshape(-1), pa.int64())})


# ---- The audit ----

def _share(count: str, total: str) -> str:
    return (f"CASE WHEN terms > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTHING} AS DECIMAL(20,0))) "
            f"div CAST({total} + {SMOOTHING} * terms AS DECIMAL(20,0)) ELSE 0 END")


def _dealt(name: str, pieces: str):
    return F.expr(f"pmod(xxhash64({name}), {pieces})").cast("int")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, tile_groups: int = TILE_GROUPS, tile_terms: int = TILE_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows with the distance of a group to each other source of its language,
    and ``term`` rows with the ``top`` terms whose share in the group exceeds that in the language most."""
    prepared(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(kept_counts(docs, least_docs))
    terms = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select("lang", "source").groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    groups = stored(
        groups.withColumns({
            "tiles": F.ceil(F.col("groups") / tile_groups).cast("int"),
            "columns": F.greatest(F.lit(1), F.ceil(F.col("terms") / tile_terms)).cast("int"),
            "unseen": F.expr(_share("0", "total")),
        }).withColumn("tile", _dealt("source", "tiles")))

    cells = counts.join(groups.drop("unseen", "groups"), ["lang", "source"]).withColumn("p", F.expr(_share("n", "total")))

    # Terms that stand out in a group.
    here = cells.join(terms, ["lang", "term"]).withColumn("q", F.expr(_share("lang_n", "lang_total"))).filter("p > q")
    own = Window.partitionBy("lang", "source")
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    here = here.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marked = here.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)

    # Distances of pairs, by pairs of tiles.
    widths = terms.join(groups.select("lang", "columns").distinct(), "lang").groupBy(
        "lang", _dealt("term", "columns").alias("part")).agg(F.count("*").alias("width"))
    both = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(
        F.least("tile", x).alias("low"), F.greatest("tile", x).alias("high"))))
    key = ["lang", "low", "high", "part"]
    dealt = cells.withColumn("part", _dealt("term", "columns")).withColumn("at", both).select(
        "lang", "at.low", "at.high", "part", "source", "term", "p", "n")
    members = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).join(widths, ["lang", "part"], "left")
    members = members.withColumn("at", both).select("lang", "at.low", "at.high", "part", "source", "tile", "unseen", F.coalesce("width", F.lit(0)).alias("width"))
    partial = dealt.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(tile_distances, "lang string, a string, b string, value bigint")
    pairs = partial.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", sides.alias("s"), "value").select("lang", "s.source", "s.item", "value")
    apart = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item")))
    return part(apart, "pair").unionByName(part(marked, "term"))


def digest(docs: DataFrame) -> DataFrame:
    return audit(docs)
