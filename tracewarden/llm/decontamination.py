"""Benchmark decontamination with a distributed positional inverted index.

1. Every item is cut into windows of ``size`` consecutive words (a shorter item is one window); equal windows count once.
2. One pass over all documents counts the terms of the windows; a window's anchors are its rarest ``anchors`` terms.
   A window with a term that no document has is dropped.
3. A second pass stores the index: a posting (term, doc_id, places) for each anchor term of each document.
4. Lists are intersected from the rarest term on. Its postings give the candidate starts (place minus offset in the
   window); the next terms are looked up by (term, document), so a row of the first list meets at most one posting of each
   other list. What has the other anchors at their offsets is a phrase candidate, what has them within ``near`` words of the
   rarest is a proximity match.
5. Phrase candidates are compared word by word with their document.

Which tokens a task looks at is decided by a bitmap of term hashes of fixed size (``FILTER_BITS``), so nothing that grows
with the benchmark is broadcast; what passes by chance is dropped by the join.

Nulls and empty texts have no words. Rows without an id are left out, and of repeated ids the largest text counts.
Empty documents give an empty result, an empty benchmark no hits. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import one_per_id, stored
from tracewarden.llm.words import ALNUM, LOWER, covered, slices

SIZE = 10
ANCHORS = 3
NEAR = 20
FILTER_BITS = 22
_SPLIT = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, words, terms): the windows of each item; terms are the word hashes."""

    def run(batches):
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for s in slices(batch.column(1), ALNUM, lower=True):
                out = []
                for r, (a, b) in enumerate(zip(s.first[:-1], s.first[1:])):
                    words = [s.word(i).decode() for i in range(a, b)]
                    terms = s.hashes[a:b].view(np.int64)
                    for k in range(max(1, len(words) - size + 1) if words else 0):
                        out.append((ids[s.rows.start + r], words[k : k + size], terms[k : k + size]))
                columns = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item_id", "words", "terms"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id bigint, words array<string>, terms array<bigint>")


def term_filter(terms: DataFrame) -> np.ndarray:
    """Bitmap of hashed terms: at most 2^FILTER_BITS small numbers reach the driver, whatever the number of terms."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    spots = terms.select(F.col("term").bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("b")).distinct().toArrow()
    bits[spots["b"].to_numpy()] = True
    return np.packbits(bits)


def _passing(s, packed: np.ndarray) -> np.ndarray:
    spot = (s.hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return np.flatnonzero((packed[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1)


def term_counts(docs: DataFrame, packed: np.ndarray) -> DataFrame:
    """(term, n): occurrences in all documents of the terms that pass the filter."""

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(0), ALNUM, lower=True):
                terms, n = np.unique(s.hashes[_passing(s, packed)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n, pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, packed: np.ndarray) -> DataFrame:
    """(doc_id, n_words, term, places): one row per document and term, and one without a term per document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(1), ALNUM, lower=True):
                at = _passing(s, packed)
                row, term = s.text_of[at], s.hashes[at]
                order = np.lexsort((term, row))
                at, row, term = at[order], row[order], term[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(at) else at
                count = len(s.first) - 1
                cuts = np.r_[new, np.full(count + 1, len(at))]
                places = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at - s.first[row], pa.int32()))
                whole = np.r_[row[new], np.arange(count)]
                terms = pa.array(np.r_[term[new].view(np.int64), np.zeros(count, np.int64)], mask=np.arange(len(whole)) >= len(new))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s.rows][whole], pa.int64()), pa.array(np.diff(s.first)[whole], pa.int64()), terms, places],
                    ["doc_id", "n_words", "term", "places"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, term bigint, places array<int>")


def anchored(windows: DataFrame, counts: DataFrame, anchors: int) -> DataFrame:
    """(win, words, offset1, term1, ...): the rarest terms of each window, rarest first, ties by offset."""
    each = windows.select("win", F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left")
    rare = each.groupBy("win").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("a")
    ).filter(F.col("a")[0]["n"] > 0)
    picked = [
        F.get("a", F.lit(i))[field].alias(f"{field}{i + 1}") for i in range(anchors) for field in ("offset", "term")
    ]
    return windows.select("win", "words").join(rare.select("win", *picked), "win")


class Matches:
    """``index``: the stored postings; ``phrases``: (doc_id, n_hit, wins), exact; ``near``: (doc_id, win);
    ``uses``: (win, item_id)."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, size: int = SIZE, anchors: int = ANCHORS, near: int = NEAR):
        items = stored(item_windows(benchmark, size).withColumn("win", F.md5(F.concat_ws(" ", "words"))))
        self.uses = items.select("win", "item_id").distinct()
        windows = items.select("win", "words", "terms").dropDuplicates(["win"])
        counts = term_counts(docs, term_filter(windows.select(F.explode("terms").alias("term"))))
        chosen = stored(anchored(windows, counts, anchors))
        terms = chosen.select(F.explode(F.array(*[f"term{i + 1}" for i in range(anchors)])).alias("term"))
        self.index = stored(postings(docs, term_filter(terms.filter("term IS NOT NULL"))))
        lists = self.index.filter("term IS NOT NULL").select("term", "doc_id", "places")
        found = chosen.join(lists.withColumnRenamed("term", "term1"), "term1").withColumn("place", F.explode("places"))
        found = found.withColumn("start", F.col("place") - F.col("offset1")).withColumn("phrase", F.col("start") >= 0).drop("places")
        for i in range(2, anchors + 1):
            found = self._narrowed(found, lists, i, near)
        found = stored(found.select("doc_id", "win", "start", "phrase"))
        self.near = found.select("doc_id", "win").distinct()
        spots = found.filter("phrase").select("doc_id", "win", "start").join(chosen.select("win", "words"), "win")
        listed = spots.groupBy("doc_id").agg(F.collect_list(F.struct("start", "win", "words")).alias("spots"))
        self.phrases = docs.select("doc_id", "text").join(listed, "doc_id").mapInArrow(_checked, "doc_id bigint, n_hit bigint, wins array<string>")

    @staticmethod
    def _narrowed(found: DataFrame, lists: DataFrame, i: int, near: int) -> DataFrame:
        """Keep rows with anchor ``i`` near the first; ``phrase`` stays where it is at its own offset."""
        term, spot = f"term{i}", F.col("start") + F.col(f"offset{i}")
        some = lists.select(F.col("term").alias(term), "doc_id", F.col("places").alias("places"))
        close: Column = F.exists("places", lambda p: F.abs(p - F.col("place")) <= near)
        both = found.join(some, [term, "doc_id"], "left").filter(F.col(term).isNull() | close)
        return both.withColumn("phrase", F.col("phrase") & (F.col(term).isNull() | F.array_contains("places", spot))).drop("places")


def _checked(batches):
    """Compare the candidates of a document with its words."""
    for batch in batches:
        out = []
        for doc, text, spots in zip(*(batch.column(i) for i in range(3))):
            words = (text.as_py() or "").encode().translate(_SPLIT).split()
            at, sizes, wins = [], [], set()
            for spot in spots.as_py():
                window = [w.encode() for w in spot["words"]]
                if words[spot["start"] : spot["start"] + len(window)] == window:
                    at.append(spot["start"])
                    sizes.append(len(window))
                    wins.add(spot["win"])
            if wins:
                hit = covered(len(words), np.array(at), np.array(sizes))
                out.append((doc.as_py(), int(hit.sum()), sorted(wins)))
        columns = list(zip(*out)) or [[]] * 3
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_hit", "wins"])


def digest(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a window
    whose anchors all lie near its rarest)."""
    docs, benchmark = one_per_id(docs, "doc_id", "text"), one_per_id(benchmark, "item_id", "text")
    m = Matches(docs, benchmark, size, near=near)
    hits = stored(m.phrases)
    items = hits.select("doc_id", F.explode("wins").alias("win")).join(m.uses, "win").groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    close = m.near.join(m.uses, "win").select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_near"))
    whole = m.index.filter("term IS NULL").select("doc_id", "n_words")
    whole = whole.join(hits.select("doc_id", "n_hit"), "doc_id", "left").join(items, "doc_id", "left").join(close, "doc_id", "left")
    none = F.lit(0).cast("bigint")
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce(F.size("items").cast("bigint"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"),
    )
