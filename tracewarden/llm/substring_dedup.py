"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

The reference of a document is every document with a smaller id, whatever its block. Phrases of ``size`` words are the
entries of the reference index, which is dealt into blocks (the buckets of ``exchange``); every document is looked up in
every block that can hold one of its phrases. The parse is greedy: at the first word whose phrase has a source, a factor
opens and grows word by word while the next phrase has a source too; it ends, and the next one opens, where the source
changes or no phrase follows. Phrases across the boundary of two factors were looked up like any other, so no
occurrence is lost between factors, and a factor shorter than ``size`` cannot arise.

Nulls and empty texts have no words. Rows without doc_id are left out, and of repeated ids the largest text counts.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewarden.llm.common import one_per_id, text_bytes
from tracewarden.llm.exchange import SENT, Layout, answered, replies, sender, short
from tracewarden.llm.words import covered, slices

SIZE = 13
FACTOR = "start int, end int, source bigint"


def later_windows(docs: DataFrame, size: int, layout: Layout) -> DataFrame:
    """Answers to the documents whose phrases of ``size`` words also start in a document with a smaller id."""

    def entries(ids, texts):
        for s in slices(texts):
            at, picks = s.windows(size, 0)
            prints = short(s.windows(size, 1)[1])
            yield len(s.data), (ids[s.text_of[at] + s.rows.start], picks, prints)

    sent = docs.select("doc_id", "text").mapInArrow(sender(entries, layout, False), SENT)
    return replies(sent, layout, False)


def sourced(s, ids, told, size: int):
    """For each text of a slice that was answered: (row, places of the phrases with a source, their sources)."""
    at, prints = s.windows(size, 1)
    prints = short(prints)
    row = s.text_of[at]
    cuts = np.searchsorted(row, np.arange(len(s.first)))
    for r in range(len(s.first) - 1):
        answer = told.get(int(ids[s.rows.start + r]))
        if answer is None:
            continue
        known, sources = answer
        order = np.argsort(known)
        known, sources = known[order], sources[order]
        mine = prints[cuts[r] : cuts[r + 1]]
        spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        hit = known[spot] == mine
        yield r, at[cuts[r] : cuts[r + 1]][hit] - s.first[r], sources[spot[hit]]


def factors(at: np.ndarray, sources: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, end, source) from the places of phrases that have a source."""
    if not len(at):
        return []
    new = np.flatnonzero((np.diff(at) > 1) | (np.diff(sources) != 0)) + 1
    begins, last = np.r_[0, new], np.r_[new, len(at)] - 1
    return [(int(at[b]), int(at[e]) + size, int(sources[b])) for b, e in zip(begins, last)]


def duplicate_factors(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, factors): the duplicate spans of each document that has any, in words, with a document they come from.

    Factors can overlap by up to ``size - 1`` words.
    """
    docs = one_per_id(docs, "doc_id", "text")
    layout = Layout.of(text_bytes(docs))

    def work(ids, texts, told):
        out = []
        for s in slices(texts):
            for r, at, sources in sourced(s, ids, told, size):
                out.append((int(ids[s.rows.start + r]), [dict(zip(("start", "end", "source"), f)) for f in factors(at, sources, size)]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))
        return pa.table({"doc_id": pa.array([x[0] for x in out], pa.int64()), "factors": pa.array([x[1] for x in out], kind)})

    return answered(docs, later_windows(docs, size, layout), layout, work, f"doc_id bigint, factors array<struct<{FACTOR}>>")


def without_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, n_factors): ``kept`` has the words outside every duplicate span, by one space."""
    docs = one_per_id(docs, "doc_id", "text")
    layout = Layout.of(text_bytes(docs))
    answers = later_windows(docs, size, layout)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, n_factors int"
    return answered(docs, answers, layout, lambda i, t, told: _kept(i, t, told, size, False), schema)


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The same with the SHA-256 of the kept words in place of the words."""
    docs = one_per_id(docs, "doc_id", "text")
    layout = Layout.of(text_bytes(docs))
    answers = later_windows(docs, size, layout)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_factors int"
    out = answered(docs, answers, layout, lambda i, t, told: _kept(i, t, told, size, True), schema)
    return out.drop("n_factors")


def _kept(ids, texts, told, size: int, hashed: bool) -> pa.Table:
    kept, counts, removed, found = [], [], [], []
    for s in slices(texts):
        hits = {r: (at, sources) for r, at, sources in sourced(s, ids, told, size)} if told else {}
        for r, text in enumerate(texts[s.rows].to_pylist()):
            words = (text or "").encode().split()
            n, gone, k = len(words), 0, 0
            if r in hits:
                cut = covered(n, hits[r][0], size)
                gone, k = int(cut.sum()), len(factors(*hits[r], size))
                words = compress(words, ~cut)
            joined = b" ".join(words)
            kept.append(hashlib.sha256(joined).hexdigest() if hashed else joined.decode())
            counts.append(n)
            removed.append(gone)
            found.append(k)
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        ("kept_sha256" if hashed else "kept"): pa.array(kept, pa.string()), "n_factors": pa.array(found, pa.int32()),
    })
