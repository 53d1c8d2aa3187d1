"""Suffix-array dedup with sparse suffixes.

Only suffixes that start at content-selected places are kept: in every stretch of ``size - core + 1`` word places, the
place whose run of ``core`` words hashes lowest (a minimiser). Equal stretches select equal places in any document, so
two documents that share ``size`` words share a kept suffix inside them, although only about 2 in ``size`` are kept.

1. The kept suffixes are dealt to buckets by their first ``core`` words, sorted there, and compared with their
   neighbours: equal neighbours from different documents seed a match (``exchange``).
2. Seeds are extended left and right: every run of ``size`` words around a seed is matched with the runs around the same
   seed elsewhere, so the extension reaches whatever occurrence is longest, not just that of one neighbour.

A word is a duplicate if it lies in a run of ``size`` words that also starts in a document with a smaller id.

Nulls and empty texts have no words; shorter texts no run. Rows without doc_id are left out, and of repeated ids the
largest text counts. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import one_per_id, text_bytes
from tracewarden.llm.exchange import PACK, SENT, Layout, answered, bucket_hash, packed, replies, sender, short
from tracewarden.llm.substring_dedup import sourced
from tracewarden.llm.words import covered, mixed, rolled, slices, spans

SIZE = 50
CORE = 11


def minimisers(s, core: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of the core there) of the kept suffixes of a slice, by number of word."""
    at, prints = s.windows(core, 0)
    span = size - core + 1
    if len(at) < span:
        return at[:0], prints[:0]
    # The lowest hash of each stretch by doubling; ranks carry the place along.
    low = prints.copy()
    step = 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = span - step
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    whole = at[span - 1 :] - at[: len(at) - span + 1] == span - 1  # the stretch lies in one text
    whole &= s.text_of[at[span - 1 :]] == s.text_of[at[: len(at) - span + 1]]
    # A place is kept if some stretch of its text that holds it has its hash as the lowest.
    low, first = low[whole], np.flatnonzero(whole)
    keep = np.zeros(len(at) + 1, bool)
    new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (np.diff(first) > 1)]) if len(low) else first
    last = np.r_[new[1:], len(low)] - 1 if len(low) else first
    for a, b in zip(first[new], first[last]):
        keep[a : b + span] |= prints[a : b + span] == low[np.searchsorted(first, a)]
    keep = np.flatnonzero(keep[:-1])
    return at[keep], prints[keep]


def duplicate_spans(docs: DataFrame, size: int = SIZE, core: int = CORE) -> DataFrame:
    """(doc_id, n_words, n_duplicate, spans): spans are (start, end) in words, merged where they touch or overlap."""
    docs = one_per_id(docs, "doc_id", "text")
    total = text_bytes(docs)
    seeds_layout, layout = Layout.of(total, 2 / (size - core + 2)), Layout.of(total, 0.5)
    seeds_layout = Layout(seeds_layout.buckets, layout.parts)

    def suffixes(ids, texts):
        for s in slices(texts):
            at, prints = minimisers(s, core, size)
            yield len(s.data), (ids[s.text_of[at] + s.rows.start], bucket_hash(prints), short(prints))

    sent = docs.select("doc_id", "text").mapInArrow(sender(suffixes, seeds_layout, True), SENT)
    seeds = replies(sent, seeds_layout, True)

    def extend(ids, texts, told):
        """The runs of ``size`` words that hold a seed, packed for the second exchange."""
        held = []
        for s in slices(texts):
            places, prints = minimisers(s, core, size)
            row = s.text_of[places]
            cuts = np.searchsorted(row, np.arange(len(s.first)))
            near = []
            for r in range(len(s.first) - 1):
                answer = told.get(int(ids[s.rows.start + r]))
                if answer is not None:
                    mine = slice(cuts[r], cuts[r + 1])
                    near.append(places[mine][np.isin(short(prints[mine]), answer[0])])
            if not near:
                continue
            seed = np.concatenate(near)
            at, picks = s.windows(size, 0)
            marks = np.zeros(len(s.hashes) + 1, np.int32)
            np.add.at(marks, np.maximum(seed - (size - core), 0), 1)
            np.add.at(marks, seed + 1, -1)
            here = (np.cumsum(marks[:-1]) > 0)[at]
            other = short(mixed(rolled(s.hashes, size, 1)))[at[here]]
            held.append((ids[s.text_of[at[here]] + s.rows.start], picks[here], other))
        out = packed(tuple(np.concatenate(c) for c in zip(*held)), layout, False) if held else None
        return pa.Table.from_batches([out]) if out is not None else empty_sent()

    runs = replies(answered(docs, seeds, seeds_layout, extend, SENT), layout, False)

    def finish(ids, texts, told):
        out = []
        for s in slices(texts):
            hits = {r: at for r, at, _ in sourced(s, ids, told, size)} if told else {}
            for r, n in enumerate(np.diff(s.first)):
                at = hits.get(r, np.zeros(0, np.int64))
                begin, end = spans(at, size)
                out.append((int(ids[s.rows.start + r]), int(n), int(covered(int(n), at, size).sum()),
                            [{"start": int(a), "end": int(b)} for a, b in zip(begin, end)]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()),
                         "n_duplicate": pa.array(columns[2], pa.int64()), "spans": pa.array(columns[3], kind)})

    schema = "doc_id bigint, n_words bigint, n_duplicate bigint, spans array<struct<start int, end int>>"
    return answered(docs, runs, layout, finish, schema)


def empty_sent() -> pa.Table:
    return pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), *[(n, pa.binary()) for n in PACK]]).empty_table()


def digest(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_duplicate, n_spans, span_list): the spans as text, ``start-end`` joined by commas."""
    one = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return duplicate_spans(docs, size).select(
        "doc_id", "n_words", "n_duplicate", F.size("spans").cast("bigint").alias("n_spans"), F.array_join(one, ",").alias("span_list")
    )
