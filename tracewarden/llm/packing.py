"""Packing of tokenised documents into sequences: bounded-space online best fit, leftovers merged in rounds.

* A document is the ids of its text and one closing id. Its whole windows become sequences of their own; the rest is an item.
* Each task keeps ``open_windows`` open. An item goes where it leaves the smallest gap; if it fits nowhere, a new window is opened,
  or, when all are open, the fullest is emitted. A gap above ``slack`` is first filled with the head of the item (documents may be
  cut), so no emitted window is padded by more than ``slack`` ids.
* What is open when a partition ends is a leftover, a row per piece. Leftovers of ``FAN`` partitions are packed in one task by the
  same rule, whole windows being the items, until one group is left. So a task sees at most FAN x ``open_windows`` windows, and the
  number of rounds is the logarithm of the number of partitions.
* The last windows are joined and cut; what is left of them after the full ones is cut into powers of two, which need no padding.

Ids come from ``tokenizers``. Texts are cut at borders that the tokenizer's own splitting always has (``borders``); each distinct
stretch is encoded once, many in one call, and its ids are used wherever it occurs (``Encoder``). This holds for byte-level
tokenizers that split words, numbers, signs and white space, as the default one does.

Every row is a document, also with an id that is repeated or null; a null or empty text is the closing id alone. A text
may be of any length: its sequences are emitted as it is read. Ties between windows go to the older one. An empty table gives no
pieces. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import prepared, stored

SIZE = 2048
OPEN = 64
SLACK = 16
FAN = 8
CLOSING = 1

CACHED = 1_000_000  # short stretches whose ids a task remembers
SLICE_BYTES = 8 << 20
OUT_BYTES = 4 << 20
PIECES = "level int, place bigint, window bigint, closed boolean, offset bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"

_BLANK = np.zeros(256, bool)  # ASCII white space
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MAYBE_BLANK = _BLANK.copy()
_MAYBE_BLANK[0x1C:0x20] = True
_WIDE = np.zeros(256, bool)  # first bytes of white space of three bytes
_WIDE[[0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x30] = _SIGN[0x3A:0x41] = _SIGN[0x5B:0x61] = _SIGN[0x7B:0x7F] = True
# At most one space, then no white space: between line breaks such a stretch is split as by itself.
_PLAIN = re.compile(rb" ?(?:[\x21-\x7e]|[\xc3-\xdf][\x80-\xbf])+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def borders(data: np.ndarray) -> np.ndarray:
    """Where white space begins after a character that surely is none, a letter is followed by a sign, or a single line
    break or tab by a letter."""
    begins = _BLANK[data]
    before = np.r_[np.uint8(0x20), data[:-1]]
    begins &= ~_MAYBE_BLANK[before]
    if len(data) > 2:
        begins[2:] &= ~((data[:-2] == 0xC2) & ((before[2:] == 0xA0) | (before[2:] == 0x85)))
    if len(data) > 3:
        begins[3:] &= ~_WIDE[data[:-3]]
    single = np.r_[False, begins[:-1]] & (before != 0x20) & _LETTER[data]
    letter = _LETTER[before]
    if len(data) > 2:
        letter[2:] |= (data[:-2] == 0xC3) & (before[2:] >= 0x80) & (before[2:] != 0x97) & (before[2:] != 0xB7)
    return np.flatnonzero(begins | single | (letter & _SIGN[data]))


class Encoder:
    """Ids of many texts at once. Remembers the ids of short stretches, about ``CACHED`` of them, in one flat array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        # A byte-level vocabulary writes each byte as one character.
        self.widths = np.zeros(self.model.get_vocab_size(), np.int64)
        for word, i in self.model.get_vocab().items():
            self.widths[i] = len(word)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # number of a stretch
        self.flat, self.first, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array, closing: int = CLOSING) -> Iterator[np.ndarray]:
        """The ids of each text and the closing one, slice by slice."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            cuts = offsets[at : end + 1] - offsets[at]
            yield from self._slice(raw[offsets[at] : offsets[end]], cuts, closing)
            at = end

    def _slice(self, data: np.ndarray, cuts: np.ndarray, closing: int) -> Iterator[np.ndarray]:
        edge = np.zeros(len(data) + 1, bool)
        if len(data):
            edge[borders(data)] = True
        edge[cuts] = True
        edges = np.flatnonzero(edge)
        whole = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = whole.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.sizes[number]
        ends = np.r_[0, np.cumsum(lengths)]
        every = self.flat[np.repeat(self.first[number] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(edges, cuts)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.append(every[a:b], np.uint32(closing))

    def _numbers(self, stretches: list[bytes]) -> np.ndarray:
        """The number of each of some distinct stretches; new ones are encoded."""
        if len(self.known) > CACHED or len(self.flat) > 8 * CACHED:
            self._forget()
        new = [s for s in stretches if s not in self.known]
        if not new:
            return np.array([self.known[s] for s in stretches], np.int64)
        fresh: dict[bytes, np.ndarray] = {}
        plain = [s for s in new if _PLAIN.fullmatch(s)]
        for a in range(0, len(plain), 4096):
            fresh.update(self._together(plain[a : a + 4096]))
        for s in new:
            if s not in fresh:
                fresh[s] = np.array(self.model.encode(s.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        sizes = np.array([len(x) for x in fresh.values()], np.int64)
        count = len(self.first)
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.concatenate([self.flat, *fresh.values()])
        self.known.update(zip(fresh, range(count, count + len(fresh))))
        out = np.array([self.known[s] for s in stretches], np.int64)
        for s in [s for s in new if len(s) > 64]:  # long ones are of this slice only
            del self.known[s]
        return out

    def _together(self, plain: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of stretches encoded as the lines of one text; those whose ends no id respects are left out."""
        text = b"\n".join(plain)
        ids = np.array(self.model.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        at = np.r_[0, np.cumsum(self.widths[ids])]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        if at[-1] != len(text):
            return {}
        i, j = np.searchsorted(at, starts), np.searchsorted(at, ends)
        good = (at[i] == starts) & (at[j] == ends)
        return {s: ids[a:b] for s, a, b, ok in zip(plain, i.tolist(), j.tolist(), good.tolist()) if ok}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks that a worker runs."""
    return Encoder(path)


# A piece is (doc_id, start, doc_tokens, ids); a window or an item is a list of pieces.


def cut(pieces: list, at: int) -> tuple[list, list]:
    """The first ``at`` ids of some pieces, and the rest."""
    head, rest = [], list(pieces)
    while at:
        doc, start, total, ids = rest[0]
        if len(ids) <= at:
            head.append(rest.pop(0))
            at -= len(ids)
        else:
            head.append((doc, start, total, ids[:at]))
            rest[0] = (doc, start + at, total, ids[at:])
            at = 0
    return head, rest


class Windows:
    """The open windows of one partition or of one group of leftovers."""

    def __init__(self, size: int, open_windows: int, slack: int):
        self.size, self.most, self.slack = size, open_windows, slack
        self.gaps: list[tuple[int, int]] = []  # (gap, number of the window), smallest gap first
        self.held: dict[int, list] = {}
        self.count = 0

    def put(self, item: list, n: int) -> Iterator[tuple[int, list]]:
        """Place an item of ``n`` <= size ids; yields (number, pieces) of windows that are finished by it."""
        while n:
            at = bisect_left(self.gaps, (n, -1))
            if at < len(self.gaps):
                gap, number = self.gaps.pop(at)
            elif len(self.gaps) < self.most:
                gap, number = self.size, self.count
                self.count += 1
                self.held[number] = []
            else:
                gap, number = self.gaps.pop(0)
                if gap > self.slack:
                    head, item = cut(item, gap)
                    self.held[number] += head
                    n -= gap
                yield number, self.held.pop(number)
                continue
            self.held[number] += item
            if gap == n:
                yield number, self.held.pop(number)
            else:
                insort(self.gaps, (gap - n, number))
            return

    def document(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        whole = len(ids) - len(ids) % self.size
        for a in range(0, whole, self.size):
            self.count += 1
            yield self.count - 1, [(doc, a, len(ids), ids[a : a + self.size])]
        if whole < len(ids):
            yield from self.put([(doc, whole, len(ids), ids[whole:].copy())], len(ids) - whole)

    def rest(self) -> Iterator[tuple[int, list]]:
        """The open windows, the fullest first."""
        for _, number in self.gaps:
            yield number, self.held[number]

    def closed(self) -> Iterator[tuple[int, list]]:
        """The open windows joined and cut into full ones; the last is cut into powers of two."""
        pieces = [p for _, window in self.rest() for p in window]
        left = sum(len(p[3]) for p in pieces)
        while left:
            take = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            head, pieces = cut(pieces, take)
            self.count += 1
            yield self.count - 1, head
            left -= take


class _Rows:
    """Gathers windows into record batches of about ``OUT_BYTES``."""

    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.binary()]

    def __init__(self, level: int, place: int):
        self.level, self.place, self.rows, self.bytes = level, place, [], 0

    def add(self, number: int, pieces: list, closed: bool) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            data = ids.astype("<u4").tobytes()
            self.rows.append((self.level, self.place, number, closed, offset, doc, start, len(ids), total, data))
            offset += len(ids)
            self.bytes += len(data) + 64

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.names)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.kinds)], self.names)


def _first_pass(docs: DataFrame, tokenizer: str, size: int, open_windows: int, slack: int, closing: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, windows = encoder(tokenizer), Windows(size, open_windows, slack)
        out = _Rows(0, TaskContext.get().partitionId())
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), closing)):
                for number, pieces in windows.document(doc, ids):
                    out.add(number, pieces, True)
                    if out.bytes >= OUT_BYTES:
                        yield out.batch()
        for number, pieces in windows.rest():
            out.add(number, pieces, False)
        yield out.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _merged(open_pieces: DataFrame, level: int, fan: int, last: bool, size: int, open_windows: int, slack: int) -> DataFrame:
    def run(key, table):
        windows, out = Windows(size, open_windows, slack), _Rows(level, key[0].as_py())
        rows = table.sort_by([("place", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        row = zip(*(rows[c].to_pylist() for c in ("place", "window", "doc_id", "start", "doc_tokens", "ids")))
        items: dict = {}
        for place, window, doc, start, total, ids in row:
            items.setdefault((place, window), []).append((doc, start, total, np.frombuffer(ids, "<u4")))
        for pieces in items.values():
            for number, done in windows.put(pieces, sum(len(p[3]) for p in pieces)):
                out.add(number, done, True)
        for number, pieces in windows.closed() if last else windows.rest():
            out.add(number, pieces, last)
        return pa.Table.from_batches([out.batch()])

    grouped = open_pieces.withColumn("group", F.expr(f"place div {fan}")).groupBy("group")
    return grouped.applyInArrow(run, PIECES)


def packed(
    docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, open_windows: int = OPEN, slack: int = SLACK,
    closing: int = CLOSING, fan: int = FAN,
) -> DataFrame:
    """(sequence_id, offset, doc_id, start, length, doc_tokens, ids): a row per piece of a document.

    ``ids`` are little-endian unsigned 32-bit integers: ``np.frombuffer(ids, "<u4")``. A sequence is its pieces in the order of
    ``offset``; one of fewer than ``size`` ids has to be padded unless its length is a power of two.
    """
    prepared(docs.sparkSession)
    result = stored(_first_pass(docs, tokenizer or default_tokenizer(), size, open_windows, slack, closing), "zstd")
    done = [result.filter("closed")]
    left, places, level = result.filter("NOT closed"), result.agg(F.max("place")).first()[0], 0
    while places is not None:
        level, last = level + 1, places < fan
        result = stored(_merged(left, level, fan, last, size, open_windows, slack), "zstd")
        done.append(result.filter("closed"))
        left, places = result.filter("NOT closed"), None if last else places // fan
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    # 6 bits of level, 29 of place, 28 of the number of the window there.
    number = F.shiftleft(F.col("level").cast("long"), 57) + F.shiftleft("place", 28) + F.col("window")
    return every.select(number.alias("sequence_id"), "offset", "doc_id", "start", "length", "doc_tokens", "ids")


def digest(docs: DataFrame) -> DataFrame:
    return packed(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
