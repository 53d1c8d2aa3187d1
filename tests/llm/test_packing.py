"""Packing: every id in exactly one piece, small gaps, and ids equal to the tokenizer's own."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracewarden.llm import packing


@pytest.fixture(scope="module")
def model():
    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    return model


def ids_of(model, text):
    return [*model.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_whole_texts(model):
    draw = random.Random(3)
    alphabet = [*" \n\t\r 　 \u0085\x1c​́,.!'\"sabcté×12٣", "日本", "😀", "'s", "'ll", "  ", "\r\n", " the", "\nHe"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for _ in range(5000)]
    texts += [None, "", "<|endoftext|> x", "a" * 50_000, " " * 3000 + "x", "x\n\n", "1" * 500]
    got = list(packing.Encoder(packing.default_tokenizer())(pa.array(texts)))
    assert [g.tolist() for g in got] == [ids_of(model, t) for t in texts]


def test_forgotten_stretches_come_again(model, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    encode = packing.Encoder(packing.default_tokenizer())
    for _ in range(3):
        for text in ("one two three four five six seven", "x" * 100 + " one two", "two"):
            assert [g.tolist() for g in encode(pa.array([text]))] == [ids_of(model, text)]


def check(rows, texts, model, size, slack=None):
    """Rows against the texts (a list of (doc_id, text)); returns the number of padded ids."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append(r)
    padded = 0
    for pieces in held.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
        gap = 0 if at & (at - 1) == 0 else size - at
        assert slack is None or gap <= slack
        padded += gap
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(ids_of(model, text))
    assert set(docs) == set(want)
    for doc, pieces in docs.items():
        if len(want[doc]) > 1:
            assert sum(p.length for p in pieces) == sum(map(len, want[doc]))
            continue
        pieces.sort(key=lambda r: r.start)
        ids, at = want[doc][0], 0
        for p in pieces:
            assert p.start == at and p.doc_tokens == len(ids)
            part = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert bytes(p.ids) == part if hasattr(p, "ids") else p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    return padded


def test_odd_documents(spark, odd, model):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    rows = packing.digest(odd).collect()
    assert check(rows, texts, model, 2048, packing.SLACK) <= 0.01 * sum(r.length for r in rows)


@pytest.mark.parametrize("parts,size,windows,fan", [(1, 64, 1, 2), (7, 64, 4, 2), (23, 128, 8, 3), (40, 32, 2, 8)])
def test_rounds_of_leftovers(spark, odd, model, parts, size, windows, fan):
    docs = odd.filter("length(text) < 3000 OR text IS NULL").repartition(parts, "doc_id")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.packed(docs, size=size, open_windows=windows, fan=fan, slack=3).collect()
    check(rows, texts, model, size, 3)


def test_best_fit_and_fullest_first():
    w = packing.Windows(10, 2, 0)
    item = lambda doc, n: [(doc, 0, n, np.arange(n, dtype=np.uint32))]
    done = [x for doc, n in ((1, 6), (2, 8), (3, 2)) for x in w.put(item(doc, n), n)]
    assert [(k, [p[0] for p in ps]) for k, ps in done] == [(1, [2, 3])]  # 3 fits both; the smaller gap is filled
    done = [x for doc, n in ((4, 9), (5, 5)) for x in w.put(item(doc, n), n)]
    # 5 fits nowhere: the fullest (9) is filled with one id of it and emitted, the rest closes the gap of four
    assert [[(p[0], p[1], len(p[3])) for p in ps] for _, ps in done] == [[(4, 0, 9), (5, 0, 1)], [(1, 0, 6), (5, 1, 4)]]


def test_whole_documents_stay_whole_where_the_gap_is_small():
    w = packing.Windows(10, 1, 3)
    item = lambda doc, n: [(doc, 0, n, np.arange(n, dtype=np.uint32))]
    done = [x for doc, n in ((1, 8), (2, 7)) for x in w.put(item(doc, n), n)]
    assert [[(p[0], len(p[3])) for p in ps] for _, ps in done] == [[(1, 8)]]


def test_test_table(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = packing.digest(docs).collect()
    assert check(rows, texts, model, 2048, packing.SLACK) <= 0.005 * sum(r.length for r in rows)


def test_nothing(nothing):
    assert packing.digest(nothing).count() == 0
