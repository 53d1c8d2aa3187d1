"""The divergence audit against plain Python, with small tiles too."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import UPPER

from tracewarden.llm import divergence

COLUMNS = "doc_id bigint, text string, lang string, source string, term string, n int, tile int, a string, value double, part string"


def expected(rows, least=30, top=50):
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    spread, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.encode().translate(UPPER))
        spread[lang].update(set(words))
        count[lang, source].update(words)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in spread[lang].items() if n >= least]
        groups = sorted({s for _, la, s in rows if la == lang}, key=str.encode)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in groups}
        q = shares(sum((count[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t.decode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(items) if part == "pair" or r < top}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i % 7 if i % 5 else None, t, la, s, "x", 1, 2, "y", 0.5, "p") for i, (t, la, s) in enumerate(rows)], COLUMNS)


def found(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    words = [f"{a}{b}" for a in "abcdefghé" for b in "klmnopqrst日"]
    rows = []
    for i in range(900):
        lang = draw.choice(["en", "en", "de", None, "rare"] if i < 890 else ["few"])
        source = draw.choice(["hot", "hot", None, "Z", "é", "日", *[f"s{k}" for k in range(12)]])
        picked = [words[min(len(words) - 1, int(draw.expovariate(0.06)))] for _ in range(draw.randint(0, 30))]
        rows.append((draw.choice([" ", "1", "\n", "-"]).join(w.upper() if draw.random() < 0.2 else w for w in picked), lang, source))
    rows += [(None, "en", "only null"), ("", None, ""), ("123 456", "digits", "a"), ("x", "digits", "b")]
    rows += [("same words again", "en", "copies")] * 300 + [("long " * 60_000 + "tail", "en", "hot")]
    return rows


def test_audit(spark, texts):
    got = found(divergence.audit(frame(spark, texts)))
    assert len(got) == len(set(got)) and set(got) == expected(texts)


@pytest.mark.parametrize("tile_groups,tile_terms,least", [(4, 16, 30), (3, 40, 1), (64, 7, 1000)])
def test_tiles(spark, texts, tile_groups, tile_terms, least):
    got = found(divergence.audit(frame(spark, texts), least, 5, tile_groups, tile_terms))
    assert len(got) == len(set(got)) and set(got) == expected(texts, least, 5)


@pytest.mark.parametrize("shape", [(1, 1), (32, 33), (70, 300), (5, 1000)])
def test_trees(shape):
    rng = np.random.default_rng(1)
    height, width = shape
    up = lambda n: -(-n // divergence.LEAF) * divergence.LEAF
    trees, dense = [], []
    for rows in (height, height // 2 + 1):
        unseen = rng.integers(1, 50, rows)
        cells = rng.choice(rows * width, rows * width // 9, replace=False)
        r, c, v = cells // width, cells % width, rng.integers(50, 10**9, len(cells))
        trees.append(divergence.Tree(r, c, v, unseen, up(rows), up(width)))
        full = np.repeat(unseen[:, None], width, 1)
        full[r, c] = v
        dense.append(full)
    got = divergence.distances(*trees, width)[:height, : height // 2 + 1]
    assert (got == np.abs(dense[0][:, None] - dense[1][None]).sum(2)).all()


def test_zero_quadrants_are_not_opened(monkeypatch):
    opened = []
    monkeypatch.setattr(divergence.Tree, "leaf", lambda self, *at, leaf=divergence.Tree.leaf: (opened.append(at), leaf(self, *at))[1])
    none = np.zeros(0, np.int64)
    one = np.array([0])
    a = divergence.Tree(one, one, np.array([9]), np.array([1, 2]), 32, 32_000)
    b = divergence.Tree(none, none, none, np.array([5]), 32, 32_000)
    assert divergence.distances(a, b, 31_999)[:2, :1].tolist() == [[4 * 31_998 + 4], [3 * 31_999]]
    assert len(opened) == 2


def test_nothing(spark, nothing):
    assert divergence.digest(nothing).count() == 0
    assert found(divergence.digest(frame(spark, [(None, None, None)]))) == []
    assert sorted(found(divergence.digest(frame(spark, [(None, "x", "a"), (None, "x", None)])))) == [("x", "", "pair", "a", 0, 1), ("x", "a", "pair", "", 0, 1)]
