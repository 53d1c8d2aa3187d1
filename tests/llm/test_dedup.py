"""Deduplication and decontamination against plain Python, over odd documents."""

import hashlib

import brute
import pytest

from tracewarden.llm import decontamination, line_dedup, ngram_join, substring_dedup, suffix_dedup


@pytest.mark.parametrize("size", [3, 13])
def test_substring(odd, kept_texts, size):
    want = brute.later_cover(kept_texts, size)
    got = {r.doc_id: r for r in substring_dedup.digest(odd, size).collect()}
    assert set(got) == set(want)
    for i, (words, cut, _) in want.items():
        kept = b" ".join(w for w, c in zip(words, cut) if not c)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), sum(cut), hashlib.sha256(kept).hexdigest())


def test_substring_factors(odd, kept_texts):
    want = brute.later_cover(kept_texts, 13)
    got = {r.doc_id: r.factors for r in substring_dedup.duplicate_factors(odd).collect()}
    texts = {r.doc_id: r for r in substring_dedup.without_duplicates(odd).collect()}
    assert set(got) == {i for i, (_, cut, _) in want.items() if any(cut)}
    for i, factors in got.items():
        words, cut, _ = want[i]
        assert {k for f in factors for k in range(f.start, f.end)} == {k for k, c in enumerate(cut) if c}
        assert all(f.end - f.start >= 13 and f.source < i for f in factors)
        # A factor occurs in its source as a whole up to the phrase where the next factor opens.
        for f in factors:
            source = want[f.source][0]
            phrase = words[f.start : f.start + 13]
            assert any(source[k : k + 13] == phrase for k in range(len(source) - 12))
        assert texts[i].kept.encode() == b" ".join(w for w, c in zip(words, cut) if not c)


@pytest.mark.parametrize("size,core", [(50, 11), (12, 4), (20, 20)])
def test_suffix(odd, kept_texts, size, core):
    want = brute.later_cover(kept_texts, size)
    got = {r.doc_id: r for r in suffix_dedup.duplicate_spans(odd, size, core).collect()}
    assert set(got) == set(want)
    for i, (words, cut, _) in want.items():
        assert (got[i].n_words, got[i].n_duplicate) == (len(words), sum(cut))
        assert {k for s in got[i].spans for k in range(s.start, s.end)} == {k for k, c in enumerate(cut) if c}


@pytest.mark.parametrize("percent,slack,pivots", [(80, 20, 4), (50, 10, 1), (80, 1000, 2)])
def test_ngram_join(odd, kept_texts, percent, slack, pivots):
    want = brute.near_components(kept_texts, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(odd, 5, percent, slack, pivots).collect()}
    assert got == want


def test_lines(odd, kept_texts):
    want = brute.without_repeats(kept_texts)
    assert any(gone for _, gone, _ in want.values())
    for r in line_dedup.digest(odd).collect():
        total, gone, text = want[r.doc_id]
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (total, gone, digest), r.doc_id


def test_lines_keep_other_columns(odd, kept_texts):
    want = brute.without_repeats(kept_texts)
    out = line_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (_, _, t) in want.items()}
    before = {r.doc_id: r for r in odd.collect()}
    assert all(got[i].chunks == before[i].chunks and got[i]._held0 == before[i]._held0 for i in (7, 31, 53))


def test_shifted_lines_share_chunks():
    a = [f"line {i}" for i in range(200)]
    one, two = ({tuple(c) for c in brute.line_chunks("\n".join(x))} for x in (a, ["new", *a[:100], "more", *a[100:]]))
    assert len(one & two) >= 0.8 * len(one)


def test_decontamination(spark, odd, kept_texts):
    a = kept_texts[10].split()
    items = {1: " ".join(a[:25]).upper(), 2: "One, two; THREE!", 3: " ".join(a[20:29]), 11: " ".join(a[:25]), 4: "", 5: None,
             6: "never seen words", 7: "é" * 3000, 8: " ".join(["same"] * 12), 12: "two"}
    rows = [(i, t, 1, "x") for i, t in items.items()] + [(3, None, 2, "y"), (None, "one two three", 3, "z")]
    bench = spark.createDataFrame(rows, "item_id bigint, text string, doc_id int, term string")
    want = brute.contaminated(kept_texts, items)
    assert sum(w[4] for w in want.values()) > 10
    got = {r.doc_id: r for r in decontamination.digest(odd, bench).collect()}
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    assert all(r.n_near >= r.n_items for r in got.values())


def test_empty_tables(spark, odd, nothing, kept_texts):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for frame in (
        substring_dedup.digest(nothing), suffix_dedup.digest(nothing), ngram_join.digest(nothing), line_dedup.digest(nothing),
        line_dedup.deduplicated(nothing), decontamination.digest(nothing, bench),
    ):
        assert frame.count() == 0
    clean = decontamination.digest(odd, bench)
    assert clean.count() == len(kept_texts) and clean.filter("contaminated OR n_near > 0").count() == 0
