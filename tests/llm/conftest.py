import random

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, part int, rep string, chunks array<int>, "
           "gone string, _held0 double, prints binary, term string, place int")


@pytest.fixture(scope="session")
def spark():
    from tracewarden.llm.common import prepared
    from tracewarden.session import local_session

    return prepared(local_session(app="tests"))


def passage(seed: int, words: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4))) for _ in range(words)]


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, one long text, ties, copies, near copies, shared passages, repeated ids."""
    a, b, c = passage(1, 70), passage(2, 60), passage(3, 200)
    text = " ".join
    rows = [
        (10, text(a)), (7, text(a)), (30, text(a)), (31, text(b[:30]) + "\n" + text(a[:55]) + "\n" + text(b[30:])), (12, text(b)),
        (13, text(b[:58] + ["other", "words"])), (14, text(b[1:])), (-5, text(c)), (40, text([*c[:100], "x", *c[100:]])),
        (41, None), (42, ""), (43, " \n\t "), (44, "one two three"), (45, "One TWO three"), (46, "one  two\tthree"), (47, "é" * 3000),
        (48, text(["same"] * 400)), (49, text(["same"] * 300)), (50, text(passage(4, 30_000) + a)), (51, "l1\nl2\nl3\nl4\nl5\nl6\nl7\nl8"),
        (52, "zero\nl1\nl2\nl3\nl4\nl5\nl6\nl7\nl8"), (53, "l1\nl2\nl3\nl4\nl5\nl6\nl7\nl8\nl1\nl2\nl3\nl4\nl5\nl6\nl7\nl8"), (54, "\n\n\n"),
        (12, text(b)), (12, None), (60, text(c[:20])), (60, text(c[5:90])), (None, text(a)), (None, None),
        (9_000_000_000_000_000_000, text(a[10:])),
    ]
    draw = random.Random(5)
    for i in range(100, 160):  # near copies of one another, and texts that share their middle
        base = list(c[:80]) if i % 2 else passage(i, 40) + a[5:65] + passage(-i, 10)
        if i % 3:
            base[draw.randrange(80)] = f"w{i}"
        rows.append((i, text(base)))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    sources = ["s", "Z", "é", None, "a"]
    rows = [
        (i, t, "en", sources[k % 5], len(t or ""), k, "r", [k], "g", float(k), b"p", "t", 0) for k, (i, t) in enumerate(odd_texts())
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def kept_texts():
    """The text that counts for each id: the largest, null last."""
    best: dict = {}
    for i, t in odd_texts():
        if i is not None and (i not in best or best[i] is None or (t is not None and t.encode() > best[i].encode())):
            best[i] = t
    return best
