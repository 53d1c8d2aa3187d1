"""Line dedup with content-defined chunks, in DataFrame functions only.

A document's lines (cut at newline) are hashed, and a rolling hash over the last three line hashes ends a chunk wherever
it is divisible by ``every``; the last line ends one too. Boundaries thus depend on the lines around them and not on line
numbers, so a passage keeps its inner chunks when lines are put in before it. Chunks of two lines or more that occur
again, in any document or twice in one, are removed but for their first occurrence (smallest doc_id, then place). Equal
means equal bytes: hashes only choose which chunks are compared, and the compared key holds the chunk itself.

Only chunks whose hash occurs again have their text shuffled; counts and first occurrences are combined before the
shuffle, so a chunk that a third of all documents hold is one row per task. A null text stays null, an empty one stays
empty. Rows without doc_id are left out, and of repeated ids the largest text counts. An empty table gives an empty result.
Columns of the input other than doc_id and text are carried through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import one_per_id, stored

EVERY = 4
WEIGHTS = (31, 961)  # of the two lines before


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _real(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and the made columns, each computed once: the optimiser does not move expressions through inline()."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def cut(docs: DataFrame, every: int, *keep: str) -> DataFrame:
    """(keep, lines, chunks) of ``docs.text``: a chunk is one long, first line * 2^32 + end, lines from 0."""
    lines = _real(docs, [*keep, "text"], lines=F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>"))).drop("text")
    hashed = _real(lines, [*keep, "lines"], h=F.transform("lines", _line_hash))
    zeros = [F.array_repeat(F.lit(0).cast("bigint"), i) for i in (1, 2)]
    back = [F.slice(F.concat(z, "h"), F.lit(1), F.size("h")) for z in zeros]
    rolling = F.zip_with(F.zip_with("h", back[0], lambda a, b: a + b * WEIGHTS[0]), back[1], lambda a, b: a + b * WEIGHTS[1])
    at = F.filter(F.transform(rolling, lambda x, i: F.when(x % every == 0, i + 1)), lambda i: i.isNotNull())
    last = F.when(F.size("h") > 0, F.array(F.size("h"))).otherwise(F.array().cast("array<int>"))
    ended = _real(hashed, [*keep, "lines"], ends=F.array_distinct(F.concat(at, last)))
    starts = F.slice(F.concat(F.array(F.lit(0)), "ends"), F.lit(1), F.size("ends"))
    both = F.zip_with(starts, "ends", lambda a, b: F.shiftleft(a.cast("bigint"), 32) + b)
    return _real(ended, [*keep, "lines"], chunks=both)


def _lines(chunk: Column) -> Column:
    return (chunk.bitwiseAND(0xFFFFFFFF) - F.shiftright(chunk, 32)).cast("int")


def _text(chunk: Column) -> Column:
    return F.array_join(F.slice("lines", (F.shiftright(chunk, 32) + 1).cast("int"), _lines(chunk)), "\n")


def repeated(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(doc_id, gone): the chunks to be removed, per document that has any."""
    several = F.filter("chunks", lambda c: _lines(c) > 1)
    keyed = F.transform(several, lambda c: F.struct(F.xxhash64(_text(c)).alias("key"), c.alias("chunk")))
    listed = stored(cut(docs, every, "doc_id").select("doc_id", F.inline(keyed)))
    again = stored(listed.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"))
    wanted = listed.join(again, "key").groupBy("doc_id").agg(F.collect_list("chunk").alias("wanted"))
    held = cut(docs.select("doc_id", "text").join(wanted, "doc_id"), every, "doc_id", "wanted")
    compared = F.transform("wanted", lambda c: F.struct(c.alias("chunk"), _text(c).alias("bytes")))
    held = stored(held.select("doc_id", F.inline(compared)))
    first = held.groupBy("bytes").agg(F.min(F.struct("doc_id", "chunk")).alias("first"))
    later = held.join(first, "bytes").filter(F.struct("doc_id", "chunk") != F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_list("chunk").alias("gone"))


def deduplicated(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """The documents with repeated chunks taken out of ``text``; a text left without lines is empty."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = one_per_id(docs, "doc_id", "text", *others)
    # Names of their own, so that no column of the input meets one of ours.
    held = {c: f"_held{i}" for i, c in enumerate(others)}
    rows = rows.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in held.items()])
    joined = rows.join(repeated(rows, every), "doc_id", "left")
    same = joined.filter("gone IS NULL").drop("gone")
    kept = F.array_join(F.transform(F.array_except("chunks", "gone"), _text), "\n")
    changed = cut(joined.filter("gone IS NOT NULL"), every, "doc_id", *held.values(), "gone")
    changed = changed.select("doc_id", kept.alias("text"), *held.values())
    whole = same.unionByName(changed)
    return whole.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the remaining text; null for a null text)."""
    rows = one_per_id(docs, "doc_id", "text")
    joined = rows.join(repeated(rows, every), "doc_id", "left")
    none = F.lit(0).cast("bigint")
    same = joined.filter("gone IS NULL").select(
        "doc_id", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
        none.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"),
    )
    changed = cut(joined.filter("gone IS NOT NULL"), every, "doc_id", "gone").select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"),
        F.aggregate("gone", none, lambda n, c: n + _lines(c)).alias("n_removed"),
        F.sha2(F.array_join(F.transform(F.array_except("chunks", "gone"), _text), "\n"), 256).alias("kept_sha256"),
    )
    return same.unionByName(changed)
