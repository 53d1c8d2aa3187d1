"""Language identification of web pages by Bayesian evidence fusion.

For each page and language, the log posterior is the sum of

* text: log likelihoods of the byte trigrams of the visible text, from counts over documents of known language (at most
  ``SAMPLE`` per language, smallest hashes of doc_id), tempered so that no text counts more than ``TEMPER`` trigrams;
* markup: how often pages of the language declare what this page declares in <html lang>, or declare nothing;
* address: a prior smoothed down the hierarchy all -> address suffix (last label of the host) -> domain (last two labels) ->
  host; each level has the counts of its pages plus ``HOLD`` pages of the level above.

Counts of markup and address are sums of the text posteriors of all pages (grouped aggregation, in millionths so that sums
do not depend on order), less the page's own, so that a page is no evidence for itself.

Null html or url count as empty: no trigrams, nothing declared, the empty host. Ties go to the language that sorts first. Rows
without page_id are left out, and of repeated ids the row with the largest (html, url) counts. Documents without a
language are not learnt from; without any document there is no result. An empty table gives an empty result. Pages of any
length are read in whole, in time proportional to their length. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import one_per_id, stored

SAMPLE = 400
TEMPER = 60
HOLD = 5
BUCKETS = 1 << 14
UNIT = 1_000_000

_ELEMENT = re.compile(rb"<(script|style)\b", re.I)
_CLOSING = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style")}
_ROOT = re.compile(rb"<html\b", re.I)
_LANG = re.compile(rb"\slang\s*=\s*(?:[\"']\s*)?([a-z]{2,3})\b", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)
# Letters in lower case, everything else one space; bytes of other alphabets count as letters.
_FOLD = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def visible(raw: bytes) -> bytes:
    """A page without comments, scripts, styles and tags, each a space. What is never closed counts as a tag, and a tag that is
    never closed as text. Linear in the page: what has no closer at one place has none further on, and is not looked for again."""
    out, at, absent = [], 0, set()

    def after(kind: bytes, place: int) -> int:
        """The end of the next closer from ``place`` on, or -1."""
        if kind in absent:
            return -1
        if kind in _CLOSING:
            found = _CLOSING[kind].search(raw, place)
            end = found.end() if found else -1
        else:
            end = raw.find(kind, place)
            end = end + len(kind) if end >= 0 else -1
        if end < 0:
            absent.add(kind)
        return end

    while (start := raw.find(b"<", at)) >= 0:
        end = -1
        if raw.startswith(b"<!--", start):
            end = after(b"-->", start + 4)
        elif element := _ELEMENT.match(raw, start):
            end = after(element[1].lower(), element.end())
        if end < 0:
            end = after(b">", start + 1)
        if end < 0:
            break  # no tag is closed from here on
        out += [raw[at:start], b" "]
        at = end
    return b"".join([*out, raw[at:]])


def declared(raw: bytes) -> str:
    """The language that <html lang> names, or ''. Each tag is read once."""
    at = 0
    while root := _ROOT.search(raw, at):
        end = raw.find(b">", root.end())
        end = len(raw) if end < 0 else end
        if said := _LANG.search(raw, root.end(), end):
            return said[1].decode().lower()
        at = end
    return ""


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text, runs of other than letters as one space."""
    data = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.int64)
    if len(data) < 4:  # no letter at all
        return np.zeros(0, np.int64)
    return (data[:-2] * 62_089_911 + data[1:-1] * 433_494_437 + data[2:] * 98_764_321 >> 7) % BUCKETS


def text_model(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood by bucket and language); bounded by BUCKETS times the number of languages."""
    docs = one_per_id(docs.filter(F.col("lang").isNotNull()), "doc_id", "text", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = docs.select("doc_id", "lang").withColumn("r", rank).filter(F.col("r") <= sample).select("doc_id")
    few = docs.join(chosen, "doc_id", "left_semi").select("lang", "text")

    def count(batches):
        for batch in batches:
            held: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts += np.bincount(trigrams((text or "").encode()), minlength=BUCKETS)
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = few.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted({*rows["lang"].to_pylist()})
    table = np.ones((BUCKETS, len(langs)))
    if langs:
        table[rows["bucket"].to_numpy(), np.searchsorted(langs, rows["lang"].to_numpy(zero_copy_only=False).astype(str))] += rows["n"].to_numpy()
    return langs, np.log(table / table.sum(0, keepdims=True))


def evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], temper: int = TEMPER) -> DataFrame:
    """(page_id, host, suffix, domain, declared, text): ``text`` has the tempered log likelihood by language."""
    langs, table = model
    kinds = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.float64())]
    names = ["page_id", "host", "domain", "suffix", "declared", "text"]

    def run(batches):
        for batch in batches:
            out = []
            for page, html, url in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (html or "").encode()
                grams = trigrams(visible(raw))
                like = table[grams].sum(0) / (1 + len(grams) / temper) if len(grams) else np.zeros(len(langs))
                host = _HOST.match(url or "")
                host = host[1].lower().rstrip(".") if host else ""
                labels = host.split(".")
                out.append((page, host, ".".join(labels[-2:]), labels[-1], declared(raw), like - like.max()))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return pages.select("page_id", "html", "url").mapInArrow(
        run, "page_id bigint, host string, domain string, suffix string, declared string, text array<double>")


def fused(pages: DataFrame, model: tuple[list[str], np.ndarray], hold: float = HOLD, temper: int = TEMPER) -> DataFrame:
    """(page_id, host, declared, text_language, language, confidence)."""
    langs = model[0]
    pages = one_per_id(pages, "page_id", "html", "url")
    if not langs:
        return pages.sparkSession.createDataFrame([], "page_id bigint, host string, declared string, text_language string, language string, confidence double")
    n = len(langs)
    likely = F.transform("text", lambda x: F.exp(x))
    part = F.transform(likely, lambda x: F.round(x / F.aggregate(likely, F.lit(0.0), lambda s, y: s + y) * UNIT).cast("bigint"))
    base = stored(evidence(pages, model, temper).withColumn("own", part))

    def sums(key: str | None, name: str, frame: DataFrame = base) -> DataFrame:
        each = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(n)]
        grouped = frame.groupBy(*([key] if key else [])).agg(*each)
        return grouped.select(*([key] if key else []), F.array(*[f"s{i}" for i in range(n)]).alias(name))

    # Small tables meet first, so that every page is joined once by host and once by what it declares.
    hosts = base.groupBy("host", "domain", "suffix").agg(*[F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(n)])
    hosts = stored(hosts.select("host", "domain", "suffix", F.array(*[f"s{i}" for i in range(n)]).alias("own")))
    total = [int(x or 0) for x in sums(None, "all", hosts).first()["all"]]
    places = hosts.withColumnRenamed("own", "by_host").join(sums("domain", "by_domain", hosts), "domain").join(sums("suffix", "by_suffix", hosts), "suffix")
    declared = stored(sums("declared", "by_declared"))
    kinds = max(declared.count(), 1)
    joined = base.join(stored(places.drop("domain", "suffix")), "host").join(declared, "declared")

    def level(counts: Column, i: int, above: Column) -> Column:
        rest = [counts[j] - F.col("own")[j] for j in range(n)]
        return (rest[i] / UNIT + hold * above) / (sum(rest[1:], rest[0]) / UNIT + hold)

    def score(i: int) -> Column:
        all_of = F.array(*[F.lit(x) for x in total])
        prior = level(all_of, i, F.lit(1.0 / n))
        for counts in ("by_suffix", "by_domain", "by_host"):
            prior = level(F.col(counts), i, prior)
        of_lang = (F.lit(total[i]) - F.col("own")[i]) / UNIT
        said = ((F.col("by_declared")[i] - F.col("own")[i]) / UNIT + 1.0 / kinds) / (of_lang + 1)
        return F.col("text")[i] + F.log(F.greatest(prior, F.lit(1e-12))) + F.log(F.greatest(said, F.lit(1e-12)))

    scored = joined.select("page_id", "host", "declared", "text", F.array(*[score(i) for i in range(n)]).alias("score"))
    top, names = F.array_max("score"), F.array(*[F.lit(x) for x in langs])
    share = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("score")))
    return scored.select(
        "page_id", "host", "declared",
        F.get(names, (F.array_position("text", F.array_max("text")) - 1).cast("int")).alias("text_language"),
        F.get(names, (F.array_position("score", top) - 1).cast("int")).alias("language"), F.round(share, 6).alias("confidence"),
    )


def digest(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return fused(pages, text_model(docs))
