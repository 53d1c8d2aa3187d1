"""Language identification against a plain version and on pages of known language."""

import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tracewarden.llm import language_id as li

HIDDEN = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
DECLARED = re.compile(rb"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)
SCHEMA = "page_id bigint, url string, html string, host int, own string, score string, text int"


@pytest.fixture(scope="module")
def model(spark):
    return li.text_model(spark.read.parquet(f"{SF}/documents.parquet"))


def plain(pages, model, hold=li.HOLD, temper=li.TEMPER):
    langs, table = model
    n, rows = len(langs), {}
    for page, url, html in pages:
        raw = (html or "").encode()
        grams = li.trigrams(HIDDEN.sub(b" ", raw))
        like = table[grams].sum(0) / (1 + len(grams) / temper) if len(grams) else np.zeros(n)
        said, host = DECLARED.search(raw), li._HOST.match(url or "")
        host = host[1].lower() if host else ""
        own = np.floor(np.exp(like - like.max()) / np.exp(like - like.max()).sum() * li.UNIT + 0.5)
        rows[page] = (like - like.max(), host, said[1].decode().lower() if said else "", own)
    sums = defaultdict(lambda: np.zeros(n))
    for like, host, said, own in rows.values():
        for key in (("all",), ("s", host.split(".")[-1]), ("d", ".".join(host.split(".")[-2:])), ("h", host), ("said", said)):
            sums[key] += own
    kinds = len({r[2] for r in rows.values()})
    out = {}
    for page, (like, host, said, own) in rows.items():
        prior = np.full(n, 1 / n)
        for key in (("all",), ("s", host.split(".")[-1]), ("d", ".".join(host.split(".")[-2:])), ("h", host)):
            rest = (sums[key] - own) / li.UNIT
            prior = (rest + hold * prior) / (rest.sum() + hold)
        markup = ((sums["said", said] - own) / li.UNIT + 1 / kinds) / ((sums["all",] - own) / li.UNIT + 1)
        score = like + np.log(np.maximum(prior, 1e-12)) + np.log(np.maximum(markup, 1e-12))
        share = math.exp(0) / np.exp(score - score.max()).sum()
        out[page] = (langs[int(score.argmax())], share)
    return out


def test_against_plain(spark, model):
    pages = [(i, f"http://{'abc'[i % 3]}.site{i % 4}.{'de' if i % 4 else 'com'}/x", f'<html lang="{("en", "fr")[i % 2]}"><p>{t}</p></html>')
             for i, t in enumerate(["Die Einheit und der Verstand", "the thing in the end", "la menteur et les eaux", "", "und", "12 !?"] * 5)]
    pages += [(100, None, None), (101, "no address", "<html><script>the the</script>der die das und"), (102, "https://u:p@X.DE:80/", "<HTML LANG=FR>le la les")]
    odd = [(*p, 1, "o", "s", 2) for p in [*pages, (None, "http://a.de", "x"), (100, None, None)]]
    got = {r.page_id: r for r in li.fused(spark.createDataFrame(odd, SCHEMA), model).collect()}
    want = plain(pages, model)
    assert set(got) == set(want)
    for page, (lang, share) in want.items():
        assert got[page].language == lang and got[page].confidence == pytest.approx(share, abs=2e-6)


def test_pages_of_known_language(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    known = pages.select("page_id", F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("truth")).filter("truth != ''")
    # Without markup and address the text alone must do.
    bare = pages.select("page_id", F.lit(None).cast("string").alias("url"), F.regexp_replace("html", "lang=", "x=").alias("html"))
    for frame in (pages, bare):
        right = li.fused(frame, model).join(known, "page_id").agg(F.avg((F.col("language") == F.col("truth")).cast("int"))).first()[0]
        assert right >= 0.95


def test_host_outweighs_a_short_text(spark, model):
    rows = [(i, "http://news.example.fr/", "<html>le la les une est pas pour dans que qui") for i in range(30)]
    rows.append((99, "http://news.example.fr/", "<html>on"))
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.language for r in li.fused(frame, model).collect()}[99] == "fr"


def test_nothing(spark, model):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert li.fused(pages, model).count() == 0
    assert li.digest(pages, docs).count() == 0


def test_scanner_is_the_pattern():
    draw = random.Random(1)
    bits = [b"<!--", b"-->", b"<script", b"</script>", b"</SCRIPT  >", b"<style>", b"</style", b">", b"<", b"<html", b" lang", b"=", b"'en'", b' "', b"de", b" ",
            b"text", b"<p class=x>", b"\n", b"scripts", b"-", b"!"]
    for _ in range(30_000):
        raw = b"".join(draw.choice(bits) for _ in range(draw.randint(0, 14)))
        assert li.visible(raw) == HIDDEN.sub(b" ", raw), raw
        said = DECLARED.search(raw)
        assert li.declared(raw) == (said[1].decode().lower() if said else ""), raw


@pytest.mark.parametrize("bit", [b"<!--", b"<script>", b"<html ", b"<html lang=  ", b"</script ", b"<", b"<style <!-- ", b"<html lang = ' "])
def test_long_markup_without_closers(bit):
    raw = bit * (10_000_000 // len(bit))
    start = time.process_time()
    li.visible(raw), li.declared(raw)
    assert time.process_time() - start < 20
