"""Quality classifier: a weak-label model over heuristic labellers, then a hashed linear scorer.

There are two targets, low quality and toxic. Each has labellers that vote 1 (yes), 0 (no) or abstain; an optional table of
human labels is one more labeller, with no special standing.

1. Votes of all documents are counted by pattern: at most 3^labellers rows, combined before the shuffle.
2. Expectation-maximisation (Dawid and Skene) over the patterns estimates how each labeller votes on yes and on no
   documents, and so the posterior of each pattern.
3. A bounded sample of documents with a decisive posterior (``SAMPLE`` per target and side; labelled ones first, then by hash
   of doc_id) trains a linear scorer on hashed features: words, word beginnings, and the heuristics' levels.
4. Every document is scored from its whole text; it is rejected where a probability reaches its ``REJECT``.

A null or empty text has no votes and no features, and gets the score of the intercept. Rows are scored one by one, so
repeated rows get equal scores; training looks at one row per doc_id. Without any decisive document of one side the scorer
rejects nothing. An empty table gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import one_per_id, stored
from tracewarden.llm.words import ALNUM, LOWER, SPACED, mixed, slices

SAMPLE = 3000
FEATURE_BITS = 18
REJECT = (0.5, 0.25)  # least probability of low quality, of toxic
DECISIVE = 0.9
TARGETS = ("quality", "toxic")

# Insults, for the labeller of toxic texts.
INSULTS = ["clown", "disgusting", "idiot", "idiots", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "trash", "worthless"]

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!#$%&*+<=>@\\^_`{|}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True

# (low, high) per heuristic: below low is a vote for good text, from high on a vote for bad text, else no vote.
LEVELS = {"capitals": (0.15, 0.4), "marks": (0.01, 0.06), "repeats": (0.02, 0.2), "bars": (0.001, 0.1), "variety": (0.0, 0.75)}
QUALITY_VOTES, TOXIC_VOTES = [*LEVELS], ["insult"]


def levels(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels, words, insults) of each text: the heuristics in the order of LEVELS as shares, and two counts."""
    insults = np.sort(_hashes(INSULTS))
    out, sizes, hits = [], [], []
    for s in slices(texts, SPACED):
        rows, text_of = len(s.first) - 1, s.text_of
        n = np.diff(s.first)
        per = lambda mask: np.bincount(text_of[mask], minlength=rows)
        total = lambda table: _sums(table[s.data], s)
        letters = total(_LETTER)
        same = np.flatnonzero((s.hashes[1:] == s.hashes[:-1]) & (text_of[1:] == text_of[:-1])) + 1
        size = s.ends - s.starts
        bar = np.flatnonzero((size == 1) & _MARK[s.data[s.starts]]) if len(size) else np.zeros(0, int)
        order = np.lexsort((s.hashes, text_of))
        h, t = s.hashes[order], text_of[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])] if len(h) else np.zeros(0, bool)
        distinct = np.bincount(t[fresh], minlength=rows)
        ratio = lambda a, b: a / np.maximum(b, 1)
        # Words come back with length: texts of n words are expected to have about 12 sqrt(n) different ones at least.
        out.append(np.stack([
            ratio(total(_UPPER), letters), ratio(total(_MARK), letters), ratio(per(same), n), ratio(per(bar), n),
            np.maximum(0, 1 - ratio(distinct, np.minimum(n, 12 * np.sqrt(n)))),
        ], 1))
        sizes.append(n)
        plain = next(iter(slices(texts.slice(s.rows.start, rows), ALNUM, lower=True, limit=1 << 62)))
        spot = np.minimum(np.searchsorted(insults, plain.hashes), len(insults) - 1)
        hits.append(np.bincount(plain.text_of[insults[spot] == plain.hashes], minlength=rows))
    if not out:
        return np.zeros((0, len(LEVELS))), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out), np.concatenate(sizes), np.concatenate(hits)


def level_votes(level: np.ndarray, words: np.ndarray) -> np.ndarray:
    low, high = (np.array([x[i] for x in LEVELS.values()]) for i in (0, 1))
    vote = np.where(level >= high, 1, np.where(level < low, 0, -1))
    vote[words == 0] = -1
    return vote


def _hashes(words: list[str]) -> np.ndarray:
    return next(iter(slices(pa.array([" ".join(words)]), ALNUM, lower=True))).hashes


def _sums(flags: np.ndarray, s) -> np.ndarray:
    """True bytes inside the words of each text."""
    run = np.r_[0, np.cumsum(flags)]
    inside = run[s.ends] - run[s.starts]
    return np.bincount(s.text_of, weights=inside, minlength=len(s.first) - 1)


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, one tinyint per labeller): 1, 0, or -1 for no vote."""
    names = [*QUALITY_VOTES, *TOXIC_VOTES]

    def run(batches):
        for batch in batches:
            level, words, hits = levels(batch.column(1))
            columns = [*level_votes(level, words).T, np.where(hits >= 1, 1, -1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int8()) for c in columns]], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} tinyint" for n in names))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of yes for each vote pattern, by expectation-maximisation from the majority vote."""
    yes, no = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = np.where(yes + no > 0, (yes + 0.1) / (yes + no + 0.2), 0.1)
    for _ in range(rounds):
        prior = (counts * p).sum() / max(counts.sum(), 1)
        a, b = np.log(max(prior, 1e-9)) * np.ones(len(p)), np.log(max(1 - prior, 1e-9)) * np.ones(len(p))
        for k in range(patterns.shape[1]):
            for vote in (-1, 0, 1):
                here = patterns[:, k] == vote
                a[here] += np.log(((counts * p)[here].sum() + 0.01) / ((counts * p).sum() + 0.03))
                b[here] += np.log(((counts * (1 - p))[here].sum() + 0.01) / ((counts * (1 - p)).sum() + 0.03))
        p, before = 1 / (1 + np.exp(np.clip(b - a, -500, 500))), p
        if np.abs(p - before).max() < 1e-9:
            break
    return p


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and sorted: hashed words, word beginnings and levels of the heuristics."""
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    level, words, hits = levels(texts)
    rows, kinds = [], []
    for s in slices(texts, ALNUM, lower=True):
        text = s.text_of + s.rows.start
        rows.append(text)
        kinds.append(s.hashes & mask)
        for size in (4, 6):
            long = np.flatnonzero(s.ends - s.starts > size)
            heads = np.zeros(len(long), np.uint64)
            for i in range(size):
                heads = heads * np.uint64(257) + s.data[s.starts[long] + i]
            rows.append(text[long])
            kinds.append(mixed(heads + np.uint64(size << 56)) & mask)
    bins = np.minimum((level * 50).astype(np.int64), 49)
    filled = np.flatnonzero(words > 0)
    vote = level_votes(level, words)
    for k in range(level.shape[1]):
        rows.append(filled)
        kinds.append(mixed((vote[filled, k] + 1 + 1000 * (k + 101)).astype(np.uint64)) & mask)
        rows.append(filled)
        kinds.append(mixed((bins[filled, k] + 1000 * (k + 1)).astype(np.uint64)) & mask)
    pairs = np.unique(np.concatenate(rows).astype(np.int64) << FEATURE_BITS | np.concatenate(kinds).astype(np.int64))
    return pairs >> FEATURE_BITS, (pairs & int(mask)).astype(np.int32)


def fit(row: np.ndarray, feature: np.ndarray, soft: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features by gradient steps, for features that tell the sides apart; the intercept is for
    a share ``prior`` of yes."""
    size = 1 << FEATURE_BITS
    y = soft[row]
    pro, con = np.bincount(feature, weights=y, minlength=size), np.bincount(feature, weights=1 - y, minlength=size)
    n1, n0 = soft.sum(), (1 - soft).sum()
    # Two-proportion test; the tiny term is for features that every text has.
    seen = pro + con
    z = (pro * n0 - con * n1) / np.sqrt(seen * n1 * n0 * (1 - seen / (n1 + n0)) + 1e-9)
    keep = (np.abs(z) > 3.5) & (seen >= 5)
    used = keep[feature]
    row, feature = row[used], feature[used]
    weights, bias = np.zeros(size), 0.0
    speed, memory, inertia = 0.5, 0.9, np.zeros(size + 1)
    square = np.zeros(size + 1)
    for step in range(150):
        score = bias + np.bincount(row, weights=weights[feature], minlength=len(soft))
        slip = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - soft) / len(soft)
        slope = np.r_[np.bincount(feature, weights=slip[row], minlength=size) + 1e-4 * weights, slip.sum()]
        inertia = memory * inertia + (1 - memory) * slope
        square = 0.99 * square + 0.01 * slope**2
        move = speed * 0.2 * (inertia / (1 - memory ** (step + 1))) / (np.sqrt(square / (1 - 0.99 ** (step + 1))) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    weights[~keep] = 0
    shift = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log(max(n1, 1e-6) / max(n0, 1e-6))
    return weights.astype(np.float32), float(bias + shift)


class Scorer:
    """``weights``: per target, 2^FEATURE_BITS numbers and an intercept: bounded whatever the corpus."""

    def __init__(self, weights: dict[str, tuple[np.ndarray, float]]):
        self.weights = weights

    def scores(self, texts: pa.Array) -> dict[str, np.ndarray]:
        out = {t: [] for t in TARGETS}
        cuts = [*(s.rows for s in slices(texts))]
        for part in cuts:
            row, feature = features(texts.slice(part.start, part.stop - part.start))
            for t, (weights, bias) in self.weights.items():
                x = bias + np.bincount(row, weights=weights[feature], minlength=part.stop - part.start)
                out[t].append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
        return {t: np.concatenate(x) if x else np.zeros(0) for t, x in out.items()}

    def column(self, text: str | Column) -> Column:
        """Probabilities of the targets for a text column, as an array of doubles."""
        me = self

        @F.arrow_udf("array<double>")
        def score(texts: pa.Array) -> pa.Array:
            got = me.scores(texts)
            flat = np.stack([got[t] for t in TARGETS], 1).reshape(-1)
            return pa.FixedSizeListArray.from_arrays(pa.array(flat), len(TARGETS)).cast(pa.list_(pa.float64()))

        return score(text)


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Scorer:
    """Weak labels of all ``docs``, and the scorer fitted on a sample of them. ``labels``: (doc_id, quality, toxic)."""
    docs = one_per_id(docs, "doc_id", "text")
    cast = votes(docs)
    if labels is None:
        cast = cast.withColumns({f"told_{t}": F.lit(-1).cast("tinyint") for t in TARGETS})
    else:
        told = one_per_id(labels, "doc_id", *TARGETS).select(
            "doc_id", F.coalesce(1 - F.col("quality"), F.lit(-1)).cast("tinyint").alias("told_quality"),
            F.coalesce("toxic", F.lit(-1)).cast("tinyint").alias("told_toxic"))
        cast = cast.join(told, "doc_id", "left").fillna(-1, ["told_quality", "told_toxic"])
    cast = stored(cast)
    scorers = {}
    for target, names in zip(TARGETS, (QUALITY_VOTES, TOXIC_VOTES)):
        names = [*names, f"told_{target}"]
        rows = cast.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).toPandas()
        if rows.empty:
            scorers[target] = (np.zeros(1 << FEATURE_BITS, np.float32), -30.0)
            continue
        patterns, counts = rows[names].to_numpy(), rows["n"].to_numpy()
        posterior = estimate(patterns, counts)
        prior = float((counts * posterior).sum() / counts.sum())
        spark = docs.sparkSession
        known = spark.createDataFrame(
            [(*map(int, p), float(q)) for p, q in zip(patterns, posterior)], [*names, "posterior"]
        ).select(*[F.col(n).cast("tinyint") for n in names], "posterior")  # a row per pattern
        judged = cast.join(F.broadcast(known), names).select("doc_id", "posterior", (F.col(f"told_{target}") >= 0).alias("told"))
        sides = [judged.filter(F.col("posterior") >= DECISIVE), judged.filter(F.col("posterior") <= 1 - DECISIVE)]
        chosen = [stored(s.orderBy(F.desc("told"), F.xxhash64("doc_id"), "doc_id").limit(sample)) for s in sides]
        picked = chosen[0].unionByName(chosen[1])  # at most 2 * sample rows
        table = docs.join(F.broadcast(picked.select("doc_id", "posterior")), "doc_id").select("doc_id", "posterior", "text")
        got = table.mapInArrow(_feature_rows, "doc_id bigint, posterior double, features binary").toArrow().sort_by("doc_id")
        soft = got["posterior"].to_numpy()
        if not len(soft) or soft.min() > 0.5 or soft.max() < 0.5:
            scorers[target] = (np.zeros(1 << FEATURE_BITS, np.float32), -30.0)
            continue
        parts = [np.frombuffer(x, np.int32) for x in got["features"].to_pylist()]
        row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        scorers[target] = fit(row, np.concatenate(parts), soft, prior)
    return Scorer(scorers)


def _feature_rows(batches):
    for batch in batches:
        row, feature = features(batch.column(2))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        packs = [feature[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packs, pa.binary())], ["doc_id", "posterior", "features"])


def rejected(p: str | Column, reject: tuple[float, float] = REJECT) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (p[0] >= reject[0]) | (p[1] >= reject[1])


def accepted(docs: DataFrame, scorer: Scorer, reject: tuple[float, float] = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are."""
    return docs.filter(~rejected(scorer.column("text"), reject))


def digest(docs: DataFrame, labels: DataFrame, reject: tuple[float, float] = REJECT) -> DataFrame:
    """One row per document: doc_id, p_low, p_toxic, rejected."""
    docs = one_per_id(docs, "doc_id", "text")
    scored = docs.select("doc_id", train(docs, labels).column("text").alias("p"))
    return scored.select("doc_id", F.round(F.col("p")[0], 6).alias("p_low"), F.round(F.col("p")[1], 6).alias("p_toxic"),
                         rejected("p", reject).alias("rejected"))
