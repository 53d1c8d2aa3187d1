"""Ordered running totals per key, safe for keys that hold a large share of the table.

Every time-ordered operator of the engine (sliding counts, distinct hosts in a window, cumulative failures, risk,
event numbers) is phrased as running totals, so skew is handled once, here:

* a key with at most ``hot_rows`` rows is one window partition: one shuffle, one linear pass;
* the rows of larger keys are range-partitioned by (key, order), which cuts a key wherever balance asks for it. Each
  piece is totalled, the totals of earlier pieces are carried in, and the pieces are scanned in parallel. At most one
  key can continue across each cut, so there is at most one carried row per piece.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import broadcast_if_small, join_null_safe, reliable

HOT_ROWS = 4_000_000


# Rows that sliding windows make of one event at most: as it happens and as it leaves, and an edge at each.
SPREAD = 4


class Measured(int):
    """``hot_rows`` that knows the hot keys of some events already, see ``measured``; used in its place by every operator."""

    known: dict[frozenset, tuple | None] = {}


def measured(events: DataFrame, hot_rows: int, *key_sets: Sequence[str]) -> Measured:
    """Count each of ``key_sets`` once, in one pass. What an operator makes of ``events`` has at most ``SPREAD`` rows for one
    event, so keys that are not hot here are not hot there; those found are cut into pieces in every operator.
    """
    limit = max(1, hot_rows // SPREAD)
    columns = sorted({k for keys in key_sets for k in keys})
    sets = [[F.col(k) for k in keys] for keys in key_sets]
    rows = events.select(*columns).groupingSets(sets, *columns).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("_n")).filter(F.col("_n") > limit)
    found = reliable(rows)
    sizes = {r["_set"]: r for r in found.groupBy("_set").agg(F.count("*").alias("keys"), F.sum("_n").alias("rows")).collect()}
    out = Measured(hot_rows)
    out.known = {}
    for keys in key_sets:
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        size = sizes.get(bits)
        out.known[frozenset(keys)] = size and (found.filter(F.col("_set") == bits).select(*keys), size["keys"], size["rows"] * SPREAD)
    return out


def placed(df: DataFrame, key: str, hot_rows: int, base: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Rows dealt by ``key`` when no value of it is hot: windows by it, alone or with more columns, then share this one shuffle.

    Made of ``base``, or of ``df`` itself, which is counted unless ``hot_rows`` is measured already. The second value is the measured ``hot_rows``.
    """
    if not (isinstance(hot_rows, Measured) and frozenset([key]) in hot_rows.known):
        hot_rows = measured(df if base is None else base, hot_rows, [key])
    return (df if hot_rows.known[frozenset([key])] else df.repartition(key)), hot_rows


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int, base: DataFrame | None = None):
    """Keys with more than ``hot_rows`` rows as (DataFrame, key count, row count), or None when there are none.

    The count is combined map-side, reads the key columns only, and at most total/hot_rows keys can qualify. A null key
    counts like any other. ``base`` is what ``df`` was made of, at most ``SPREAD`` rows for one: counting it is cheaper.
    """
    if isinstance(hot_rows, Measured):
        if frozenset(keys) in hot_rows.known:
            return hot_rows.known[frozenset(keys)]
        # More columns only cut a key into smaller ones.
        if any(not hot and known <= frozenset(keys) for known, hot in hot_rows.known.items()):
            return None
    if base is not None:
        df, hot_rows = base, max(1, hot_rows // SPREAD)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    size = hot.agg(F.count("*").alias("keys"), F.sum("_n").alias("rows")).first()
    if not size["keys"]:
        return None
    return reliable(hot.select(*keys)), size["keys"], size["rows"] * (1 if base is None else SPREAD)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    peaks: Mapping[str, Column] | None = None,
    before: bool = False,
    hot_rows: int = HOT_ROWS,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add per row the running sum (``sums``) or maximum (``peaks``) of each expression within its key.

    With one order column, rows of equal order are peers and share totals that include all of them. With more, the
    order must be unique within a key. ``before`` adds ``<name>_before``: the same over strictly earlier rows.
    Null inputs count as zero for sums and are ignored by peaks. A null key is a key; rows of null order come first, see
    one another, and have nothing before them.
    """
    sums, peaks = dict(sums or {}), dict(peaks or {})
    hot = hot_keys(df, keys, hot_rows, base)
    if hot is None:
        return _scan_by_key(df, keys, order, sums, peaks, before)
    big, key_count, row_count = hot
    big = broadcast_if_small(big, key_count)
    cold = _scan_by_key(join_null_safe(df, big, keys, "left_anti"), keys, order, sums, peaks, before)
    pieces = max(2, math.ceil(2 * row_count / hot_rows))
    split = _scan_in_pieces(join_null_safe(df, big, keys, "left_semi"), keys, order, sums, peaks, before, pieces)
    return cold.unionByName(split)


def _scan_by_key(df, keys, order, sums, peaks, before):
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    prior = (
        w.rangeBetween(Window.unboundedPreceding, -1)
        if len(order) == 1
        else w.rowsBetween(Window.unboundedPreceding, -1)
    )
    # A range frame of a null order holds its peers, which are not earlier.
    timed = F.col(order[0]).isNotNull() if len(order) == 1 else F.lit(True)
    out = {}
    for name, value in sums.items():
        out[name] = F.coalesce(F.sum(value).over(upto), F.lit(0))
        if before:
            out[f"{name}_before"] = F.coalesce(F.when(timed, F.sum(value).over(prior)), F.lit(0))
    for name, value in peaks.items():
        out[name] = F.max(value).over(upto)
        if before:
            out[f"{name}_before"] = F.when(timed, F.max(value).over(prior))
    return df.withColumns(out)


def _scan_in_pieces(df, keys, order, sums, peaks, before, pieces):
    spot = [*keys, *order]
    # Peers become one row, combined map-side, so even equal timestamps by the million stay one row per piece.
    points = df.groupBy(*spot).agg(
        *[F.sum(v).alias(n) for n, v in sums.items()], *[F.max(v).alias(n) for n, v in peaks.items()]
    )
    points = points.select(*spot, *[F.coalesce(n, F.lit(0)).alias(n) for n in sums], *peaks)
    ranged = reliable(points.repartitionByRange(pieces, *spot).withColumn("_piece", F.spark_partition_id()))

    totals = ranged.groupBy(*keys, "_piece").agg(
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in peaks]
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_piece",
        F.count("*").over(earlier).alias("_seen"),
        *[F.sum(n).over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.max(n).over(earlier).alias(f"_carry_{n}") for n in peaks],
    ).filter("_seen > 0").drop("_seen")

    inside = Window.partitionBy("_piece", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    carried = join_null_safe(ranged, broadcast_if_small(carry, pieces), [*keys, "_piece"], "left")
    out = [F.col(c) for c in spot]
    for n in sums:
        zero = F.lit(0)
        base = F.coalesce(F.col(f"_carry_{n}"), zero)
        out.append((base + F.sum(n).over(upto)).alias(n))
        if before:
            out.append((base + F.coalesce(F.sum(n).over(prior), zero)).alias(f"{n}_before"))
    for n in peaks:
        out.append(F.greatest(f"_carry_{n}", F.max(n).over(upto)).alias(n))
        if before:
            out.append(F.greatest(f"_carry_{n}", F.max(n).over(prior)).alias(f"{n}_before"))
    return join_null_safe(df, carried.select(*out), spot)
