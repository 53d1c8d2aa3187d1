"""Exact event-time sliding windows [t - W, t] as running totals.

A row adds its value when it happens and takes it back one microsecond after its window ends, so a sliding count is
one linear running total: no frame is rescanned, and hot keys split like any other running total. The second half of
each row is made by an explode, so the input is read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.operators.running import HOT_ROWS, hot_keys, placed, running_totals
from tracewarden.session import join_null_safe

SECOND = 1_000_000


def _moves(df: DataFrame, keys: Sequence[str], flags: Mapping[str, Column], window_s: int) -> DataFrame:
    """Every row twice where a flag is set: as it happens (``_live``) and as it leaves. Leaving rows carry no payload.

    Rows that are edges already (see presence) pass through once.
    """
    edge = "_edge" in df.columns
    payload = [c for c in df.columns if c not in (*keys, "_us", "_edge")]
    ready = df.withColumns({n: F.when(c, 1).otherwise(0) for n, c in flags.items()})
    alive = F.col("_edge").isNull() if edge else F.lit(True)
    here = F.struct(alive.alias("_live"), F.col("_us"), *[F.when(alive, F.col(n)).otherwise(0).alias(n) for n in flags])
    gone = F.struct(
        F.lit(False).alias("_live"), (F.col("_us") + window_s * SECOND + 1).alias("_us"), *[(-F.col(n)).alias(n) for n in flags]
    )
    counted = alive & (sum((F.col(n) for n in flags), F.lit(0)) > 0)
    both = ready.withColumn("_m", F.explode(F.when(counted, F.array(here, gone)).otherwise(F.array(here))))
    out = [F.when(F.col("_m._live"), F.col(c)).alias(c) for c in payload]
    if edge:
        out.append(F.when(~alive, F.col("_edge")).otherwise(0).alias("_edge"))
    tie = [F.col("event_id").alias("_tie")] if "event_id" in df.columns else []
    return both.select(*keys, *out, *tie, "_m.*")


def sliding_counts(
    df: DataFrame, keys: Sequence[str], counts: Mapping[str, Column], window_s: int, hot_rows: int = HOT_ROWS,
    base: DataFrame | None = None,
) -> DataFrame:
    """Per row: ``n_<name>`` rows of its key in the window, and ``upto_<name>`` rows of its key so far.

    ``df`` has the event time in ``_us`` (microseconds). Rows of equal time see each other. Over the output of
    presence, ``n_hosts`` counts the distinct items in the window as well. ``base``: the events that presence was given.
    """
    flags = {f"_f_{n}": c for n, c in counts.items()}
    sums = {f"n_{n}": F.col(f"_f_{n}") for n in counts}
    sums |= {f"upto_{n}": F.when(F.col("_live"), F.col(f"_f_{n}")) for n in counts}
    if "_edge" in df.columns:
        sums["n_hosts"] = F.col("_edge")
    run = running_totals(_moves(df, keys, flags, window_s), keys, ["_us"], sums, hot_rows=hot_rows,
                         base=df if base is None else base)
    return run.filter("_live").drop("_live", "_edge", "_tie", *flags)


def presence(
    df: DataFrame, key: str, item: str, window_s: int, counted: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows with ``n_pair``, how often their (key, item) pair occurs in the window; and between them edge rows
    (``_edge`` = 1 or -1): the instants at which an item counted for the key enters or leaves the window.

    Summing edges counts distinct items. Rows need ``event_id``.
    """
    flags = {"_f_pair": F.lit(True), "_f_counted": counted}
    place = F.struct("_us", "_live", "_tie")
    run = running_totals(
        _moves(df, [key, item], flags, window_s), [key, item], ["_us"],
        {"n_pair": F.col("_f_pair"), "_n": F.col("_f_counted")}, {"_top": place}, before=True, hot_rows=hot_rows, base=df,
    )
    # Peers see the same totals; the last of them speaks for all, so an edge is emitted once.
    turned = ((F.col("_n") > 0) != (F.col("_n_before") > 0)) & (place == F.col("_top")) & (F.col(item) != "unknown")
    edge = F.when(F.col("_n") > 0, 1).otherwise(-1)
    none = F.array().cast("array<int>")
    kinds = F.concat(
        F.when(F.col("_live"), F.array(F.lit(None).cast("int"))).otherwise(none), F.when(turned, F.array(edge)).otherwise(none)
    )
    payload = [c for c in df.columns if c not in (key, item, "_us")]
    out = run.withColumn("_edge", F.explode(kinds))
    is_row = F.col("_edge").isNull()
    return out.select(key, item, "_us", *[F.when(is_row, F.col(c)).alias(c) for c in [*payload, "n_pair"]], "_edge")


def spans(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Output of presence -> one row per stay of an item in the window: [start, end) in microseconds.

    Stays of a pair are at least a window apart, so their number is bounded by time, not by rows.
    """
    w = Window.partitionBy(key, item).orderBy("_us")
    edges = rows.filter("_edge IS NOT NULL").select(key, item, "_us", "_edge")
    return (
        edges.withColumn("_end", F.lead("_us").over(w)).filter("_edge = 1")
        .select(key, item, F.col("_us").alias("_start"), "_end")
    )


def nth_following(
    df: DataFrame, key: str | Sequence[str], n: int, hot_rows: int = HOT_ROWS, name: str = "_nth", base: DataFrame | None = None
) -> DataFrame:
    """Add ``name``: (time, id) of the n-th next row of the key in (``_us``, ``event_id``) order, null near the end."""
    keys = [key] if isinstance(key, str) else list(key)
    here = F.struct(F.col("_us").alias("us"), F.col("event_id").alias("id"))
    if hot_keys(df, keys, hot_rows, base) is None:
        return df.withColumn(name, F.lead(here, n).over(Window.partitionBy(*keys).orderBy("_us", "event_id")))
    ranked = running_totals(df, keys, ["_us", "event_id"], {"_rank": F.lit(1)}, hot_rows=hot_rows, base=base)
    # Rows of one moment without an id share a rank.
    later = ranked.groupBy(*keys, (F.col("_rank") - n).alias("_rank")).agg(F.min(here).alias(name))
    return join_null_safe(ranked, later, [*keys, "_rank"], "left").drop("_rank")


POSITION = ["_us", "_id", "_kind", "_tie"]


def recent_presence(
    df: DataFrame, key: str, item: str, window_s: int, rows: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per row ``n_hosts``: the distinct items among the last ``rows`` rows of the key that also lie in the window.

    Other columns of ``df`` stay with their rows.
    """
    base = df.select(key, item, "_us", "event_id")
    df, hot_rows = placed(df, key, hot_rows, base)
    df = nth_following(df, [key, item], 1, hot_rows, "_next", base)
    return present(nth_following(df, key, rows, hot_rows, "_nth", base), key, item, window_s, F.lit(True), hot_rows, base)


def present(
    df: DataFrame, key: str, item: str, window_s: int, counted: Column, hot_rows: int, base: DataFrame | None = None
) -> DataFrame:
    """``n_hosts`` of recent_presence for rows that know the next row of their item (``_next``) and the one that pushes them
    out (``_nth``). Rows that are not ``counted``, or without a time, are not present.

    An item is present by its latest row only, so a row stops counting at the earliest of three places: at the next row of
    its item, at the row ``rows`` places later, or where its window ends. Places order by time, then row id; at one place
    leaving (0) comes before the row itself (2).
    """
    more = [c for c in df.columns if c not in (key, item, "_us", "event_id", "_next", "_nth")]
    over = F.struct((F.col("_us") + window_s * SECOND + 1).alias("us"), F.lit("").alias("id"))
    there = counted & F.col("_us").isNotNull()
    here = F.array(F.lit(2))
    ends = df.withColumns({"_ends": F.least("_next", "_nth", over), "_there": F.coalesce(there, F.lit(False))}).withColumn(
        "_kind", F.explode(F.when(F.col("_there"), F.array(F.lit(2), F.lit(0))).otherwise(here)))
    row = F.col("_kind") == 2
    moves = ends.select(
        key, *[F.when(row, F.col(c)).alias(c) for c in (item, *more)],
        F.when(row, F.col("_us")).otherwise(F.col("_ends.us")).alias("_us"),
        F.when(row, F.col("event_id")).otherwise(F.col("_ends.id")).alias("_id"),
        F.col("event_id").alias("_tie"), "_kind", F.when(~row, -1).when(F.col("_there"), 1).otherwise(0).alias("_v"),
    )
    total = running_totals(moves, [key], POSITION, {"n_hosts": F.col("_v")}, hot_rows=hot_rows, base=base)
    return total.filter("_kind = 2").select(key, item, *more, "_us", F.col("_id").alias("event_id"), "n_hosts")
