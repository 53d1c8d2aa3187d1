"""Greedy spacing: keep a value when it lies at least ``gap`` after the last kept value of its key.

This is the shared form of the alert cooldown (value = time) and of the failure-counter reset (value = cumulative
failures). The choice is sequential, so:

* ordinary keys stream once through a sorted partition, holding one value per key in memory, never a group;
* keys above ``hot_rows`` are solved without any sequential task: every value is linked to the first value at least
  ``gap`` later, and the chain from the first value is followed by doubling, in log2(kept) joins on unique keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.running import HOT_ROWS, hot_keys, running_totals
from tracewarden.session import broadcast_if_small, join_null_safe, reliable


def greedy_spacing(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    gap: int,
    initial: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The kept (keys, value) pairs. ``value`` is a long; ``initial`` acts as an already kept value."""
    nodes = df.select(*keys, F.col(value).cast("long").alias("_v")).distinct()
    if initial is not None:
        nodes = nodes.filter(F.col("_v") >= initial + gap)
    hot = hot_keys(nodes, keys, hot_rows)
    if hot is None:
        kept = _streamed(nodes, keys, gap)
    else:
        big, key_count, _ = hot
        big = broadcast_if_small(big, key_count)
        kept = _streamed(join_null_safe(nodes, big, keys, "left_anti"), keys, gap).unionByName(
            _doubled(join_null_safe(nodes, big, keys, "left_semi"), keys, gap, hot_rows)
        )
    return kept.withColumnRenamed("_v", value)


def _streamed(nodes: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    keys = list(keys)

    def same(column, a, b):
        """Whether rows ``a`` and ``b`` agree; null agrees with null."""
        values, none = column.to_numpy(), column.isna().to_numpy()
        return (values[a] == values[b]) | (none[a] & none[b])

    def keep(batches):
        tail, last = None, 0  # the newest row, and the last kept value of its key
        for batch in batches:
            if not len(batch):
                continue
            values = batch["_v"].to_numpy()
            turn = np.r_[True, ~np.logical_and.reduce([same(batch[k], slice(1, None), slice(None, -1)) for k in keys])]
            starts = np.flatnonzero(turn)
            ends = np.r_[starts[1:], len(batch)]
            picked = np.zeros(len(batch), bool)
            goes_on = tail is not None and all(
                tail[k] == batch[k].iloc[0] or (pd.isna(tail[k]) and pd.isna(batch[k].iloc[0])) for k in keys)
            picked[starts[1:] if goes_on else starts] = True  # the first value of a key is kept
            wide = values[ends - 1] - values[starts] >= gap
            wide[0] |= goes_on
            for n in np.flatnonzero(wide):  # only keys that may keep more; a step per kept value
                a, b = starts[n], ends[n]
                before = last if n == 0 and goes_on else values[a]
                while (at := a + int(np.searchsorted(values[a:b], before + gap))) < b:
                    picked[at] = True
                    before = values[at]
            kept = np.flatnonzero(picked[starts[-1] :])
            if len(kept):  # else the key of the batch before goes on without a new value
                last = int(values[starts[-1] + kept[-1]])
            tail = {k: batch[k].iloc[-1] for k in keys}
            yield batch[picked]

    ordered = nodes.repartition(*keys).sortWithinPartitions(*keys, "_v")
    return ordered.mapInPandas(keep, nodes.schema)


def _doubled(nodes: DataFrame, keys: Sequence[str], gap: int, hot_rows: int) -> DataFrame:
    keys = list(keys)
    # Number the values, and find for each the number of the first value at least `gap` later: a probe placed at
    # v + gap, ahead of any value there, sees exactly the values before it.
    stops = nodes.select(*keys, F.col("_v").alias("_at"), F.lit(1).alias("_real"), "_v")
    probes = nodes.select(*keys, (F.col("_v") + gap).alias("_at"), F.lit(0).alias("_real"), "_v")
    ranked = running_totals(stops.unionByName(probes), keys, ["_at", "_real"], {"_r": F.col("_real")}, hot_rows=hot_rows)
    ranked = reliable(ranked)
    links = (
        ranked.filter("_real = 1").select(*keys, "_v", F.col("_r").alias("_here"))
    )
    nexts = ranked.filter("_real = 0").select(*keys, "_v", (F.col("_r") + 1).alias("_next"))
    links = reliable(join_null_safe(links, nexts, [*keys, "_v"]))
    jumps = links.select(*keys, "_here", "_next")
    kept = links.filter("_here = 1").select(*keys, "_here")
    while True:
        step = join_null_safe(kept, jumps, [*keys, "_here"]).select(*keys, F.col("_next").alias("_here"))
        step = join_null_safe(step, links.select(*keys, "_here"), [*keys, "_here"], "left_semi")
        wider = reliable(kept.unionByName(step).distinct())
        if wider.count() == kept.count():
            break
        far = jumps.select(*keys, F.col("_here").alias("_next"), F.col("_next").alias("_far"))
        jumps = reliable(join_null_safe(jumps, far, [*keys, "_next"]).select(*keys, "_here", F.col("_far").alias("_next")))
        kept = wider
    return join_null_safe(links, kept, [*keys, "_here"]).select(*keys, "_v")
