"""The first host names of each lateral alert, without a row per alert and host.

The alerts of an actor are numbered by time, so a stay on a host is seen by a run of alert numbers [a, b). The run is cut
into the blocks of a binary tree over the numbers (at most two a level), and a block needs only its first ``keep``
names: a host that ``keep`` smaller names cover throughout a block is never shown by an alert below it. An alert then
meets the blocks above it, at most ``keep`` names a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.times import micros
from tracewarden.operators.running import HOT_ROWS, running_totals
from tracewarden.session import written

# The blocks of [_a, _b): at level l from ceil(_a / 2^l) to floor(_b / 2^l), those without a sibling in the run.
_FROM = "shiftright(_a + shiftleft(1L, l) - 1, l)"
_TO = "shiftright(_b, l)"
_BLOCKS = f"""filter(flatten(transform(sequence(0, length(bin(_b - _a)) - 1), l -> array(
    if({_FROM} < {_TO} AND {_FROM} % 2 = 1, named_struct('level', l, 'node', {_FROM}), NULL),
    if({_FROM} < {_TO} AND {_TO} % 2 = 1, named_struct('level', l, 'node', {_TO} - 1), NULL)))), x -> x IS NOT NULL)"""


def numbered_stays(alerts: DataFrame, stays: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(alert_id, actor, _n) and (actor, source, _a, _b): the alerts [_a, _b) of the actor that fall into a stay.

    Alerts of one moment share a number. Stays that no alert falls into are dropped, and so are alerts without actor or time.
    """
    at = alerts.select("alert_id", "actor", micros(F.col("timestamp")).alias("_us")).filter("actor IS NOT NULL AND _us IS NOT NULL")
    seen = stays.join(at.select("actor").distinct(), "actor", "left_semi")
    edges = seen.select("actor", "source", "_start", "_end", F.explode(F.array("_start", "_end")).alias("_us"))
    rows = at.withColumn("_alert", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    rows = running_totals(rows, ["actor"], ["_us"], {"_n": F.col("_alert")}, before=True, hot_rows=hot_rows)
    rows = written(rows.select("actor", "alert_id", "source", "_start", "_end", F.col("_n_before").cast("long").alias("_n")))
    met = rows.filter("alert_id IS NULL").groupBy("actor", "source", "_start", "_end").agg(
        F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    return rows.filter("alert_id IS NOT NULL").select("alert_id", "actor", "_n"), met.filter("_a < _b").drop("_start", "_end")


def first_hosts(alerts: DataFrame, stays: DataFrame, keep: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(alert_id, host): hosts present at an alert, among them its first ``keep`` by name; each once.

    ``stays`` as of ``sliding.spans``. At most ``keep`` hosts a level of the tree come out for an alert, so
    ``keep`` * (1 + log2 of the alerts of the actor), however many hosts it is on.
    """
    at, met = numbered_stays(alerts, stays, hot_rows)
    block = met.select("actor", "source", F.explode(F.expr(_BLOCKS)).alias("_block")).select("actor", "_block.*", "source").distinct()
    rank = F.row_number().over(Window.partitionBy("actor", "level", "node").orderBy("source"))
    few = written(block.withColumn("_rank", rank).filter(F.col("_rank") <= keep).drop("_rank"))
    top = few.agg(F.max("level")).first()[0] or 0
    above = at.select("alert_id", "actor", "_n", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    above = above.withColumn("node", F.expr("shiftright(_n, level)")).drop("_n")
    return above.join(few, ["actor", "level", "node"]).select("alert_id", F.col("source").alias("host")).distinct()
