"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

* Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the words of all documents by weight. A target stops
  at ``repeats`` times the words of its source, and what is over is shared again by weight until none is above.
* Words are allocated in blocks of ``block``: seat j (from 0) of a source has the quotient target / (2j + 1), and the
  highest quotients win, ties by source. The seats of a source are then apportioned in the same way to its shards, by their words.
  Shards hold about ``shard_words`` words each and are chosen by a hash of doc_id, so a source with a third of all rows
  is many shards and no task sees a source whole.
* In a shard, documents follow each other in the order of a seeded hash and the quota is taken from the front: whole passes
  first, then blocks up to the quota. No document is taken more than ``repeats`` times.

Rounding to seats starts from round(share), which is the apportionment for a nearby number of seats, and only the next
quotients above or below are ranked: about four rows per source whatever the number of blocks.

A null text has no words. Null is a source of its own. Rows without doc_id are left out, and of repeated ids the row with the
largest (text, source) counts. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.common import one_per_id, stored

BLOCK = 16
SHARD_WORDS = 2_000_000
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Add the 1-based rank by a unique order: pieces of a range partitioning are numbered apart and joined by their sizes."""
    pieces = stored(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("_piece").agg(F.count("*").alias("_n"))  # one row per partition
    sizes = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy(*order))
    return pieces.withColumn("_at", inside).join(sizes, "_piece").withColumn(name, F.col("_at") + F.col("_before")).drop("_piece", "_at", "_before")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, place, weight, target) from (doc_id, source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = ranked(sums, F.col("source").asc_nulls_last(), name="place")
    table = stored(table.withColumn("weight", (F.col("place") - 1) % 3 + 1))
    full = repeats * F.col("source_size")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, held = 0.0, -1
    while True:  # each round of sharing again is one aggregate row; the set of full sources only grows
        over = full <= F.lit(level) * F.col("weight")
        got = table.agg(
            F.coalesce(F.sum(F.when(over, full)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("rest"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if got["n"] == held or not got["rest"]:
            break
        held, level = got["n"], (total - got["full"]) / got["rest"]
    return table.withColumn("target", F.least(full.cast("double"), F.lit(float(level)) * F.col("weight")))


def seats(parties: DataFrame, keys: list[str], votes: str, house: Column, total: Column, tie: str) -> DataFrame:
    """Add ``quota``: Sainte-Laguë seats of each row within ``keys``; ``house`` seats and ``total`` votes per group."""
    group = Window.partitionBy(*keys)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    first = parties.withColumn("_first", F.floor(share * house + 0.5).cast("bigint"))
    first = first.withColumn("_open", (house - F.sum("_first").over(group)).cast("bigint"))
    reach = F.least(F.abs("_open"), F.ceil(1.5 * F.count("*").over(group) * share).cast("bigint") + 2)
    first = stored(first.withColumn("_reach", reach))
    more = first.filter("_open > 0 AND _reach > 0").withColumn("_j", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_reach") - 1)))
    less = first.filter("_open < 0 AND _reach > 0 AND _first > 0").withColumn(
        "_j", F.explode(F.sequence(F.greatest(F.col("_first") - F.col("_reach"), F.lit(0)), F.col("_first") - 1)))
    quotient = F.col(votes) / (2 * F.col("_j") + 1)
    up = more.withColumn("_r", F.row_number().over(group.orderBy(quotient.desc(), tie))).filter("_r <= _open")
    down = less.withColumn("_r", F.row_number().over(group.orderBy(quotient.asc(), F.desc(tie)))).filter("_r <= -_open")
    change = up.select(*keys, tie, F.lit(1).alias("_d")).unionByName(down.select(*keys, tie, F.lit(-1).alias("_d")))
    change = change.groupBy(*keys, tie).agg(F.sum("_d").alias("_d"))
    out = first.join(change, [*keys, tie], "left").withColumn("quota", F.col("_first") + F.coalesce("_d", F.lit(0)))
    return out.drop("_first", "_open", "_reach", "_d")


def number(text: Column) -> Column:
    """A non-negative long from the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def mixed(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, shard, size, source_size, target (of its source), taken."""
    docs = one_per_id(docs, "doc_id", "text", "source")
    counted = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = stored(docs.select("doc_id", "source", counted.alias("size")))
    table = targets(sizes, repeats)
    total = F.lit(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    everyone = table.withColumn("_all", F.lit(0))
    table = stored(
        seats(everyone, ["_all"], "target", F.floor(total / block + 0.5), total, "place")
        .withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("bigint"))
        .select("source", "place", "source_size", "target", "quota", "shards")
    )
    joined = sizes.join(table.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = joined.withColumn("shard", number(F.concat(F.lit("shard:"), F.col("doc_id").cast("string"))) % F.col("shards"))
    sums = dealt.groupBy("place", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("quota").alias("house"), F.first("source_size").alias("whole"))
    shares = seats(sums, ["place"], "shard_size", F.col("house"), F.col("whole"), "shard").select("place", "shard", "shard_size", F.col("quota").alias("blocks"))
    allowed = F.least(F.col("blocks") * block, repeats * F.col("shard_size"))
    order = Window.partitionBy("place", "shard").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "doc_id")
    front = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("allowed") / F.col("shard_size"))).otherwise(0)
    part = F.col("allowed") - F.col("passes") * F.col("shard_size") - F.col("front")
    return (
        dealt.join(shares, ["place", "shard"]).withColumn("allowed", allowed).withColumn("passes", passes).withColumn("front", front)
        .select("doc_id", "source", "shard", "size", "source_size", "target",
                (F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(part, F.col("size")))).cast("bigint").alias("taken"))
    )


def digest(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
