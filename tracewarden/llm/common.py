"""Helpers of the operators in this folder: document rows, sizes, stored intermediate tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.session import ensure_checkpoint_dir, reliable

# Bytes of one Arrow batch that Spark hands to Python; bounds the memory of a task whatever the length of the texts.
BATCH_BYTES = 16 << 20
# Whether Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: UTC, and Arrow batches cut by bytes as well as by rows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` into the shared checkpoint folder as Parquet and read it back: lineage and its shuffle files end, executors may go."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def one_per_id(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """``key`` as a long and the ``values`` columns, one row per key.

    Rows without a key are left out. Where a key is repeated, the row with the largest (values) counts, so a text is
    preferred to null. Ids are looked at first, without their texts; only repeated ones are grouped.
    """
    quoted = [F.col(f"`{v}`") for v in values]
    rows = rows.select(F.col(key).cast("long").alias(key), *quoted).filter(F.col(key).isNotNull())
    again = rows.groupBy(key).agg(F.count("*").alias("_times")).filter("_times > 1").select(key)
    if again.isEmpty():
        return rows
    # Maps have no order; their texts have.
    kinds = dict(zip(rows.columns, (f.dataType.simpleString() for f in rows.schema.fields)))
    order = [F.to_json(F.struct(c)).alias(f"o{i}") if "map<" in kinds[v] else c.alias(f"o{i}") for i, (v, c) in enumerate(zip(values, quoted))]
    whole = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(quoted)])
    best = rows.join(again, key, "left_semi").groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("_best"))
    best = best.select(key, *[F.col(f"_best.v{i}").alias(v) for i, v in enumerate(values)])
    return rows.join(again, key, "left_anti").unionByName(best)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def part_of(key: str | Column, parts: int) -> Column:
    """Which of ``parts`` a long key belongs to; ``exchange.parts_of`` is the same on arrays."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(key.bitwiseXOR(F.shiftright(key, 17)), F.lit(parts)).cast("int")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of a link.

    Alternating large-star and small-star rounds; the number of rounds grows with the logarithm of the longest path.
    Each round is joins and map-side combined minima, so a node with very many links is not gathered anywhere.
    """
    edges = reliable(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = reliable(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u != v").distinct()
        )
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.col("u").cast("decimal(38,0)")).alias("u"),
            F.sum(F.col("v").cast("decimal(38,0)")).alias("v"),
        ).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
