"""Event, alert and entity tables on Parquet: first-wins append, retention, archive scans, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.functions.times import instant


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. The limit of one runs before the shuffle too (WindowGroupLimit), so a key with
    many copies sends one row per task."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedup_events(df: DataFrame, existing: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """First row per event_id, leaving out ids that ``existing`` already has."""
    first = first_by_key(df, "event_id", order or ["timestamp", "raw_payload"])
    return first if existing is None else first.join(existing.select("event_id"), "event_id", "left_anti")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("timestamp"))


def write_dated(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by event_date, ZSTD, sorted by time inside files. Range partitioning spreads a busy day, or
    one busy moment, over tasks."""
    order = ["event_date", "timestamp", "event_id"]
    ordered = _dated(df).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode(mode).option("compression", "zstd").partitionBy("event_date").parquet(path)


def _has_data(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_events(df: DataFrame, path: str) -> None:
    """Append events whose event_id is not stored yet; only the id column of the table is read for that."""
    spark = df.sparkSession
    existing = spark.read.parquet(path) if _has_data(spark, path) else None
    write_dated(dedup_events(df, existing), path)


def append_alerts(df: DataFrame, path: str) -> None:
    """Append alerts whose alert_id is not stored yet; only the id column of the table is read for that.

    All days are read: an alert can come without a time, and an event id again with another day's time.
    """
    spark = df.sparkSession
    if _has_data(spark, path):
        df = df.join(spark.read.parquet(path).select("alert_id"), "alert_id", "left_anti")
    write_dated(first_by_key(df, "alert_id", ["timestamp", "event_id"]), path)


def append_timeline(df: DataFrame, path: str) -> None:
    write_dated(df, path)


def split_retention(df: DataFrame, as_of, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(live, archive): rows older than ``days`` before ``as_of`` go to the archive."""
    limit = instant(as_of) - F.make_dt_interval(days=F.lit(days))
    old = F.coalesce(F.col("timestamp") < limit, F.lit(False))
    return df.filter(~old), df.filter(old)


def archive_events(df: DataFrame, path: str, as_of, days: int = 90) -> DataFrame:
    """Write the old rows to the archive and return the live ones. A rerun appends to the day it belongs to."""
    live, old = split_retention(df, as_of, days)
    write_dated(old, path)
    return live


def _limits(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_retained")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [int(f.getPath().getName()) for f in fs.listStatus(target)] if fs.exists(target) else []


def retain_events(spark: SparkSession, path: str, archive: str, as_of, days: int = 90) -> None:
    """Move rows older than ``days`` before ``as_of`` from the live table to the archive, a day at a time.

    1. The archive gets the old rows; its days concerned are rewritten (dynamic partition overwrite) with each event once.
    2. A marker names the new limit. From then on ``read_live`` and ``read_all`` take older rows from the archive only.
    3. The old days leave the live table; of the day of the limit the younger rows are written again.

    A run that stops anywhere can be repeated: before the marker, readers still have the live rows; after it, what is left of
    them is passed over. Rows without a time stay. Only days before the limit are read. A limit never moves back.
    """
    limit = spark.range(1).select(F.unix_micros(instant(as_of) - F.make_dt_interval(days=F.lit(days)))).first()[0]
    limit = max([limit, *_limits(spark, path)])
    at = F.timestamp_micros(F.lit(limit))
    table = spark.read.parquet(path)
    old = table.filter((F.col("event_date") <= F.to_date(at)) & (F.col("timestamp") < at))
    touched = [r[0] for r in old.select("event_date").distinct().collect()]  # one value per day
    writer = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    order = ["event_date", "timestamp", "event_id"]
    if touched:
        there = spark.read.schema(table.schema).parquet(archive).filter(F.col("event_date").isin(touched)) if _has_data(spark, archive) else None
        if there is not None:
            named = there.filter("event_id IS NOT NULL").select("event_id")
            # Events without an id cannot be told from those of an earlier attempt; whole rows are compared.
            plain = old.filter("event_id IS NULL").exceptAll(there.filter("event_id IS NULL").select(*old.columns))
            old = there.select(*old.columns).unionByName(old.filter("event_id IS NOT NULL").join(named, "event_id", "left_anti").select(*old.columns)).unionByName(plain)
        writer(old.repartitionByRange(*order).sortWithinPartitions(*order)).partitionBy("event_date").parquet(archive)

    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_retained/{limit}")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(marker, True).close()

    limit_day = spark.range(1).select(F.to_date(at)).first()[0]
    if limit_day in touched:
        young = table.filter((F.col("event_date") == F.lit(limit_day)) & (F.col("timestamp") >= at))
        if not young.isEmpty():
            writer(young.repartitionByRange(*order).sortWithinPartitions(*order)).partitionBy("event_date").parquet(path)
            touched.remove(limit_day)
    for day in touched:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={day}"), True)
    if not any(f.getPath().getName().startswith("event_date=") for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path))):
        # Nothing is left: a file without rows keeps the schema.
        table.limit(0).drop("event_date").write.mode("overwrite").parquet(f"{path}/event_date={limit_day}")
    spark.catalog.refreshByPath(path)
    for older in _limits(spark, path):
        if older < limit:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_retained/{older}"), True)


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The live table as of the newest retention limit."""
    rows, limits = spark.read.parquet(path), _limits(spark, path)
    if not limits:
        return rows
    at = F.timestamp_micros(F.lit(max(limits)))
    young = (F.col("event_date") >= F.to_date(at)) & (F.col("timestamp") >= at)
    return rows.filter(young | F.col("timestamp").isNull())


def read_all(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Live and archived events, each once at any moment of a retention run."""
    live, limits = read_live(spark, path), _limits(spark, path)
    if not limits or not _has_data(spark, archive):
        return live
    at = F.timestamp_micros(F.lit(max(limits)))
    return live.unionByName(spark.read.schema(live.schema).parquet(archive).filter(F.col("timestamp") < at))


def scan_archive(spark: SparkSession, path: str, since, until, actor: str | None = None) -> DataFrame:
    """Archived events of a time range in order; whole days outside it are never opened."""
    since, until = instant(since), instant(until)
    rows = spark.read.parquet(path).filter(
        (F.col("event_date") >= F.to_date(since)) & (F.col("event_date") <= F.to_date(until))
        & (F.col("timestamp") >= since) & (F.col("timestamp") <= until)
    )
    if actor:
        rows = rows.filter(F.col("actor") == actor)
    return rows.drop("event_date").orderBy("timestamp", "event_id")


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key of a versioned table: replaced, not added up."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(order).alias(order), F.max_by(F.struct(*rest), order).alias("_latest")).select(
        key, order, "_latest.*").select(*df.columns)


def save_snapshot(snapshot: DataFrame, path: str, as_of) -> None:
    """Add a version of the entity snapshot."""
    version = snapshot.withColumn("updated_at", instant(as_of))
    version.write.mode("append").option("compression", "zstd").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return latest_by_key(spark.read.parquet(path), "entity_id", "updated_at")
