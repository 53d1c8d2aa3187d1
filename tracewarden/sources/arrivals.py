"""Append-only tables in which the first arrival of a key wins, whatever its event time.

A table is three folders under one path:

* ``rows/event_date=…/batch=…``: the rows, with their arrival number inside the batch;
* ``keys/bucket=…/batch=…``: the keys of each batch, by a hash of the key, with Bloom filters for lookups of single keys;
* ``commits``: one empty file per batch, written last. Rows and keys of a batch without it do not exist for readers.

An append reads the key buckets that its own keys fall into and nothing else, so its cost follows the batch and not the table. Each
append also folds the key files of one in ``FOLD`` buckets into one file, so a bucket never has more than FOLD + 1 of them.
Repeating a batch id overwrites what the earlier attempt wrote; a batch that is committed already is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.sources.tables import first_by_key

BUCKETS = 256
FOLD = 16
LISTED = 1_000  # keys of a batch up to which the lookup is a list that Bloom filters answer


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def committed(spark: SparkSession, path: str) -> int:
    """The newest committed batch, or -1. Batches commit in order."""
    return max((int(n) for n in _names(spark, f"{path}/commits") if n.isdigit()), default=-1)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def known_keys(spark: SparkSession, path: str, keys: DataFrame, key: str, upto: int, buckets: int = BUCKETS) -> DataFrame | None:
    """Those of ``keys`` that batches up to ``upto`` have stored; only their buckets are opened. None if there are none to open."""
    wanted = [r["bucket"] for r in keys.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
    have = set(_names(spark, f"{path}/keys"))
    folders = [f"{path}/keys/bucket={b}" for b in sorted(wanted) if f"bucket={b}" in have]
    if not folders:
        return None
    stored = spark.read.option("basePath", f"{path}/keys").parquet(*folders).filter(F.col("batch") <= upto).select(key)
    few = keys.select(key).limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        return stored.filter(F.col(key).isin([r[key] for r in few])).distinct()
    return stored.join(keys.select(key), key, "left_semi").distinct()


def append_first(df: DataFrame, path: str, batch_id: int, key: str = "event_id", arrival: str | None = None, buckets: int = BUCKETS) -> None:
    """Store the rows of ``df`` whose key no earlier batch has, of each key the one that arrived first.

    ``arrival`` names a number that orders the rows of the batch; without it they are taken as they are read. Rows without a key are
    all stored. Needs ``timestamp`` for the day; rows without a time are in a day of their own.
    """
    spark = df.sparkSession
    done = committed(spark, path)
    if batch_id <= done:
        return
    order = F.col(arrival).cast("long") if arrival else F.monotonically_increasing_id()
    df = df.withColumns({"_arrival": order, "event_date": F.to_date("timestamp"), "batch": F.lit(batch_id)})
    keyed = df.filter(F.col(key).isNotNull())
    rest = [c for c in df.columns if c not in (key, "_arrival")]
    new = first_by_key(keyed, key, ["_arrival", *[c for c in ("timestamp",) if c in rest]])
    old = known_keys(spark, path, new.select(key), key, done, buckets)
    if old is not None:
        new = new.join(old, key, "left_anti")
    rows = new.unionByName(df.filter(F.col(key).isNull()))
    writer = rows.withColumnRenamed("_arrival", "arrival_seq").repartitionByRange("event_date", "timestamp", key).sortWithinPartitions("timestamp", key).write
    _overwriting(writer).partitionBy("event_date", "batch").parquet(f"{path}/rows")

    written = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").filter((F.col("batch") == batch_id) & F.col(key).isNotNull())
    _write_keys(written.select(key, "batch"), path, key, buckets)
    fs, marker = _fs(spark, f"{path}/commits/{batch_id}")
    fs.create(marker, True).close()
    _fold(spark, path, key, batch_id, buckets)


def _overwriting(writer):
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")


def _write_keys(keys: DataFrame, path: str, key: str, buckets: int) -> None:
    # One file for each bucket.
    rows = keys.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", key)
    writer = _overwriting(rows.write).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.partitionBy("bucket", "batch").parquet(f"{path}/keys")


def _fold(spark: SparkSession, path: str, key: str, batch_id: int, buckets: int) -> None:
    """Make one file of each bucket whose turn it is. A reader in between sees keys twice, which changes nothing."""
    turn = [b for b in range(buckets) if b % FOLD == batch_id % FOLD]
    many = {}
    for b in turn:
        old = [n for n in _names(spark, f"{path}/keys/bucket={b}") if n.startswith("batch=")]
        if len(old) > 1:
            many[b] = [n for n in old if int(n.split("=")[1]) != batch_id]
    if not many:
        return
    folders = [f"{path}/keys/bucket={b}" for b in many]
    keys = spark.read.option("basePath", f"{path}/keys").parquet(*folders).filter(F.col("batch") <= batch_id)
    _write_keys(keys.select(key, F.lit(batch_id).alias("batch")), path, key, buckets)
    for b, names in many.items():
        for name in names:
            fs, target = _fs(spark, f"{path}/keys/bucket={b}/{name}")
            fs.delete(target, True)


def read_first(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``arrival_seq`` (the order inside their batch) and ``batch``."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.filter(F.col("batch") <= committed(spark, path))


def key_files(spark: SparkSession, path: str) -> dict[int, int]:
    """Files per bucket, to watch what an append has to open."""
    return {int(n.split("=")[1]): len(_names(spark, f"{path}/keys/{n}")) for n in _names(spark, f"{path}/keys") if n.startswith("bucket=")}
