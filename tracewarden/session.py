"""Session helpers shared by every operator: reliable checkpoints, size estimates, broadcast guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count has been measured or is bounded by construction below this.
BROADCAST_ROWS = 200_000
# Rows of one file of a scratch table: what a single task wrote, say of an input that does not split, is read by many.
FILE_ROWS = 1_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Settings the engine relies on, safe to apply to any session.

    The JVM never compiles methods above 8000 bytes of bytecode, so wider stages run faster as separate operators.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(app: str = "tracewarden", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracewarden-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: it outlives the executors that wrote it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new path below the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared scratch folder: later readers prune columns and push filters down."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys of the left side remain."""
    keys = list(keys)
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a measured row count under the bound; otherwise Spark decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
