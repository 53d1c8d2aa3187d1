"""Event sources. Readers take ``stream=True`` to follow a folder with Structured Streaming; the file source's
checkpoint is the memory of files already seen, and ``max_files`` is the back-pressure (nothing is dropped)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import fixed
from tracewarden.functions.text import blank
from tracewarden.functions.times import instant, windows_ts


def _reader(spark: SparkSession, stream: bool, max_files: int | None = None):
    if not stream:
        return spark.read
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def read_json_text(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """One JSON event per line, as text in ``value``; see operators.validate.parse_event_json."""
    return _reader(spark, stream, max_files).text(path)


def read_kafka_text(spark: SparkSession, servers: str, topic: str, stream: bool = True, max_offsets: int | None = None):
    """The same from a Kafka topic (needs the Kafka connector on the class path)."""
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets and stream:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def read_log_lines(
    spark: SparkSession, path: str, stream: bool = False, host: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Linux log lines with ``hostname`` and ``log_file``. The host is given, or is the folder that holds the file.
    Blank lines and journal markers (``--``) are dropped."""
    raw = _reader(spark, stream, max_files).text(path)
    file = F.col("_metadata.file_path")
    return raw.select(
        "value",
        F.element_at(F.split(file, "/"), -1).alias("log_file"),
        (F.lit(host) if host else F.element_at(F.split(file, "/"), -2)).alias("hostname"),
    ).filter((F.trim("value") != "") & ~F.col("value").startswith("--"))


def default_log_glob(root: str) -> list[str]:
    """Paths of the usual log files below ``root``/<host>/."""
    return [f"{root}/*/{name}" for name in fixed.LINUX_LOG_FILES]


def read_windows_xml(
    spark: SparkSession, path: str, as_of, default_host: str = "unknown", stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """Windows events from XML files of any size: a file is cut at each end tag, so one file feeds many tasks."""
    raw = _reader(spark, stream, max_files).option("lineSep", "</Event>").text(path)
    return parse_windows_xml(raw.select(F.concat("value", F.lit("</Event>")).alias("value")), as_of, "value", default_host)


_XML = (
    "System struct<EventID:string, TimeCreated:struct<_SystemTime:string>, Computer:string, Channel:string>, "
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)


def parse_windows_xml(df: DataFrame, as_of, col: str = "value", default_host: str = "unknown") -> DataFrame:
    """Text holding any number of ``<Event ...>...</Event>`` blocks -> Windows records; broken blocks are skipped."""
    blocks = F.regexp_extract_all(F.col(col), F.lit(r"(?s)(<Event .*?</Event>)"), F.lit(1))
    rest = [c for c in df.columns if c != col]
    df = df.select(*rest, F.explode(blocks).alias("_block"))
    # One element per block; the explode keeps the filter below from repeating the XML reading.
    df = df.withColumn("_x", F.explode(F.array(F.from_xml("_block", _XML, {"mode": "PERMISSIVE"}))))
    data = F.coalesce(F.col("_x.EventData.Data"), F.array().cast("array<struct<_Name:string,_VALUE:string>>"))
    df = df.withColumn("_data", F.filter(data, lambda d: d["_Name"].isNotNull()))

    def value(name: str):
        hit = F.filter("_data", lambda d: F.lower(d["_Name"]) == name.lower())
        return F.trim(F.coalesce(F.get(hit, F.lit(0))["_VALUE"], F.lit("")))

    computer = F.col("_x.System.Computer")
    return df.withColumn("_id", F.trim("_x.System.EventID").try_cast("int")).filter("_id IS NOT NULL").select(
        *rest,
        F.col("_id").alias("raw_event_id"),
        windows_ts(F.col("_x.System.TimeCreated._SystemTime"), as_of).alias("timestamp"),
        F.when(blank(computer), F.lit(default_host)).otherwise(computer).alias("computer"),
        F.coalesce("_x.System.Channel", F.lit("")).alias("channel"),
        value("SubjectUserName").alias("subject_user"), value("TargetUserName").alias("target_user"),
        value("LogonType").alias("logon_type"), value("IpAddress").alias("ip_address"),
        value("NewProcessName").alias("process_name"), value("ServiceName").alias("service_name"),
        F.col("_block").alias("raw_payload"),
    )


def incremental(df: DataFrame, marks: DataFrame, as_of, look_back_s: int = 60) -> tuple[DataFrame, DataFrame]:
    """(rows after the high-water mark of their (computer, channel), new marks). Unknown pairs look back from ``as_of``."""
    keys = ["computer", "channel"]
    start = instant(as_of) - F.make_interval(secs=F.lit(look_back_s))
    fresh = df.join(marks.select(*keys, F.col("mark").alias("_mark")), keys, "left").filter(
        F.col("timestamp") > F.coalesce("_mark", start)).drop("_mark")
    moved = fresh.groupBy(*keys).agg((F.max("timestamp") + F.expr("INTERVAL 1 MILLISECOND")).alias("mark"))
    return fresh, marks.select(*keys, "mark").unionByName(moved).groupBy(*keys).agg(F.max("mark").alias("mark"))
