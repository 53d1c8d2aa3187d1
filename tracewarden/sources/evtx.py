"""Exported Windows event logs (EVTX): carved for readable fields, chunk by chunk, in parallel.

A file is a 4096-byte header and chunks of 65536 bytes. Spark lists the files and spreads (file, chunk range) pairs
over the cluster; each task reads only its range, so one large file feeds many tasks and no file is held whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions import fixed
from tracewarden.functions.text import blank, clean_value
from tracewarden.functions.times import filetime_ts

# Layout of the format.
FILE_MAGIC, CHUNK_MAGIC, RECORD_MAGIC = b"ElfFile\x00", b"ElfChnk\x00", b"\x2a\x2a\x00\x00"
FILE_HEADER, CHUNK_HEADER, CHUNK_SIZE = 4096, 512, 65536
RECORD_MIN, RECORD_MAX, RECORD_HEADER = 24, 65000, 24
# Field names in the text of a record -> column.
FIELDS = {
    "computer": "computer", "channel": "channel", "subjectusername": "subject_user", "targetusername": "target_user",
    "ipaddress": "ip_address", "logontype": "logon_type", "newprocessname": "process_name", "servicename": "service_name",
}
CHUNKS_PER_TASK_ROW = 64

_UTF16 = re.compile(rb"[\x20-\x7e]\x00(?:[\x20-\xff]\x00|[\x00-\xff][\x01-\xff])*")
_CONTROL = re.compile("[\x00-\x1f\x7f]")
_NAME = re.compile(r"[A-Z][^ ]{1,39}")
CARVED = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("raw_event_id", T.IntegerType()),
     T.StructField("filetime", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in FIELDS.values()]
    + [T.StructField("raw_payload", T.StringType())]
)


def texts_of(payload: bytes) -> list[str]:
    """Readable UTF-16LE runs of at least three characters."""
    runs = (m.group().decode("utf-16-le", "replace") for m in _UTF16.finditer(payload) if len(m.group()) >= 6)
    return [t for t in runs if not _CONTROL.search(t)]


def carve_record(record: bytes) -> dict | None:
    """Fields of one record, or None when its event id is unknown or not monitored."""
    payload = record[RECORD_HEADER:]
    texts = texts_of(payload)
    out = dict.fromkeys(FIELDS.values(), "")
    number = 0
    for name, following in zip(texts, texts[1:]):
        low = name.lower()
        if low in FIELDS and not out[FIELDS[low]] and not _NAME.fullmatch(following):
            out[FIELDS[low]] = following
        if not number and low in ("eventid", "eventrecordid"):
            digits = re.match(r"\s*\+?(\d+)", following)
            if digits and 0 < int(digits.group(1)) < 65536:
                number = int(digits.group(1))
    if not number:
        tail = payload[24:]
        words = np.frombuffer(tail[: len(tail) // 2 * 2], dtype="<u2")
        known = words[np.isin(words, list(fixed.WINDOWS_EVENTS))]
        number = int(known[0]) if len(known) else 0
    if number not in fixed.MONITORED_IDS:
        return None
    filetime = struct.unpack_from("<Q", record, 16)[0]
    return out | {"raw_event_id": number, "filetime": min(filetime, 2**63 - 1), "raw_payload": " | ".join(texts)}


def carve_chunk(chunk: bytes) -> Iterator[dict]:
    if not chunk.startswith(CHUNK_MAGIC):
        return
    at = chunk.find(RECORD_MAGIC, CHUNK_HEADER)
    while at >= 0 and at + 8 <= len(chunk):
        size = struct.unpack_from("<I", chunk, at + 4)[0]
        step = 1
        if RECORD_MIN <= size <= RECORD_MAX:
            if at + size > len(chunk):
                return
            found = carve_record(chunk[at:at + size])
            if found:
                yield found
            step = size
        at = chunk.find(RECORD_MAGIC, at + step)


def _carve(batches):
    for batch in batches:
        for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
            system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            with system.open_input_file(inner) as f:
                if f.read_at(8, 0) != FILE_MAGIC:
                    continue
                data = f.read_at(stop - start, start)
            rows = [
                row | {"path": path}
                for i in range(0, len(data), CHUNK_SIZE)
                for row in carve_chunk(data[i:i + CHUNK_SIZE])
            ]
            yield pd.DataFrame(rows, columns=CARVED.fieldNames())


def read_evtx(spark: SparkSession, path: str, as_of, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """EVTX files of a folder -> Windows records (see operators.normalize). With ``stream`` new files are followed."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    listing = "path string, modificationTime timestamp, length long, content binary"
    files = reader.format("binaryFile").schema(listing).option("pathGlobFilter", "*.[eE][vV][tT][xX]").load(path)
    step = CHUNK_SIZE * CHUNKS_PER_TASK_ROW
    # Only path and length are read here; the content column is pruned.
    ranges = files.filter(F.col("length") > FILE_HEADER).select(
        "path", "length", F.explode(F.sequence(F.lit(FILE_HEADER), F.col("length") - 1, F.lit(step))).alias("start")
    ).select("path", "start", F.least("length", F.col("start") + step).alias("stop")).repartition("path", "start")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.evtx$", "")
    carved = ranges.mapInPandas(_carve, CARVED)
    return carved.select(
        "raw_event_id", filetime_ts(F.col("filetime"), as_of).alias("timestamp"),
        F.when(blank(F.col("computer")), stem).otherwise(F.col("computer")).alias("computer"), "channel",
        *[clean_value(F.col(c)).alias(c) for c in ("subject_user", "target_user")], "logon_type",
        clean_value(F.col("ip_address")).alias("ip_address"), "process_name", "service_name", "raw_payload",
    )
