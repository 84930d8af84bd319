"""Reading frames, binary packets, overrides and enrichment."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = (
    "sensor_id long, sensor_lat double, sensor_lon double, sensor_alt double, timestamp_seconds long, timestamp_nanoseconds long, raw_modes_hex string"
)
OVERRIDE_SCHEMA = "public_key string, lat double, lon double, alt double, name string"
#: Bytes of a packet before the payload: id, position, seconds of the day, nanoseconds, all big-endian.
HEADER = ">qdddQQ"
HEADER_BYTES = struct.calcsize(HEADER)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to frames; lines that don't parse, or lack a field, are dropped."""
    parsed = lines.select(F.from_json(column, FRAME_SCHEMA).alias("f")).select("f.*")
    return parsed.dropna()


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-line files as a table, or as a stream of new files."""
    return parse_lines((spark.readStream if stream else spark.read).text(path))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERRIDE_SCHEMA).option("multiLine", True).json(path)


def epoch_seconds(second_of_day: Column, received: Column) -> Column:
    """Seconds of the day to an epoch, on the day of receipt; a result over half a day away is of the day beside."""
    now = F.unix_seconds(received)
    at = now - F.pmod(now, F.lit(86400)) + second_of_day
    return F.when(at - now > 43200, at - 86400).when(now - at > 43200, at + 86400).otherwise(at)


def decode_packets(packets: DataFrame) -> DataFrame:
    """packets(public_key, ingest_ts, packet): frames. Packets below the header's size are dropped."""
    kept = packets.filter(F.octet_length("packet") >= HEADER_BYTES)

    def batches(it):
        for batch in it:
            rows = [struct.unpack_from(HEADER, p) for p in (v.as_py() for v in batch.column("packet"))]
            payload = [v.as_py()[HEADER_BYTES:].hex() for v in batch.column("packet")]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("public_key"),
                    batch.column("ingest_ts"),
                    pa.array(columns[0], pa.int64()),
                    *(pa.array(columns[i], pa.float64()) for i in (1, 2, 3)),
                    pa.array([x & (1 << 63) - 1 for x in columns[4]], pa.int64()),
                    pa.array([x & (1 << 63) - 1 for x in columns[5]], pa.int64()),
                    pa.array(payload, pa.string()),
                ],
                names=["public_key", "ingest_ts", "sensor_id", "sensor_lat", "sensor_lon", "sensor_alt", "sod", "timestamp_nanoseconds", "raw_modes_hex"],
            )

    schema = "public_key string, ingest_ts timestamp, sensor_id long, sensor_lat double, sensor_lon double, sensor_alt double, sod long, timestamp_nanoseconds long, raw_modes_hex string"
    out = kept.select("public_key", F.col("ingest_ts").cast("timestamp").alias("ingest_ts"), "packet").mapInArrow(batches, schema)
    return out.withColumn("timestamp_seconds", epoch_seconds(F.col("sod"), F.col("ingest_ts"))).drop("sod")


def split_packets(data: bytes) -> list[bytes]:
    """Packets of a byte stream: each after a byte of its length; a length of zero is skipped, and an
    unfinished packet at the end dropped."""
    out, at = [], 0
    while at < len(data):
        size = data[at]
        at += 1
        if size and at + size <= len(data):
            out.append(data[at : at + size])
        at += size
    return out


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Files of length-prefixed packets, one recorded stream each: (public_key, ingest_ts, packet). The
    file's name is the key, and its time that of receipt."""

    def batches(it):
        for batch in it:
            for name, at, content in zip(batch.column(0), batch.column(1), batch.column(2)):
                packets = split_packets(content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(packets), pa.string()), pa.array([at.as_py()] * len(packets), batch.schema.field(1).type), pa.array(packets, pa.binary())],
                    names=["public_key", "ingest_ts", "packet"],
                )

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1), "modificationTime", "content")
    return files.mapInArrow(batches, "public_key string, ingest_ts timestamp, packet binary")


def parse_enrichment(replies: DataFrame) -> DataFrame:
    """replies(icao24, body): the first state's callsign, origin country and squawk; empty ones are null."""
    states = F.from_json("body", "struct<states: array<array<string>>>")["states"][0]
    pick = lambda i: F.nullif(F.trim(F.get(states, F.lit(i))), F.lit(""))
    return replies.select("icao24", pick(1).alias("callsign"), pick(2).alias("origin_country"), pick(14).alias("squawk"))
