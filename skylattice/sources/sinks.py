"""Messages for clients as JSON, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"ignoreNullFields": "true"}


def sensor_health(offsets: DataFrame, sensors: DataFrame, frame_count: int, live_groups: int) -> DataFrame:
    """One row: the state of the network as JSON. Its size is that of the network."""
    a = offsets.agg(F.sort_array(F.collect_list(F.struct("sensor_i", "sensor_j", "offset_ns", "sample_count", "is_converged"))).alias("offsets"))
    b = sensors.agg(F.sort_array(F.collect_list(F.struct("sensor_id", "lat", "lon", "alt"))).alias("sensors"))
    body = F.struct(F.lit("sensor_health").alias("type"), "offsets", "sensors", F.lit(frame_count).alias("frame_count"), F.lit(live_groups).alias("live_groups"))
    return a.crossJoin(b).select(F.to_json(body, _SKIP).alias("json"))


def clock_sync_global(solution: DataFrame, topology: DataFrame) -> DataFrame:
    """One row: solution(sensor_id, offset_ns, uncertainty_ns) and the topology's row as JSON."""
    listed = solution.agg(F.sort_array(F.collect_list(F.struct("sensor_id", "offset_ns", "uncertainty_ns"))).alias("sensors"))
    body = F.struct(F.lit("clock_sync_global").alias("type"), "sensors", F.struct(*topology.columns).alias("topology"))
    return listed.crossJoin(topology).select(F.to_json(body, _SKIP).alias("json"))


def gdop_heatmap(points: DataFrame, stats: DataFrame, **tags) -> DataFrame:
    """One row: a grid's points and statistics as JSON."""
    listed = points.agg(F.sort_array(F.collect_list(F.struct("lat", "lon", "gdop", "quality", "num_sensors"))).alias("points"))
    extra = [F.lit(v).alias(k) for k, v in tags.items()]
    body = F.struct(F.lit("gdop_heatmap").alias("type"), *extra, "points", F.struct(*stats.columns).alias("stats"))
    return listed.crossJoin(stats).select(F.to_json(body, _SKIP).alias("json"))


def write_lines(messages: DataFrame, path: str, stream: bool = False, checkpoint: str | None = None):
    """JSON lines to text files: at once, or as a stream with exactly one copy of each."""
    lines = messages.select("json")
    if not stream:
        return lines.write.mode("append").text(path)
    return lines.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def fan_out(messages: DataFrame, send, checkpoint: str):
    """Push each micro-batch's JSON lines to clients: send(iterator of lines) runs on the executors,
    once for each partition, and again if a task is retried."""
    schema = "n long"

    def push(batch: DataFrame, _):
        def batches(it):
            n = 0
            for part in it:
                send(part["json"].tolist())
                n += len(part)
            import pandas as pd

            yield pd.DataFrame({"n": [n]})

        batch.select("json").mapInPandas(batches, schema).write.format("noop").mode("overwrite").save()

    return messages.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
