"""Sinks: events as lines of JSON, in batch and as a stream."""

from pyspark.sql import DataFrame


def write_events(events: DataFrame, path):
    """One JSON line for each event, in order within each document."""
    keys = [c for c in events.columns if c not in ("seq", "event")]
    events.repartition(*keys).sortWithinPartitions(*keys, "seq").select("event").write.text(path)


def stream_events(events: DataFrame, path, checkpoint):
    """The same for a stream of events with a string column event."""
    return events.select("event").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).start()
