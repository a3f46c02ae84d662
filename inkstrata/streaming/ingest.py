"""Structured Streaming: documents from a folder, trends and sessions of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstrata.operators.reports import exact_mean


def documents(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files under ``path``, a folder or a single file, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    # a stream reads folders: a single file is the one name of its folder that the pattern fits
    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = f"{folder}/{name[:-1]}[{name[-1]}]" if name and name[-1].isalnum() else path
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def trend(log: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day", key: str = "event_type") -> DataFrame:
    """Windowed counts and means, for append mode: a window is given once the watermark has passed it, and its state goes; rows later than ``late`` are dropped.

    Means are of decimals, so that they do not depend on the order of summation.
    """
    return log.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("events"), exact_mean(F.col("value")).alias("value")).select(F.col("w.start").alias("begin"), key, "events", "value")


def sessions(log: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Runs of events of a key with no longer pause than ``gap``."""
    return log.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, exactly once, to Parquet; the query has ended when this returns."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return q


TOKEN_SCHEMA = "scope string, entity string, value string, token string"


def pseudonyms(findings: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, entity, value, token) of values that a stream of findings (scope, entity, value) brings for the first time.

    The state of a scope and entity is the tokens given so far, so a value keeps its token across batches and restarts; numbers follow
    the order of arrival. A scope (a document, a case) is of bounded size.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def number(key: tuple, batches, state: GroupState):
        known = dict(zip(*state.get)) if state.exists else {}
        new = []
        for rows in batches:
            for v in rows["value"]:
                if v is not None and v not in known:
                    known[v] = f"{key[1]}_{len(known) + 1:03d}"
                    new.append((key[0], key[1], v, known[v]))
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(new, columns=["scope", "entity", "value", "token"])

    rows = findings.select(F.col(scope).cast("string").alias("scope"), "entity", "value")
    return rows.groupBy("scope", "entity").applyInPandasWithState(number, TOKEN_SCHEMA, "known array<string>, tokens array<string>", "append", GroupStateTimeout.NoTimeout)
