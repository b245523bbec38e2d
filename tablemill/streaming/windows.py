"""Windows over streams of rows: sliding windows, sessions, and runs of equal states, with late rows and restarts.

State is kept by Spark and dropped once the watermark has passed it: sliding windows and sessions by its own operators, runs
by a stateful one of ours. All results are given once, when nothing can change them any more. Where a stream is drained
(``drained``), rows still open at its end come with the first rows that are later than them by more than the lateness.

Edge cases: rows without a time are left out; a null key is a key; rows later than ``late`` allows may be dropped, as the watermark says; a stream
that has had no rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablemill.functions.names import col


def sliding(stream: DataFrame, time: str, by: Sequence[str], width: str, slide: str, late: str, value: str) -> DataFrame:
    """(window_start, by…, n, total): rows and their sum of ``value`` in each window of ``width`` that starts every ``slide``."""
    own = stream.withWatermark(time, late).groupBy(F.window(col(time), width, slide).alias("w"), *map(col, by)).agg(F.count("*").alias("n"), F.sum(col(value)).alias("total"))
    return own.select(F.col("w.start").alias("window_start"), *map(col, by), "n", "total")


def sessions(stream: DataFrame, time: str, by: Sequence[str], gap: str, late: str, value: str) -> DataFrame:
    """(session_start, session_end, by…, n, total): runs of rows of a key with less than ``gap`` between two of them; the end is the last row's time and the gap."""
    own = stream.withWatermark(time, late).groupBy(F.session_window(col(time), gap).alias("w"), *map(col, by)).agg(F.count("*").alias("n"), F.sum(col(value)).alias("total"))
    return own.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *map(col, by), "n", "total")


def state_changes(stream: DataFrame, time: str, key: str, value: str, late: str) -> DataFrame:
    """(key, since, value, before): each row whose value differs from the one before it of its key, in the order of time.

    A key's rows are held back until the watermark has passed them, and then taken in order; its last value is kept until then.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.filter(col(time).isNotNull()).select(col(key).alias("key"), col(time).cast("timestamp").alias("time"), col(value).cast("string").alias("value")).withWatermark("time", late)

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, last, known = state.get if state.exists else ([], [], None, False)
        waiting = list(zip(times, values, strict=True))
        for pdf in batches:
            waiting += zip(pdf["time"].to_numpy("datetime64[us]").astype("int64").tolist(), pdf["value"].tolist(), strict=True)
        sure = state.getCurrentWatermarkMs() * 1000  # microseconds
        ready = sorted((w for w in waiting if w[0] <= sure), key=lambda w: (w[0], w[1] is not None, w[1] or ""))
        waiting = [w for w in waiting if w[0] > sure]
        found = []
        for t, v in ready:
            if not known or v != last:
                found.append((t, v, last))
            last, known = v, True
        state.update(([w[0] for w in waiting], [w[1] for w in waiting], last, known))
        if waiting:
            state.setTimeoutTimestamp(max(min(w[0] for w in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if found:  # most calls have no rows to give, and a table of none takes as long as one of many
            times, values, befores = zip(*found, strict=True)
            yield pd.DataFrame({"key": [keys[0]] * len(found), "since": np.array(times, "datetime64[us]"), "value": values, "before": befores})

    out = rows.groupBy("key").applyInPandasWithState(update, f"key {kind}, since timestamp, value string, before string", "times array<long>, vals array<string>, last string, known boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)


def drained(result: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there now and adds its rows to a table; run again with the same checkpoint it goes on from there."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def table_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, the oldest first, ``per_batch`` at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
