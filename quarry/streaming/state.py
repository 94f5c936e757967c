"""Structured Streaming: loop detection with state, and windows over event time as an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A line counts from so many characters, and so many equal ones in a row end a stream.
LINE, REPEATS = 25, 3
LOOPS = "stream string, seq long, line string"
LOOP_STATE = "last string, run int, done boolean"


def detect_loops(lines: DataFrame) -> DataFrame:
    """Streams that repeat themselves (R01): (stream, seq, line) rows to the row at which a line of LINE characters or more came the REPEATS-th time in a row; a stream ends there.

    State is one line and two numbers a stream; rows of one trigger are taken in order of seq."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, done = state.get if state.exists else (None, 0, False)
        out = []
        pdf = pd.concat(list(batches)).sort_values("seq")
        for r in pdf.itertuples():
            if done:
                break
            line = (r.line or "").strip()
            n = n + 1 if line == last else 1
            last = line
            if n >= REPEATS and len(line) >= LINE:
                done = True
                out.append((key[0], r.seq, line))
        state.update((last, n, done))
        yield pd.DataFrame(out, columns=["stream", "seq", "line"])

    return lines.groupBy("stream").applyInPandasWithState(run, LOOPS, LOOP_STATE, "append", GroupStateTimeout.NoTimeout)


def loops_in_batch(lines: DataFrame) -> DataFrame:
    """The same over a whole table, by lags over adjacent rows."""
    w = Window.partitionBy("stream").orderBy("seq")
    line = F.trim(F.coalesce("line", F.lit("")))
    same = [F.lag("t", k).over(w) == F.col("t") for k in range(1, REPEATS)]
    hits = lines.withColumn("t", line).withColumn("hit", same[0] & same[1] & (F.length("t") >= LINE)).filter("hit")
    return hits.groupBy("stream").agg(F.min("seq").alias("seq"), F.min_by("t", "seq").alias("line"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per event type in tumbling windows of event time, late rows dropped behind the watermark (extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user's events that are at most ``gap`` apart (extension)."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet folder; the checkpoint makes a rerun go on where it stopped."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def limiter_audit(calls: DataFrame, key: str, ts: str, least_ms: int) -> DataFrame:
    """Calls that came sooner after the one before than a limiter allows."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    return calls.withColumn("gap_us", gap).filter(F.col("gap_us") < 1000 * least_ms)


def cache_contents(reads: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """What a least-recently-used cache of ``capacity`` holds after all reads."""
    last = reads.groupBy(key).agg(F.max(seq).alias("last"), F.count(F.lit(1)).alias("reads"))
    return last.orderBy(F.desc("last"), key).limit(capacity)
