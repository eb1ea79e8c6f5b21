"""Event streams and their batch twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelode.operators.lineage import shared_folder
from pagelode.operators.vitals import largest_window


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def keep_batches(folder: str, mode: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch under its number, the last alone in complete mode: a batch that is run
    again after a lost driver replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={0 if mode == 'complete' else number}")

    return put


def drain(stream: DataFrame, name: str, mode: str, key: str | None = None) -> DataFrame:
    """The rows of a stream once all that is there is read, kept as a table in the shared folder; with `key`,
    of each key the row of the last batch."""
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    put = keep_batches(f"{folder}/rows", mode)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    if key is not None:
        return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch").alias("last")).select(key, "last.*")
    return rows.drop("batch")


def vitals_by_window(events: DataFrame, width: str) -> DataFrame:
    """Counts by class in tumbling windows; events a day late are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", width).alias("w"), "event_type")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("value") <= 10).alias("good"), F.count_if((F.col("value") > 10) & (F.col("value") <= 25)).alias("fair"), F.count_if(F.col("value") > 25).alias("poor"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", "good", "fair", "poor")


def first_seen(events: DataFrame) -> DataFrame:
    """T5: when each (user, type) came first."""
    return events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))


def progress(events: DataFrame) -> DataFrame:
    """Events by type and user."""
    return events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


def admitted(events: DataFrame, most: int, span: int) -> DataFrame:
    """Events (user_id, event_id, t) with `admitted`: whether fewer than `most` admitted ones of the
    user lie within `span` before. A partition holds whole users in time order; only the times still
    in the window are kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, kept = None, []
        for frame in frames:
            ok = []
            for u, t in zip(frame["user_id"], frame["t"]):
                if u != user:
                    user, kept = u, []
                kept = [x for x in kept if x > t - span]
                ok.append(len(kept) < most)
                if ok[-1]:
                    kept.append(t)
            yield frame.assign(admitted=ok)

    ordered = events.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return ordered.mapInPandas(run, "user_id long, event_id long, t long, admitted boolean")


def admission_stream(events: DataFrame, most: int, span: int) -> DataFrame:
    """T1 as a stream: the same, with the admitted times still in the window as each user's state. Events
    of one batch are taken in time order; those of a later batch come after."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        frame, ok = pd.concat(frames).sort_values(["t", "event_id"]), []
        for t in frame["t"]:
            kept = [x for x in kept if x > t - span]
            ok.append(len(kept) < most)
            if ok[-1]:
                kept.append(int(t))
        state.update((kept,))
        yield frame.assign(admitted=ok)[["user_id", "event_id", "t", "admitted"]]

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, t long, admitted boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def within_budget(events: DataFrame, most: int, value: float) -> DataFrame:
    """T4: events with `within`: whether the user's running count and value stay in the budget; a null
    value costs nothing."""
    running = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("within", (F.count("*").over(running) <= most) & (F.sum(F.coalesce("value", F.lit(0.0))).over(running) <= value))


def budget_stream(events: DataFrame, most: int, value: float) -> DataFrame:
    """T4 as a stream of events (user_id, event_id, ts, value): the same, with each user's count and value as
    state. Events of one batch are taken in time order; those of a later batch come after."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        frame = pd.concat(frames).sort_values(["ts", "event_id"])
        totals = np.cumsum([total, *frame["value"].fillna(0.0)])[1:]
        state.update((n + len(frame), float(totals[-1])))
        yield frame.assign(within=(n + np.arange(1, len(frame) + 1) <= most) & (totals <= value))[["user_id", "event_id", "within"]]

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, within boolean", "n long, total double", "append", GroupStateTimeout.NoTimeout)


def shift_stream(shifts: DataFrame) -> DataFrame:
    """T2, layout shifts (load_id, start, duration, value) as a stream: (load_id, best) of each load that a batch
    touches, the largest sum of a window so far. The state is the load's shifts, so that they count in time
    order whatever batch brings them; no load costs a call of its own."""
    shift = F.struct("start", F.coalesce("duration", F.lit(0.0)).alias("duration"), "value")
    return shifts.groupBy("load_id").agg(F.collect_list(shift).alias("shifts")).select("load_id", largest_window(F.col("shifts")).alias("best"))
