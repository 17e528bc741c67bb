"""Streaming forms of the state machines on ``transformWithStateInPandas``.

One processor serves all of them: it keeps a machine's state as JSON in a value state (RocksDB
provider) and feeds it the rows of its key, ordered inside the micro-batch. The state of each machine is
bounded by construction. Rows are taken in the order of their micro-batches: a source that may
deliver late rows needs a watermark and an order of its own before these operators.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import machines as MC
from ..operators import workout as WK
from ..operators.episodes import device_health
from ..operators.live import WORKOUT_SCHEMA

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class StepProcessor(StatefulProcessor):
    """Runs ``feed(state, key, rows) -> output tuples`` over a key's rows of a micro-batch."""

    def __init__(self, initial: Callable[[], dict], feed: Callable, order: list[str], key: list[str], outputs: list[str]):
        self.initial, self.feed, self.order, self.key, self.outputs = initial, feed, order, key, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else None
        state = json.loads(stored[0]) if stored else self.initial()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        out = [(*key, *o) for o in self.feed(state, key, batch)]
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[*self.key, *self.outputs])

    def close(self) -> None:
        pass


def row_by_row(inputs: list[str], step: Callable) -> Callable:
    """A feed from ``step(state, *values) -> output tuples``."""
    return lambda state, key, rows: [o for row in rows[inputs].itertuples(index=False, name=None) for o in step(state, *row)]


def run_machine(df: DataFrame, key: list[str], order: list[str], inputs: list[str], schema: str, step: Callable, initial: Callable[[], dict] = dict) -> DataFrame:
    """Apply a row-wise machine per key; ``schema`` describes the output columns after the key."""
    return run_stretches(df, key, order, schema, row_by_row(inputs, step), initial)


def run_stretches(df: DataFrame, key: list[str], order: list[str], schema: str, feed: Callable, initial: Callable[[], dict] = dict) -> DataFrame:
    """Apply ``feed`` to each key's ordered rows of each micro-batch."""
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return df.groupBy(*key).transformWithStateInPandas(StepProcessor(initial, feed, order, key, names), f"{types}, {schema}", "Append", "None")


def workout(df: DataFrame, key: list[str], t: str, classes: list[str], strength: list[str], poor: str | None = None) -> DataFrame:
    """Workout events from probability rows; sample-driven, like the batch form without its final flush."""
    def feed(state, device, rows):
        policy = WK.Workout(classes, strength, "|".join(str(v) for v in device), state or None)
        bad = rows[poor].fillna(False).to_numpy(bool) if poor else np.zeros(len(rows), bool)
        out = policy.advance(rows[t].to_numpy(float), rows[classes].to_numpy(float), bad)
        state.update(policy.state)
        return out

    return run_stretches(df, key, [t], WORKOUT_SCHEMA, feed)


def batch_clock(df: DataFrame, key: list[str], order: str, count: str, arrival: str, rate_hz: float = 100.0) -> DataFrame:
    def feed(state, _, rows):
        rows = rows[rows[count] > 0]
        first, period = WK.clock(state, rows[count].to_numpy(float), rows[arrival].to_numpy(float), rate_hz)
        return zip(rows[order].astype(int), first.tolist(), period.tolist())

    return run_stretches(df, key, [order], "idx bigint, first_s double, period_s double", feed)


def normalise(df: DataFrame, key: list[str], t: str, order: str, channels: list[str], hz: float = 100.0) -> DataFrame:
    def feed(state, _, rows):
        at, values = WK.normalise(state, rows[t].to_numpy(float), rows[channels].to_numpy(float), hz)
        return [(a, *v) for a, v in zip(at.tolist(), values.tolist())]

    return run_stretches(df, key, [order], "t double, " + ", ".join(f"{c} double" for c in channels), feed)


def sequence_gaps(df: DataFrame, key: list[str], order: str, seq: str) -> DataFrame:
    return run_machine(df, key, [order], [order, seq], "idx bigint, sequence_gaps bigint", lambda s, at, q: [(int(at), MC.sequence_step(s, int(q)))])


def debounce(df: DataFrame, key: list[str], order: str, label: str, need: int = 3) -> DataFrame:
    return run_machine(df, key, [order], [order, label], "idx bigint, stable string", lambda s, at, v: [(int(at), MC.debounce_step(s, v, need))])


def posture_episodes(df: DataFrame, key: list[str], t: str, label: str, on: float = 30.0, off: float = 5.0) -> DataFrame:
    """posture_started / posture_ended events; a NULL label is an unsure window."""
    return run_machine(df, key, [t], [t, label], "type string, posture string, at double, duration_seconds double",
                       lambda s, time, v: [tuple(e.values()) for e in MC.hold_step(s, time, v if isinstance(v, str) else None, on, off)])


def frames(df: DataFrame, key: list[str], order: str, payload: str) -> DataFrame:
    """Decoded 20-byte frames; incomplete ones wait in the state."""
    axes = ["ax_g", "ay_g", "az_g", "gx_dps", "gy_dps", "gz_dps", "roll_deg", "pitch_deg", "yaw_deg"]

    def feed(s, at, chunk):
        work = {"buf": bytes.fromhex(s.get("buf", "")), "lost": s.get("lost", 0)}
        out = MC.frame_step(work, bytes(chunk))
        s.update(buf=work["buf"].hex(), lost=work["lost"])
        return [(int(at), int(work["lost"]), *v) for v in out]

    return run_machine(df, key, [order], [order, payload], "idx bigint, discarded bigint, " + ", ".join(f"{a} double" for a in axes), feed)


def causal_windows(df: DataFrame, key: list[str], t: str, window: float = 4.0, hop: float = 1.0) -> DataFrame:
    def feed(s, time):
        e = MC.window_step(s, time, window, hop)
        return [tuple(e.values())] if e else []

    return run_machine(df, key, [t], [t], "now double, samples int, oldest_s double", feed)


def calibrate(samples: DataFrame, key: list[str], t: str, gyro: str, command: str, seconds: float = 10.0, limit: float = 8.0) -> DataFrame:
    """Calibration results; commands are rows of the same stream (``command`` set, gyro ignored)."""
    def feed(s, time, g, c):
        e = MC.calibrate_step(s, time, g, c if isinstance(c, str) else None, seconds, limit)
        return [tuple(e.values())] if e else []

    return run_machine(samples, key, [t], [t, gyro, command], "ok boolean, start double, end double, mean_gyro double, attempts int", feed)


def new_events(df: DataFrame, id_: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """First copy of each event id within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_])


def append_new(store_path: str, id_: str):
    """foreachBatch sink: append only ids the store does not have, so a replayed batch adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([id_])
        try:
            known = spark.read.parquet(store_path).select(id_)
            fresh = fresh.join(known, id_, "left_anti")
        except Exception as error:  # the store does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(store_path)

    return write


def health(df: DataFrame, key: str) -> DataFrame:
    """Device counters; write with output mode ``update``."""
    return device_health(df, key)
