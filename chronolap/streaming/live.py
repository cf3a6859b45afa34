"""The folds over streams: the same machines as in batch, their state kept by session between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolap.streaming import folds
from chronolap.streaming.runs import RunTracker
from chronolap.streaming.trackers import AttemptCounter

READINGS = "session_id long, t_ms long, id long, value long, started boolean"
OUT = "session_id long, id long, t_ms long, kind string, value_ms long, other_ms long, reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _runs(state: RunTracker, r) -> list[tuple]:
    return [(k, a, b, why) for k, a, b, why in state.observe(int(r.t_ms), None if pd.isna(r.value) else int(r.value))]


def _counter(state: AttemptCounter, r) -> list[tuple]:
    if r.started is True or r.started == 1:
        state.new_run()
    got = state.observe(int(r.t_ms), None if pd.isna(r.value) else int(r.value))
    return [(got[0], got[1], got[2], None)] if got else []


def _gate(state: folds.ClockGate, r) -> list[tuple]:
    got = state.observe(int(r.t_ms), None if pd.isna(r.value) else int(r.value))
    return [] if got is None else [("accepted", got, None, None)]


def _smooth(state: folds.Smoother, r) -> list[tuple]:
    got = state.observe(int(r.t_ms), None if pd.isna(r.value) else int(r.value))
    return [] if got is None else [("smoothed", got, None, None)]


MACHINES: dict[str, tuple[Callable, Callable]] = {"runs": (RunTracker, _runs), "counter": (AttemptCounter, _counter), "gate": (folds.ClockGate, _gate), "smoother": (folds.Smoother, _smooth)}


class Machine(StatefulProcessor):
    """One machine for each session; readings of a micro-batch are taken in order of t_ms and id."""

    def __init__(self, name: str):
        self.name = name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "machine binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        make, step = MACHINES[self.name]
        machine = pickle.loads(self.state.get()[0]) if self.state.exists() else make()
        out = []
        for r in pd.concat(list(rows)).sort_values(["t_ms", "id"], kind="stable").itertuples():
            out += [(int(r.session_id), int(r.id), int(r.t_ms), *x) for x in step(machine, r)]
        self.state.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=["session_id", "id", "t_ms", "kind", "value_ms", "other_ms", "reason"]).astype({"session_id": "int64", "id": "int64", "t_ms": "int64", "value_ms": "Int64", "other_ms": "Int64"})

    def close(self) -> None:
        pass


def read(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Readings from JSON lines as they come, so many files at a time."""
    return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files).json(folder)


def events(readings: DataFrame, machine: str) -> DataFrame:
    """What a machine emits over a stream of readings, by session."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return readings.groupBy("session_id").transformWithStateInPandas(Machine(machine), OUT, "append", "none")


def run(readings: DataFrame, machine: str, to: str, checkpoint: str):
    """All there is now, added to Parquet at `to`; the same checkpoint takes up where it ended."""
    return events(readings, machine).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
