"""Recursions of `segments` as typed state of a stream, with rows that wait for their turn, and labels by an interval join.

A series' state is a value (the fold's state and the newest row absorbed), a map of rows that wait, in packs of the rows that
came together, and a count of prints. Rows wait until the watermark has passed them and are then absorbed in order, so any order of arrival within the
allowed lateness gives the rows of the batch operator. A batch's end state can be the start. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.segments import Fold

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTHING = -(2**62)
PACK_ROWS = 50_000  # rows of a pack that waits, and of a frame given out


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session with the RocksDB state store, as it was afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Absorbing(StatefulProcessor):
    """One series: rows wait in a map until the watermark passes them, then the fold absorbs them in order."""

    def __init__(self, fold: Fold, columns: list[str], floor: int) -> None:
        self.fold, self.columns, self.floor = fold, columns, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "newest long, state array<double>")
        self.prints = handle.getValueState("prints", "n long")
        self.waiting = handle.getMapState("waiting", "pack long", "times binary, rows binary")  # packs in the order they came
        self.handle = handle

    def _held(self) -> tuple[int, tuple]:
        return (lambda s: (s[0], tuple(s[1])))(self.state.get()) if self.state.exists() else (NOTHING, self.fold.start)

    def _printed(self) -> int:
        return self.prints.get()[0] if self.prints.exists() else 0

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first = initialState.iloc[0]
        self.state.update((int(pd.Timestamp(first["newest"]).value // 1000), [float(v) for v in first["state"]]))
        self.prints.update((int(first["n"]),))

    def _packs(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(number, times, rows) of the packs that wait, in the order they came."""
        held = [(k[0], np.frombuffer(v[0], np.int64), np.frombuffer(v[1], np.float64).reshape(-1, len(self.columns))) for k, v in self.waiting.iterator()]
        return sorted(held, key=lambda p: p[0])

    def _put(self, number: int, times: np.ndarray, rows: np.ndarray) -> int:
        """Packs of the rows from number on; the next free number."""
        for k in range(0, len(times), PACK_ROWS):
            self.waiting.updateValue((number,), (times[k : k + PACK_ROWS].tobytes(), np.ascontiguousarray(rows[k : k + PACK_ROWS]).tobytes()))
            number += 1
        return number

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, least, number = self._held()[0], None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def put() -> None:
            nonlocal number
            if number is None:
                number = max((k[0] for k in self.waiting.keys()), default=-1) + 1
            number = self._put(number, *(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()

        for part in rows:
            times = part["dt"].to_numpy().astype("datetime64[us]").astype(np.int64)
            values = np.column_stack([part[c].to_numpy(float, na_value=np.nan) for c in self.columns])
            fresh = times > newest  # others are taken already, by the batch before the stream
            if fresh.any():
                held.append((times[fresh], values[fresh]))
                least = int(times[fresh].min()) if least is None else min(least, int(times[fresh].min()))
            if sum(len(t) for t, _ in held) >= PACK_ROWS:
                put()
        if held:
            put()
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        packs = self._packs()
        if not packs:
            return
        times, rows = (np.concatenate(c) for c in zip(*[p[1:] for p in packs], strict=True))
        order = np.argsort(times, kind="stable")
        order = order[np.append(times[order][1:] != times[order][:-1], True)]  # the last that came of equal times
        times, rows = times[order], rows[order]
        n = int(np.searchsorted(times, passed, side="right"))
        if n or len(packs) > 1:
            for number, _, _ in packs:
                self.waiting.removeKey((number,))
            self._put(0, times[n:], rows[n:])
        if n < len(times):
            self.handle.registerTimer(int(times[n]) // 1000 + 1)
        if not n:
            return
        _, state = self._held()
        printed = self._printed()
        for k in range(0, n, PACK_ROWS):
            at = times[k : min(k + PACK_ROWS, n)]
            arrays = list(np.ascontiguousarray(rows[k : k + len(at)].T))
            made = self.fold.run(state, *arrays)
            prints = printed + np.cumsum(~np.isnan(arrays[0]))
            state, printed = self.fold.after(state, self.fold.passed(*arrays)), int(prints[-1])
            yield pd.DataFrame({"series": key[0], "dt": pd.to_datetime(at, unit="us")} | made | {"n": prints, "admitted": prints >= self.floor})
        self.state.update((int(times[n - 1]), [float(v) for v in state]))
        self.prints.update((printed,))

    def close(self) -> None:
        pass


def absorbed(df: DataFrame, columns: list[str], fold: Fold, late: str = "2 days", floor: int = 1, start: DataFrame | None = None) -> DataFrame:
    """(series, dt, outputs of fold, n, admitted) of a stream (series, dt timestamp, columns), each row once the watermark has passed it.

    n counts the prints (rows with a first column) so far; a series is admitted from its floor-th on. The last row of equal times
    counts; Spark leaves out rows that come later than allowed. start is `end_states` of earlier rows.
    """
    rows = df.select("series", "dt", *columns).withWatermark("dt", late).groupBy("series")
    first = None if start is None else start.groupBy("series")
    return rows.transformWithStateInPandas(Absorbing(fold, columns, floor), f"series string, dt timestamp, {fold.schema}, n long, admitted boolean", "append", "eventTime", initialState=first)


def end_states(df: DataFrame, columns: list[str], fold: Fold) -> DataFrame:
    """(series, newest, state, n): what a batch (series, dt timestamp, columns) leaves behind, for a stream to go on from."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("dt", kind="stable")
        arrays = [own[c].to_numpy(float) for c in columns]
        state = fold.after(fold.start, fold.passed(*arrays))
        return pd.DataFrame({"series": own["series"].iloc[:1], "newest": own["dt"].iloc[-1:].to_numpy(), "state": [[float(v) for v in state]], "n": [int((~np.isnan(arrays[0])).sum())]})

    return df.select("series", "dt", *columns).groupBy("series").applyInPandas(run, "series string, newest timestamp, state array<double>, n long")


def labelled(calls: DataFrame, prices: DataFrame, horizon: str, slack: str, late: str = "1 day") -> DataFrame:
    """(series, dt, call, resolved, outcome) of two streams, calls (series, dt, call, px) and prices (series, dt, px).

    A call meets the prices from horizon to horizon + slack after it (as many as lie there, one where slack is a bar's length);
    outcome is the change since the call. A call without any is given out with nulls once the watermark has passed its time.
    """
    c = calls.select("series", "dt", "call", "px").withWatermark("dt", late)
    p = prices.select(F.col("series").alias("_series"), F.col("dt").alias("resolved"), F.col("px").alias("_px")).withWatermark("resolved", late)
    meets = (F.col("series") == F.col("_series")) & (F.col("resolved") >= F.col("dt") + F.expr(f"INTERVAL {horizon}")) & (F.col("resolved") < F.col("dt") + F.expr(f"INTERVAL {horizon}") + F.expr(f"INTERVAL {slack}"))
    return c.join(p, meets, "left").select("series", "dt", "call", "resolved", (F.col("_px") / F.col("px") - 1).alias("outcome"))


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives from what is there now, written under folder and read back."""
    schema = stream.schema
    with rocks(stream.sparkSession):
        run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
