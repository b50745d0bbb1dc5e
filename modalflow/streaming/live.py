"""Live analysis of ordered points, as a stateful stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modalflow.functions import kernels as k

OUT = "series string, n long, dim int, f0 double, depth double, is_anomaly boolean, error string"
STATE = "buf array<array<double>>, n long"


@dataclass(frozen=True)
class Live:
    """Window, stride and threshold of a live analysis. The detector and the depth have sampling rates of their own."""

    window: int
    dims: int = 1
    threshold: float = 0.8
    stride: int = 1
    fs_detect: float = 100.0
    fs_depth: float = 1.0
    method: str = "fft"

    def __post_init__(self) -> None:
        if self.window <= 0 or self.dims <= 0 or self.stride <= 0 or not 0 <= self.threshold <= 1:
            raise ValueError("window, dims and stride must be positive and the threshold in [0, 1]")

    def due(self, n: int) -> bool:
        return n >= self.window and (n - self.window) % self.stride == 0

    def analyse(self, series: str, n: int, rows: np.ndarray) -> list[tuple]:
        """One row per variable; an error in one leaves the others as they are."""
        out = []
        for d in range(self.dims):
            try:
                x = rows[:, d]
                found = k.detect(x, self.method, self.fs_detect)
                depth = k.depth(x, self.window, self.fs_depth)["depth"]
                out.append((series, n, d, float(found.freq[0]) if len(found.freq) else 0.0, depth, depth > self.threshold, None))
            except (ValueError, IndexError) as err:
                out.append((series, n, d, None, None, False, str(err)))
        return out

    def feed(self, series: str, buf: list, n: int, points: list) -> tuple[list, int, list[tuple]]:
        """Ordered points into the window: (window, count, rows of the analyses that fell due)."""
        out: list[tuple] = []
        for p in points:
            if p is None:  # a point without values starts the series anew
                buf, n = [], 0
                continue
            if len(p) != self.dims:
                raise ValueError(f"a point has {len(p)} values; {self.dims} are expected")
            buf = [*buf[-(self.window - 1) :], list(p)] if self.window > 1 else [list(p)]
            n += 1
            if self.due(n):
                out += self.analyse(series, n, np.array(buf, float))
        return buf, n, out


def stream(points: DataFrame, live: Live) -> DataFrame:
    """points(series, ts, seq, x array<double>) to analyses; within a micro-batch points go by (ts, seq).

    The state of a series is its last window and its count, so it survives a restart from the checkpoint.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buf, n = state.get if state.exists else ([], 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "seq"])
        buf, n, rows = live.feed(key[0], [list(b) for b in buf], int(n), [None if x is None else list(x) for x in pdf["x"]])
        state.update(([[float(v) for v in b] for b in buf], n))
        yield pd.DataFrame(rows, columns=["series", "n", "dim", "f0", "depth", "is_anomaly", "error"])

    return points.groupBy("series").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def batch(points: DataFrame, live: Live) -> DataFrame:
    """The same rows from a table: each due window is an array of its own, so one series' windows spread over tasks."""
    by = Window.partitionBy("series").orderBy("ts", "seq")
    rows = points.withColumn("n", F.row_number().over(by).cast("long")).withColumn("w", F.collect_list("x").over(by.rowsBetween(-(live.window - 1), 0)))
    due = rows.where((F.col("n") >= live.window) & (F.pmod(F.col("n") - live.window, F.lit(live.stride)) == 0)).select("series", "n", "w")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [r for s, n, w in zip(pdf["series"], pdf["n"], pdf["w"], strict=True) for r in live.analyse(s, int(n), np.array([list(x) for x in w], float))]
            yield pd.DataFrame(got, columns=["series", "n", "dim", "f0", "depth", "is_anomaly", "error"])

    return due.mapInPandas(run, OUT)


def event_time(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sums of `value` by type and event-time window; rows later than `late` behind the newest are dropped by the watermark.

    Time stamps without a zone are read as UTC, which a watermark needs.
    """
    ts = events.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    g = ts.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "v", "n")
