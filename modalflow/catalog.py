"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modalflow.queries import kernels, panels, signals

FLAGSHIP = "fft_peaks"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**signals.QUERIES, **panels.QUERIES, **kernels.QUERIES}
#: Adding 0.0 turns a rounded negative zero into zero, as the queries do.
ORACLES: dict[str, str] = {k: re.sub(r"(?<!\w)round\(", "0.0 + round(", q) for k, q in {**signals.ORACLES, **panels.ORACLES, **kernels.ORACLES}.items()}
