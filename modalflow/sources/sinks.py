"""Sinks: tidy CSV exports, JSON and Markdown reports, and the review log."""

from __future__ import annotations

import dataclasses
import json
import math
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def with_meta(df: DataFrame, meta: dict) -> DataFrame:
    """df with meta_* columns; nested values as JSON text."""
    return df.withColumns({f"meta_{k}": F.lit(v if isinstance(v, (str, int, float, bool)) or v is None else json.dumps(v, sort_keys=True)) for k, v in sorted(meta.items())})


def write_csv(tables: dict[str, DataFrame], folder: str, stem: str, meta: dict | None = None) -> list[str]:
    """One CSV folder per result table."""
    out = []
    for name, df in tables.items():
        path = f"{folder}/{stem}_{name}"
        with_meta(df, meta or {}).write.mode("overwrite").option("header", True).csv(path)
        out.append(path)
    return out


def write_scenarios(df: DataFrame, folder: str) -> None:
    """Shock rows laid out by mode and shock, so that a reader of one scenario prunes the rest."""
    df.write.mode("overwrite").partitionBy("aoci_mode", "shock_bps").option("header", True).csv(folder)


def append_review(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def plain(value, leave_out: tuple[str, ...] = ("cov", "predicted_cov")):
    """Any result as values that JSON knows: rows, records, arrays, sets, dates; covariance tensors are left out, what is not finite is null."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        value = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)}
    elif isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): plain(v, leave_out) for k, v in value.items() if k not in leave_out}
    if isinstance(value, np.ndarray | np.generic):
        value = value.tolist()
    if isinstance(value, set | frozenset):
        value = sorted(value, key=repr)
    if isinstance(value, list | tuple):
        return [plain(v, leave_out) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if value is None or isinstance(value, str | int | float | bool):
        return value
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def write_config(path: str, config: dict) -> None:
    """A config that `scans.from_config` reads, as JSON text (which YAML readers take too)."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(config), indent=2, sort_keys=True) + "\n")


def write_report(path: str, report: dict, text: str) -> None:
    """A small collected summary as JSON (sorted keys) and Markdown."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.with_suffix(".json").write_text(json.dumps(plain(report), indent=2, sort_keys=True))
    p.with_suffix(".md").write_text(text)
