"""Supervisory reference tables, readiness documents and report text. Metadata, built on the driver."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

#: Names that callers use.
PROFILES = ("community_bank", "regional_or_foreign_bank_under_100b", "large_bank_or_large_fbo", "g_sib", "financial_market_utility")
DOMAINS = ("capital", "liquidity", "asset_quality", "earnings", "market_risk", "operational_resilience", "governance_controls", "interconnectedness")
CHECKLIST = ("materiality", "proportionality", "timeliness", "source_data_lineage", "peer_group_fit", "diagnostic_boundary")
DISPOSITIONS = ("useful", "noisy", "missed", "needs_review")
AUDIENCES = ("general", "physics", "policy", "supervision")

CAVEATS = {
    "general": "Modes and lead-lag links describe the sample; they do not prove causes.",
    "physics": "Depth compares signals under one window and sampling rate; check both before comparing runs.",
    "policy": "Lead-lag links are statistical; policy conclusions need structural evidence.",
    "supervision": "Scores are diagnostics for reviewers and are no ratings or findings.",
}


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    def one(kind: str, names: tuple[str, ...]) -> DataFrame:
        return spark.createDataFrame([(i, n, n.replace("_", " ").title()) for i, n in enumerate(names)], f"position int, {kind} string, title string")

    return {"profiles": one("profile", PROFILES), "domains": one("domain", DOMAINS), "checklist": one("item", CHECKLIST)}


def drop_empty(d: dict) -> dict:
    return {k: v for k, v in d.items() if v not in (None, "", [], {}, ())}


def model_card(name: str, purpose: str, owner: str | None = None, limits: list[str] | None = None) -> dict:
    return drop_empty({"name": name, "purpose": purpose, "owner": owner, "limits": limits or ["diagnostic use only"], "monitoring": "Review alerts and misses each quarter; recalibrate thresholds when precision falls."})


def alignment(profile: str, domains: list[str]) -> dict:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}; expected one of {', '.join(PROFILES)}")
    bad = [d for d in domains if d not in DOMAINS]
    if bad:
        raise ValueError(f"unknown domains: {', '.join(bad)}")
    return {"profile": profile, "domains": list(domains), "checklist": {c: "open" for c in CHECKLIST}}


def readiness(card: dict, summary: dict, backtest: dict | None = None) -> dict:
    return drop_empty({"status": "backtested" if backtest else "needs_backtest", "card": card, "analysis": summary, "backtest": backtest, "checklist": list(CHECKLIST)})


def shadow_record(series: str, disposition: str, note: str = "") -> dict:
    if disposition not in DISPOSITIONS:
        raise ValueError(f"unknown disposition {disposition}; expected one of {', '.join(DISPOSITIONS)}")
    return drop_empty({"series": series, "disposition": disposition, "note": note, "at": datetime.now(UTC).isoformat()})


def four(x: float | None) -> str:
    return "n/a" if x is None or not math.isfinite(x) else f"{x:.4f}"


def explanation(modes: list[dict], edges: list[dict], names: list[str] | None = None, most: int = 5) -> dict:
    """The deepest modes and the first edges, with dimension numbers given their names."""

    def name(d) -> str:
        return names[int(d)] if names and str(d).isdigit() and int(d) < len(names) else f"dim_{d}"

    top = sorted(modes, key=lambda m: (-m["depth"], m["dim"]))[:most]
    return {"modes": [m | {"name": name(m["dim"])} for m in top], "edges": [e | {"src": name(e["src"]), "dst": name(e["dst"])} for e in edges[:most]]}


def markdown(audience: str, modes: list[dict], edges: list[dict], diagnostics: dict[str, float]) -> str:
    if audience not in AUDIENCES:
        raise ValueError(f"unknown audience {audience}; expected one of {', '.join(AUDIENCES)}")
    depths = [m["depth"] for m in modes]
    out = [f"# Resonance report ({audience})", "", f"Mean depth {four(sum(depths) / len(depths) if depths else None)}, largest {four(max(depths, default=None))}, edges {len(edges)}.", ""]
    if audience == "supervision":
        out += ["## Supervisory alignment", "", *(f"- {c.replace('_', ' ')}: open" for c in CHECKLIST), ""]
    out += ["## Resonance map", "", "| dimension | frequency | depth |", "| --- | --- | --- |", *(f"| {m['dim']} | {four(m.get('f0'))} | {four(m['depth'])} |" for m in modes), ""]
    out += ["## Directed rooting", "", *([f"- {e['src']} leads {e['dst']} by {e['lag']} (weight {four(e['weight'])})" for e in edges] or ["No significant directed edges."]), ""]
    out += ["## State space", "", *(f"- {k.replace('_', ' ')}: {four(v)}" for k, v in diagnostics.items()), "", CAVEATS[audience], ""]
    return "\n".join(out)
