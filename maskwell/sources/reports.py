"""Small results as text: tables of scores, chosen thresholds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def markdown(rows: DataFrame, title: str = "", digits: int = 4) -> str:
    """An aggregate table (a few rows) as Markdown."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows.collect()]) + "\n"


def thresholds_json(chosen: DataFrame) -> str:
    """{"policy": {"thresholds": {category: threshold}}}, which load_policy reads."""
    return json.dumps({"policy": {"thresholds": {r["category"]: r["threshold"] for r in chosen.collect()}}}, indent=2, sort_keys=True)
