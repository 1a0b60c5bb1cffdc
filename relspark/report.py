"""Markdown reports of small result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

ROWS = 200


def _cell(v: object) -> str:
    if v is None:
        return "-"
    return f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, rows: int = ROWS) -> str:
    """A report's table; it is cut at `rows` rows, which it says."""
    got = df.limit(rows + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(_cell(r[c]) for c in df.columns) + " |" for r in got[:rows]]
    if len(got) > rows:
        lines.append(f"\nOnly the first {rows} rows are shown.")
    return "\n".join(lines)


def report(title: str, parts: dict[str, DataFrame], notes: list[str] | None = None) -> str:
    """A title, a table for each part, and notes."""
    body = [f"# {title}", *[f"## {name}\n\n{markdown_table(df)}" for name, df in parts.items()]]
    if notes:
        body.append("## Notes\n\n" + "\n".join(f"- {n}" for n in notes))
    return "\n\n".join(body) + "\n"


def atlas_report(cells: DataFrame) -> str:
    return report("Reliability atlas", {"Cells": cells.orderBy("skill", "level")}, ["clean means not detected by the scan", "reliability is accuracy times modal-answer consistency"])


def emergence_report(rows: DataFrame) -> str:
    return report("Emergence", {"Transitions": rows.groupBy("transition").count().orderBy("transition"), "Skills": rows.orderBy("skill")}, ["a skill that one model lacks counts as 0 there"])


def json_report(parts: dict[str, DataFrame], rows: int = ROWS) -> str:
    """The same tables as one JSON object, keys sorted; a table that was cut says so."""
    out = {}
    for name, df in parts.items():
        got = [r.asDict(recursive=True) for r in df.limit(rows + 1).collect()]
        out[name] = {"rows": got[:rows], "cut": len(got) > rows}
    return json.dumps(out, sort_keys=True, default=str)
