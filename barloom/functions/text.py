"""Small builders for SQL expression text.

The feature projection has some hundred expressions. As text each costs one call into the JVM, and the
columns it reads can be found by name, so a caller who wants a few features gets only what they need.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def bound(x: str, lo: float, hi: float) -> str:
    """Clip to [lo, hi]. x must not be NULL here: callers gate on what makes it defined."""
    return f"greatest({float(lo)}D, least({float(hi)}D, {x}))"


def gated(gate: str, value: str, default: str) -> str:
    """value where the gate holds, else the default (also when the gate is unknown)."""
    return f"CASE WHEN {gate} THEN {value} ELSE {default} END"


def pct(new: str, old: str) -> str:
    """Change in percent; the caller's gate excludes a zero base."""
    return f"({new} - {old}) / {old} * 100"


def needed_levels(levels: list[dict[str, str]], wanted) -> list[dict[str, str]]:
    """Only the expressions the wanted columns depend on, level by level."""
    need = set(wanted)
    kept: list[dict[str, str]] = []
    for level in reversed(levels):
        used = {name: text for name, text in level.items() if name in need}
        for text in used.values():
            need.update(re.findall(r"\w+", text))
        kept.append(used)
    return kept[::-1]


def apply_levels(df: DataFrame, levels: list[dict[str, str]]) -> DataFrame:
    """One projection per non-empty level."""
    for level in levels:
        if level:
            df = df.selectExpr("*", *[f"{text} AS `{name}`" for name, text in level.items()])
    return df
