"""Quoting for SQL expression strings.

Generated expressions (one term per class, per column pair, per feature) are
built as SQL text: Spark parses a text once, while every operator on a Column
object is a round trip to the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def names(columns: Iterable[str]) -> str:
    return ", ".join(name(c) for c in columns)


def texts(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)
