"""Pieces of Spark SQL text.

Large expressions are written as SQL text: one parse on the JVM instead of
thousands of calls from Python.
"""

from __future__ import annotations

from typing import Iterable


def quote(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def string_array(items: Iterable[str]) -> str:
    return f"cast(array({', '.join(map(quote, items))}) AS array<string>)"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once per row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def case(*branches: tuple[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {cond} THEN {value}" for cond, value in branches)
    return f"CASE {whens} ELSE {default} END" if branches else default
