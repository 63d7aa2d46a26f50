"""Helpers that write the DuckDB oracle statements (one UNION ALL arm per column)."""

from __future__ import annotations


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def nearest(col: str, q: float) -> str:
    """Element at round((n-1)·q) of the sorted non-null values (1-based list)."""
    return (f"list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL))"
            f"[1 + CAST(round((count({col}) - 1) * {q}) AS BIGINT)]")
