"""What tells frames apart: ``f``, and ``video`` before it where a table has that column."""

from __future__ import annotations

from pyspark.sql import DataFrame


def video(df: DataFrame) -> list[str]:
    return [c for c in ("video",) if c in df.columns]


def frame(df: DataFrame) -> list[str]:
    return [*video(df), "f"]
