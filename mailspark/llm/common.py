"""Shared pieces: staging in the cluster's folder, checked broadcasts, word arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir

# A side is broadcast only when its counted rows stay within this bound; the
# rows counted here are narrow (ids and single words).
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = "[ \\t-\\r]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read that copy: lineage is cut
    and lost executors cost only their own tasks."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it
    is (Spark then shuffles the join)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def ascii_lower_sql(text: str) -> str:
    """A-Z lowered, all else untouched; pure ASCII takes the fast path."""
    return (f"CASE WHEN length({text}) = octet_length({text}) THEN lower({text}) "
            f"ELSE translate({text}, '{UPPER}', '{LOWER}') END")


def words_sql(text: str, separators: str) -> str:
    """Words between runs of ``separators`` (a regex class); null: none."""
    from ..functions.sqltext import quote

    return f"array_remove(split(coalesce({text}, ''), {quote(separators)}, -1), '')"
