"""Investigation history on append-only tables (K4-K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that keep their first written value when a state is saved again.
FIRST_WRITE = ["created_at", "question", "account"]


def newest_states(log: DataFrame) -> DataFrame:
    """Latest state per investigation; creation facts keep the first write.

    Both picks are one aggregation, so a much-updated investigation is folded map-side.
    """
    rest = [c for c in log.columns if c not in ("investigation_id", "updated_at", *FIRST_WRITE)]
    first = [c for c in FIRST_WRITE if c in log.columns]
    picked = log.groupBy("investigation_id").agg(
        F.max(F.struct("updated_at", *rest)).alias("last"), F.min(F.struct("updated_at", *first)).alias("first")
    )
    return picked.select(
        "investigation_id",
        *[F.col(f"first.{c}").alias(c) for c in first],
        F.col("last.updated_at").alias("updated_at"),
        *[F.col(f"last.{c}").alias(c) for c in rest],
    )


def first_events(log: DataFrame, order: str = "event_id") -> DataFrame:
    """One event per (investigation, sequence): the first written wins, later ones are ignored."""
    rest = [c for c in log.columns if c not in ("investigation_id", "sequence")]
    ordered = [order, *[c for c in rest if c != order]]
    picked = log.groupBy("investigation_id", "sequence").agg(F.min(F.struct(*ordered)).alias("first"))
    return picked.select("investigation_id", "sequence", *[F.col(f"first.{c}").alias(c) for c in rest])


def new_events(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Events of a batch whose key is not stored yet."""
    return first_events(batch).join(stored, ["investigation_id", "sequence"], "left_anti")


def replay(log: DataFrame, investigation_id: str) -> DataFrame:
    return log.filter(F.col("investigation_id") == investigation_id).orderBy("sequence")


def recent(states: DataFrame, limit: int = 50) -> DataFrame:
    return states.orderBy(F.col("created_at").desc(), F.col("investigation_id").desc()).limit(limit)


def pruned(states: DataFrame, events: DataFrame, keep: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest states and their events; everything else is dropped."""
    kept = recent(states, keep).select("investigation_id")
    return (
        states.join(kept, "investigation_id", "left_semi"),
        events.join(kept, "investigation_id", "left_semi"),
    )
