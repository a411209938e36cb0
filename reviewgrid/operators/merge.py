"""Merge reviewer findings: order of the union (M1), dedup (M2), prioritise (M3); M4 is all three.

Dedup is an aggregation, not a window: the survivor of each key is
``min_by(row, (rank, seq))`` and the key's position is ``min(seq)``, both
combined map-side, so a key holding a third of all findings is reduced
inside every map task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AGENTS
from ..functions.severity import severity_rank
from .ordering import position_within

DEDUP_KEY = ["file_path", "line_number", "category"]
SCOPE = ["repo", "pr_number"]


def dedup(findings: DataFrame, scope: list[str] = SCOPE, order_col: str = "seq") -> DataFrame:
    """M2: best severity per (scope, file_path, line_number, category), first on ties.

    Adds ``rank`` and ``first_seq`` (the order of the key's first record).
    Null key parts group together, as missing keys do in a dict.
    """
    keys = scope + DEDUP_KEY
    ranked = findings.withColumn("rank", severity_rank("severity"))
    payload = [c for c in ranked.columns if c not in keys]
    agg = ranked.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct("rank", order_col)).alias("_survivor"),
        F.min(order_col).alias("first_seq"))
    return agg.select(*keys, "_survivor.*", "first_seq")


def prioritise(survivors: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """M3: ``position`` inside the PR by (severity rank, first seq of the key)."""
    return position_within(survivors, scope, [F.col("rank"), F.col("first_seq")], name="position")


def order_findings(findings: DataFrame, item_cols: list[str], agent_col: str = "agent") -> DataFrame:
    """M1 for one findings table that already carries the reviewer name.

    Equivalent to concatenating the reviewer lists in reviewer order, but a
    single pass: ``agent_ord`` comes from the fixed reviewer order and ``seq``
    = struct(agent_ord, *item_cols).
    """
    agents = F.array(*[F.lit(a) for a in AGENTS])
    out = findings.withColumn("agent_ord", (F.array_position(agents, F.col(agent_col)) - 1).cast("int"))
    return out.withColumn("seq", F.struct("agent_ord", *item_cols))
