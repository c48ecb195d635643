"""Set reconciliation, current versions and audits of state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either side with MISSING, ORPHAN, MISMATCH or OK, by a full outer join."""
    e = expected.select(key, F.col(value).alias("expected"), F.lit(True).alias("e"))
    f = found.select(key, F.col(value).alias("found"), F.lit(True).alias("f"))
    status = F.when(F.col("f").isNull(), "MISSING").when(F.col("e").isNull(), "ORPHAN").when(~F.col("expected").eqNullSafe(F.col("found")), "MISMATCH").otherwise("OK")
    return e.join(f, key, "full_outer").select(key, status.alias("status"))


def current_version(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Rows numbered by version within their key, the last one current, each with the version before it."""
    w = Window.partitionBy(*keys).orderBy(*version)
    number = F.row_number().over(w)
    return df.withColumns({"version": number.cast("long"), "is_current": F.lead(F.lit(True)).over(w).isNull(), "replaces": F.lag(version[-1]).over(w)})


def audit_transitions(df: DataFrame, keys: list[str], order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps from a state to the next whose pair is not allowed, and gaps in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"from_state": F.lag(state).over(w), "step": F.col(order[-1]) - F.lag(order[-1]).over(w)})
    pair = F.concat_ws(">", "from_state", state)
    return rows.where(F.col("from_state").isNotNull() & (~pair.isin([f"{a}>{b}" for a, b in allowed]) | (F.col("step") != 1)))
