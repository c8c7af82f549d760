"""Findings walked through a graph of investigation stages under a budget: stages that start in time give evidence, later ones none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a finding of a family goes after a stage. Fixed values.
TRANSITIONS = [
    ("flow", "classify", "entry_points"), ("flow", "entry_points", "trace"), ("flow", "trace", "taint"), ("flow", "taint", "mitigations"), ("flow", "mitigations", "verdict"),
    ("access", "classify", "entry_points"), ("access", "entry_points", "authz"), ("access", "authz", "verdict"),
    ("config", "classify", "config_audit"), ("config", "config_audit", "verdict"),
]
START, END = "classify", "verdict"
#: What evidence each stage gives.
GIVES = {"entry_points": ("entries",), "trace": ("reaches",), "taint": ("taint",), "mitigations": ("nullified", "soft"), "authz": ("authz", "checks", "missing"), "config_audit": ("found", "top_rank")}


def longest(transitions: list[tuple[str, str, str]]) -> int:
    """Moves of the longest walk from START. A table with a cycle, or with two ways out of a stage, is refused."""
    steps = {(family, at): to for family, at, to in transitions}
    if len(steps) < len(transitions):
        raise ValueError("a stage of a family has two ways out")
    most = 0
    for family in {f for f, _, _ in transitions}:
        at, n = START, 0
        while (family, at) in steps:
            at, n = steps[family, at], n + 1
            if n > len(steps):
                raise ValueError(f"the stages of {family} form a cycle")
        most = max(most, n)
    return most


def walked(findings: DataFrame, seconds: float = 1.0, transitions: list[tuple[str, str, str]] = TRANSITIONS) -> DataFrame:
    """findings: family, budget (seconds), work (map of stage to items). Adds `route` (stages in order, '!' after those that
    came too late), `ran` (those that gave evidence), `spent` and `exhausted`. A stage takes `seconds` and as much for each item; it
    starts while less than the budget is spent, and then ends. The verdict is always reached and takes nothing. A finding of no known
    family (null too) goes nowhere; a null budget is none. As many narrow joins as the longest walk has moves, no shuffle: the table is
    small, whatever the findings are."""
    moves = F.broadcast(findings.sparkSession.createDataFrame(transitions, "_family string, _from string, _to string"))
    rows = findings.withColumns({"_at": F.lit(START), "spent": F.lit(0.0), "_route": F.array(F.lit(START)), "ran": F.array().cast("array<string>"), "exhausted": F.lit(False)})
    for _ in range(longest(transitions)):
        rows = rows.join(moves, (F.col("family") == F.col("_family")) & (F.col("_at") == F.col("_from")), "left")
        moved, ends = F.col("_to").isNotNull(), F.col("_to") == END
        on_time = moved & ~ends & (F.col("spent") < F.coalesce("budget", F.lit(0.0)))
        late = moved & ~ends & ~on_time
        cost = F.lit(seconds) * (1 + F.coalesce(F.try_element_at("work", F.col("_to")), F.lit(0)))
        rows = rows.withColumns({
            "_route": F.when(moved, F.array_append("_route", F.when(late, F.concat("_to", F.lit("!"))).otherwise(F.col("_to")))).otherwise(F.col("_route")),
            "ran": F.when(on_time, F.array_append("ran", F.col("_to"))).otherwise(F.col("ran")),
            "spent": F.when(on_time, F.col("spent") + cost).otherwise(F.col("spent")),
            "exhausted": F.col("exhausted") | F.coalesce(late, F.lit(False)),
            "_at": F.coalesce("_to", "_at"),
        }).drop("_family", "_from", "_to")
    return rows.withColumn("route", F.array_join("_route", ">")).drop("_at", "_route")


def seen_evidence(rows: DataFrame) -> DataFrame:
    """Evidence of stages that did not run is as if nothing had been found."""
    for stage, columns in GIVES.items():
        for c in columns:
            nothing = F.lit(False) if dict(rows.dtypes)[c] == "boolean" else F.lit(0)
            rows = rows.withColumn(c, F.when(F.array_contains("ran", stage), F.coalesce(c, nothing)).otherwise(nothing))
    return rows
