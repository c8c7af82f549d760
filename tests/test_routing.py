"""Routes of findings: order of stages, budgets, hard rows, tables that are refused, and verdicts of cut walks against a plain walk."""

import itertools

import pytest
from pyspark.sql import functions as F

from auditlake.operators import routing as G

SCHEMA = "id long, family string, budget double, work map<string,long>, step string, path string"


def plain(family, budget, work):
    steps = {(f, a): b for f, a, b in G.TRANSITIONS}
    at, spent, route, ran, late = G.START, 0.0, [G.START], [], False
    while (family, at) in steps:
        at = steps[family, at]
        if at == G.END or spent < (budget or 0):
            route.append(at)
            if at != G.END:
                ran.append(at)
                spent += 1 + (work or {}).get(at, 0)
        else:
            route.append(at + "!")
            late = True
    return ">".join(route), spent, ran, late


def test_walks_against_a_plain_walk(spark):
    families = ["flow", "access", "config", "other", None]
    works = [{}, {"entry_points": 3}, {"trace": 5, "authz": 2}, {"entry_points": 1, "trace": 1, "taint": 1, "config_audit": 40}, None]
    rows = [(i, f, b, w, "x", "y") for i, (f, b, w) in enumerate(itertools.product(families, [None, -1.0, 0.0, 1.0, 2.0, 4.5, 100.0, float("inf")], works))]
    got = G.walked(spark.createDataFrame(rows + rows[:7], SCHEMA)).collect()
    assert len(got) == len(rows) + 7
    for r in got:
        assert (r.route, r.spent, r.ran, r.exhausted) == plain(r.family, r.budget, r.work), r
        assert (r.step, r.path) == ("x", "y")
    assert G.walked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_shuffle(spark):
    plan = G.walked(spark.createDataFrame([(1, "flow", 1.0, {}, "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_refused_tables():
    with pytest.raises(ValueError, match="cycle"):
        G.longest([("a", "classify", "b"), ("a", "b", "classify")])
    with pytest.raises(ValueError, match="two ways"):
        G.longest([("a", "classify", "b"), ("a", "classify", "c")])
    assert G.longest(G.TRANSITIONS) == 5 and G.longest([]) == 0


def test_stages_that_did_not_run_give_nothing(spark):
    flags = {"entries": True, "reaches": True, "taint": True, "nullified": True, "soft": None, "authz": True, "checks": 3, "missing": 2, "found": 1, "top_rank": 4}
    row = spark.range(1).select(F.array(F.lit("trace"), F.lit("mitigations"), F.lit("authz")).alias("ran"), *(F.lit(v).cast("boolean" if v is None else type(v) is bool and "boolean" or "int").alias(k) for k, v in flags.items()))
    r = G.seen_evidence(row).first().asDict()
    assert (r["reaches"], r["nullified"], r["soft"], r["checks"], r["missing"]) == (True, True, False, 3, 2)
    assert (r["entries"], r["taint"], r["found"], r["top_rank"]) == (False, False, 0, 0)
