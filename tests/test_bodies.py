"""Whole report bodies: valid JSON and SARIF, order kept over many part files, hard rows."""

import collections
import json

from auditlake.operators import bodies as D

SCHEMA = "report_id long, file_path string, score double, chunk long, severity string, title string, line long, kind string, last boolean"
ROWS = [
    (1, "a<b>.py", 0.5, 0, "High", 'say "x" & y', 3, "k", None), (1, "a<b>.py", 0.9, 1, "Low", None, None, "k", None), (1, "a<b>.py", 0.9, 1, "Odd", "é\n2", 4, "k", None), (1, "a<b>.py", 0.9, 1, "Else", "z", 4, "k", None),
    (1, "z.py", 0.95, None, None, "t", 1, "k", None), (1, "z.py", 0.95, None, None, "t", 1, "k", None), (1, None, None, 2, "Info", "n", 9, "k", None), (None, "q.py", 0.1, 0, "Critical", "c", 1, "k", None),
]


def bodies(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.line_no):
        out[r.format, r.report_id].append(r.line)
    return out


def test_bodies(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    found = bodies(D.rendered(D.nodes(df)).collect())
    assert len(found) == 8
    doc = json.loads("".join(found["json", 1]))
    assert [f["path"] for f in doc["files"]] == ["z.py", "a<b>.py", "-"] and doc["total"] == 7
    assert [f["title"] for f in doc["files"][1]["findings"]] == ['say "x" & y', "", "z", "é\n2"]
    assert doc["summary"] == {"High": 1, "Low": 1, "Info": 1, "-": 2, "Odd": 1, "Else": 1}
    runs = json.loads("".join(found["sarif", 1]))["runs"][0]
    assert [r["level"] for r in runs["results"]] == ["warning", "warning", "error", "note", "warning", "warning", "warning"]
    assert json.loads("".join(found["sarif", None]))["runs"][0]["results"][0]["ruleId"] == "Critical"
    md = found["md", 1]
    assert md[0] == "# Report 1" and md[-1] == "_7 findings_" and md.index("## z.py (0.95)") < md.index("## a<b>.py (0.9)")
    assert "<li><b>High</b> say &quot;x&quot; &amp; y (line 3)</li>" in found["html", 1]
    assert D.rendered(D.nodes(df.limit(0))).count() == 0


def test_bodies_are_read_back_in_order(spark, tmp_path):
    rows = [(i % 3, f"f{i % 40}.py", i % 7 / 10, i % 4, ["High", "Low", "Info"][i % 3], f"t{i}", i, "k", None) for i in range(6000)]
    lines = D.rendered(D.nodes(spark.createDataFrame(rows, SCHEMA)))
    want = {k: v for k, v in bodies(lines.collect()).items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    D.write_bodies(lines, str(tmp_path / "out"))
    try:
        # Blocks of files, so that a file is read by several tasks.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = bodies(D.read_bodies(spark, str(tmp_path / "out")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_reports_are_written_without_a_shuffle_of_lines(spark, tmp_path):
    nan = float("nan")
    rows = [(i % 3, f"f{i % 40}.py", [0.5, 0.25, 0.5, nan, None, -0.0, 0.75][i % 40 % 7], i % 4, ["High", "Low", "Info", "Odd", None][i % 5], f"t{i % 50}", i % 9, "k", None) for i in range(6000)]
    rows += [(1, "m.py", x, None, "Low", "t", 1, "k", None) for x in (0.1, None, 0.9, 0.1)] + [(2, f"n{i}.py", None, 1, None, None, None, "k", None) for i in range(3)] + ROWS[:4] + ROWS[6:]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # Titles with line breaks are lines of their own when they are read back.
    want = {k: "\n".join(v).split("\n") for k, v in bodies(D.rendered(D.nodes(df)).collect()).items()}
    # Partitions that are not merged: whatever is dealt out after the ranges would lose their order.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        D.write_reports(df, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = D.read_bodies(spark, str(tmp_path / "out"))
    assert bodies(back.collect()) == want
    size = sum(p.stat().st_size for p in (tmp_path / "out").rglob("part-*"))
    assert size * 5 < sum(len(x) + 1 for v in want.values() for x in v)
    # Blocks are counted and dealt out, lines are not: each is read once more and stays in its task.
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.split("MapInArrow")[0].count("Exchange") == 0
    D.write_reports(df.limit(0), str(tmp_path / "none"))


def test_scores_round_as_in_the_twin(spark, tmp_path):
    import duckdb

    from auditlake.sources.derived import FINDINGS, findings

    # Halves in the sixth place; with other scores beside them they would change the order of files.
    prices = [152739.9, 303204.3, 312685.5, 152739.6, 600.0, 0.0, 599999.7]
    orders = [(i, 50, p, "O") for i, p in enumerate(prices)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(i, 1, 1, 1, 10.0) for i in range(len(prices))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"WITH {FINDINGS} SELECT file_path, score FROM findings").fetchall()
    assert sorted(map(tuple, findings(spark, str(tmp_path)).select("file_path", "score").collect())) == sorted(want)
