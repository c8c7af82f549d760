"""Report trees: pruning by options and by filters, hard files, rewritten files, inputs by file, folder and list."""

import json

import pytest

from auditlake.sources import trees as T

FILES = [
    ("old_20250101_000000/m/json/sql_injection.json", '{"stats": {"critical": "2", "high": null, "low": 3.9, "other": 1}, "project": "p", "language": "en"}'),
    ("old_20250101_000000/m/md/sql_injection.md", "# é"),
    ("20250102_000000/m/json/executive_summary.json", '{"stats": {}, "progress": {"completed": 2, "total": 5}}'),
    ("20250102_000000/m/json/executive_summary.progress.json", "{}"),
    ("20250102_000000/m/json/cut.json", '{"stats": {'),
    ("20250102_000000/m/json/list.json", "[1]"),
    ("20250102_000000/m/json/empty.json", None),
    ("20250102_000000/m/json/huge.json", '{"stats": {"critical": 1e400, "high": 99999999999999999999}, "project": 7}'),
    ("20250102_000000/m/exe/a.exe", "x"),
    ("20250102_000000/m/md/notes.txt", "x"),
    ("team/20251399_000000/n/pdf/a_b_12.pdf", "x"),
    ("team/other/n/pdf/a.pdf", "x"),
    ("loose.json", "{}"),
]


@pytest.fixture
def tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    df = spark.createDataFrame(FILES, "path string, content string").selectExpr("*", "'x' AS size", "path AS format")
    T.write_tree(df, root)
    return root


def test_index(spark, tree):
    found = {r.path: r for r in T.report_artifacts(spark, tree).collect()}
    assert sorted(found) == sorted(p for p, _ in FILES if not any(x in p for x in ("progress", ".exe", ".txt", "other/", "loose")))
    r = found["old_20250101_000000/m/json/sql_injection.json"]
    assert (r.folder, r.project, r.language, r.critical, r.high, r.medium, r.low, r.completed, r.alternatives, r.date) == ("old", "p", "en", 2, 0, 0, 3, None, "json,md", "2025-01-01 00:00:00")
    m = found["old_20250101_000000/m/md/sql_injection.md"]
    assert (m.project, m.language, m.critical, m.size) == ("p", "en", None, 4)
    s = found["20250102_000000/m/json/executive_summary.json"]
    assert (s.folder, s.project, s.critical, s.completed, s.total) == (None, None, 0, 2, 5)
    for bad in ("cut", "list", "empty"):
        assert found[f"20250102_000000/m/json/{bad}.json"].critical is None
    h = found["20250102_000000/m/json/huge.json"]
    assert (h.critical, h.high, h.project) == (0, 0, None)
    a = found["team/20251399_000000/n/pdf/a_b_12.pdf"]
    assert (a.folder, a.project, a.date, a.vulnerability_type) == ("team", "team", "", "A B")
    order = [(r.run_key, r.position, r.path.rpartition("/")[2]) for r in T.json_reports(T.report_artifacts(spark, tree)).orderBy("run_key", "position").collect()]
    assert order[:3] == [("20250102_000000", 1, "cut.json"), ("20250102_000000", 2, "empty.json"), ("20250102_000000", 3, "executive_summary.json")]


def test_pruning(spark, tree):
    every = T.report_artifacts(spark, tree, 1)
    assert every.rdd.getNumPartitions() == 3
    some = T.report_artifacts(spark, tree, 1, folder=["team", "old"], format=["md", "pdf"])
    assert some.rdd.getNumPartitions() == 2 and some.count() == 2
    assert T.report_artifacts(spark, tree, run_key=[]).count() == 0
    with pytest.raises(ValueError, match="stem"):
        T.report_artifacts(spark, tree, stem=["x"])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        every = T.report_artifacts(spark, tree, 1)
        cases = [("folder = 'team'", 1), ("folder IN ('team', 'old', NULL)", 2), ("folder IS NULL", 3), ("folder IS NOT NULL", 3), ("model = 'm' AND format = 'json'", 3), ("run_key = '20250102_000000' AND critical >= 0", 1), ("folder <=> 'team'", 3), ("model = 'm' AND model = 'n'", 0), ("run_key = 'x' OR model = 'n'", 3)]
        frame = spark.createDataFrame(every.collect(), every.schema)
        for condition, tasks in cases:
            got = every.filter(condition)
            assert sorted(r.path for r in got.collect()) == sorted(r.path for r in frame.filter(condition).collect()), condition
            assert got.rdd.getNumPartitions() == tasks, condition
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_rewritten_files_and_errors(spark, tree, tmp_path):
    T.write_tree(spark.createDataFrame(FILES[:1] * 3, "path string, content string").repartition(3), tree)
    assert T.report_artifacts(spark, tree).count() == len([r for r in FILES if not any(x in r[0] for x in ("progress", ".exe", ".txt", "other/", "loose"))])
    assert not (tmp_path / "tree.parts").exists()
    for bad in ("../x", "/x", "a/../../x", "", None):
        with pytest.raises(Exception, match="not a path within the tree"):
            T.write_tree(spark.createDataFrame([(bad, "x")], "path string, content string"), tree)
    empty = str(tmp_path / "none")
    T.write_tree(spark.createDataFrame([], "path string, content string"), empty)
    assert T.report_artifacts(spark, empty).count() == 0


def test_inputs(spark, tree, tmp_path):
    one = f"{tree}/loose.json"
    found = lambda p: sorted(r.path for r in T.input_files(spark, p).collect())
    assert found(one) == [one]
    assert found(tree) == sorted(f"{tree}/{p}" for p, _ in FILES)
    assert found(f"file://{tree}/team") == [f"file://{tree}/{p}" for p, _ in FILES if p.startswith("team")]
    assert found(f"{tree}/gone") == [] and found(f"{tree}/gone.txt") == []
    listed = tmp_path / "in.txt"
    listed.write_text(f"\n  {one}  \n{tree}/gone\n{tree}/team\n{one}\n")
    assert found(str(listed)) == sorted([one, one, *(f"{tree}/{p}" for p, _ in FILES if p.startswith("team"))])
    (tmp_path / "nothing").mkdir()
    assert found(str(tmp_path / "nothing")) == []
    assert json.loads(next(c for p, c in FILES if p == "loose.json")) == {}
