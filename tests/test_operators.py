"""Edge cases of operators with inline expectations."""

import json
import random
import re

from pyspark.sql import functions as F

import oracle
from auditlake import registry
from auditlake.functions import jsonfix as J
from auditlake.functions import names as N
from auditlake.operators import evidence as E
from auditlake.operators import index as I
from auditlake.operators import models as M
from auditlake.operators import patterns as P
from auditlake.operators import text as T
from auditlake.operators import vectors as V
from auditlake.operators.index import severity_tokens
from auditlake.sources import stores as S
from auditlake.sources.derived import report_index


def column(spark, kind, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_tiers(spark):
    got = column(spark, "double", [0.95, 0.8, 0.79, 0.6, 0.59, 1.5, -0.2, float("nan"), None], V.tier)
    assert got == ["strong", "strong", "moderate", "moderate", "weak", "strong", "weak", "weak", "weak"]


def test_pooling(spark):
    rows = [(1, [2.0, 4.0]), (1, [6.0, 8.0]), (2, [1.0, 1.0]), (2, [1.0]), (3, [float("nan"), 1.0])]
    out = {r["k"]: r["v"] for r in V.pooled(spark.createDataFrame(rows, "k int, v array<double>"), "k").collect()}
    assert out == {1: [4.0, 6.0], 2: None}


def test_upper_median(spark):
    s = spark.createDataFrame([("t", x) for x in (0.1, 0.2, 0.3, 0.4)], "t string, score double")
    assert V.score_statistics(s, ["t"]).first()["median_upper"] == 0.3


def test_whole_orders(spark):
    queries = registry.queries()
    pairs = queries["j1_similarity_join"](spark, oracle.DATA).count()
    found = queries["l1_whole_score_order"](spark, oracle.DATA).collect()
    assert len({r["type_id"] for r in found}) == 8 and len(found) >= pairs
    assert found == sorted(found, key=lambda r: (-r["score"], r["type_id"], r["file_id"]))
    n = report_index(spark, oracle.DATA).count()
    keys = [(r["date"], I.PREFERENCE.index(r["format"]), r["report_key"]) for r in queries["l5_whole_report_order"](spark, oracle.DATA).collect()]
    assert len(keys) == n > 50
    assert keys == sorted(sorted(keys, key=lambda k: k[1:]), key=lambda k: k[0], reverse=True)


def test_whole_lookup_and_walk(spark):
    queries = registry.queries()
    found = {r["file_id"]: r["entry_points"] for r in queries["p8_entry_points_by_file"](spark, oracle.DATA).collect()}
    want = {}
    for r in queries["p7_entry_points"](spark, oracle.DATA).collect():
        want.setdefault(r["file_id"], []).append((r["line_no"], r["kind"]))
    assert found == {k: ",".join(f"{kind}:{n}" for n, kind in sorted(v)) for k, v in want.items()}
    assert any(k != 7 and k % 100 != 3 for k in found)
    least = [(f"a/{i:05}.py", "x") for i in range(S.WALK_FILES + 9)]
    allowed = spark.createDataFrame([("py",), ("env",)], "suffix string")
    walk = lambda rows: [r["path"] for r in S.guarded_walk(spark.createDataFrame(rows, "path string, content string"), allowed).collect()]
    assert walk(least[::-1]) == [p for p, _ in least[: S.WALK_FILES]]
    good = [("a/b.PY", "x" * S.MAX_FILE_BYTES), ("a/dist.py", ""), ("a/x.env", "x")]
    bad = [("a/c.py", "é" * (S.MAX_FILE_BYTES // 2) + "x"), ("a/Dist/b.py", "x"), ("../a.py", "x"), ("/a.py", "x"), ("a/.env", "x"), ("a/b.md", "x")]
    assert walk(bad + good) == [p for p, _ in good]


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [0.0, None] and abs(got[2] - 1) < 1e-12


def test_packing_against_a_plain_loop():
    rng = random.Random(1)
    for _ in range(300):
        lines = ["x" * rng.choice([0, 3, 7, 11, 12, 30]) for _ in range(rng.randint(1, 12))]
        limit, chunks, held = 12, [], []
        for i, line in enumerate(lines, 1):
            if held and sum(len(x) + 1 for _, x in held) + len(line) + 1 > limit:
                chunks.append((held[0][0], held[-1][0]))
                held = []
            if len(line) + 1 > limit:
                chunks += [(i, i)] * -(-len(line) // limit)
            else:
                held.append((i, line))
        if held:
            chunks.append((held[0][0], held[-1][0]))
        assert [(a, b) for a, b, _ in T.pack_lines(lines, limit)] == chunks
    assert [(a, b) for a, b, _ in T.pack_lines(["aaaa"] * 5, 12)] == [(1, 2), (3, 4), (5, 5)]


def test_window_growth_against_a_plain_loop(spark):
    rng = random.Random(2)
    cases, expected = [], []
    for _ in range(60):
        lines = ["y" * rng.randint(0, 9) for _ in range(rng.randint(1, 9))]
        s = rng.randint(1, len(lines))
        e = rng.randint(s, len(lines))
        cap = rng.randint(1, 40)
        lo, hi = max(1, s - 2), min(len(lines), e + 3)
        text = lambda a, b: "\n".join(lines[a - 1 : b])  # noqa: B023, E731
        if len(text(lo, hi)) <= cap:
            want = (text(lo, hi), lo, hi)
        elif len(text(s, e)) > cap:
            cut = text(s, e)[:cap]
            want = (cut, s, s + cut.count("\n"))
        else:
            a, b = s, e
            while (a, b) != (lo, hi):
                c, d = max(lo, a - 1), min(hi, b + 1)
                if len(text(c, d)) > cap:
                    break
                a, b = c, d
            want = (text(a, b), a, b)
        cases.append((len(cases), lines, s, e, cap))
        expected.append(want)
    df = spark.createDataFrame(cases, "i int, lines array<string>, s int, e int, cap int")
    got = [(r[1], r[2], r[3]) for cap in sorted({c[4] for c in cases}) for r in df.filter(F.col("cap") == cap).select("i", T.expanded(F.col("lines"), F.col("s"), F.col("e"), 2, 3, cap).alias("w")).select("i", "w.*").collect() for _ in [0]]
    assert sorted(got) == sorted(expected)


def test_lines(spark):
    assert column(spark, "string", ["a\nb\n", "a", "", "\n"], T.lines_of) == [["a", "b"], ["a"], [], [""]]


def test_paths_and_numbers(spark):
    assert column(spark, "string", ["a/./b/../c", "../x", "/abs", "a/..", "a\\b"], N.normalized_path) == ["a/c", None, None, None, "a/b"]
    assert column(spark, "string", ["12 of 30", "none", "3.5x"], N.first_int) == [12, None, 3]
    assert column(spark, "string", ["-4", "7", "x", None], N.non_negative) == [0, 7, 0, 0]
    assert column(spark, "string", ["  'a b' c", '"q"', "plain x"], N.clean_path) == ["'a", "q", "plain"]
    assert column(spark, "string", ["low, HIGH,low,odd", "", None], severity_tokens)[:2] == [["low", "high"], []]


def test_repair():
    assert json.loads(J.repair('```json\n{"a": [1, 2,],}\n```')) == {"a": [1, 2]}
    assert json.loads(J.repair('so: {"a": "x\ny')) == {"a": "x\ny"}
    assert json.loads(J.repair("nothing"))["validation_error"] is True


def test_thoughts_and_probe(spark):
    got = column(spark, "string", ["<think> a </think>b", "c"], J.thoughts)
    assert [tuple(x) for x in got] == [("a", "b"), ("", "c")]
    words = " ".join(f"w{i * 7919 % 10007}" for i in range(500))
    assert column(spark, "string", ["ab" * 20, "abcdefghijklmn" * 200, words], J.degenerate) == [False, True, False]


def test_scan_keeps_one_hit_a_line_and_kind(spark):
    lines = spark.createDataFrame([(1, 'cursor.execute("x"); cursor.execute("y")'), (2, "eval(x)  "), (3, "plain")], "line_no int, line string")
    assert sorted((r["line_no"], r["kind"]) for r in P.scan(lines, P.CATALOG["sink"]).collect()) == [(1, "sql_execute"), (2, "eval_exec")]


def test_verdict_words(spark):
    assert column(spark, "string", ["suspicious", "ERROR: x", "", None, "fine"], M.verdict) == ["SUSPICIOUS", "ERROR", "ERROR", "ERROR", "CLEAN"]


def test_function_spans():
    text = "def a(x):\n    y\n\n    z\nfunction b() {\n  if (1) {\n  }\n}\nend"
    assert M.function_spans(text) == [("a", 1, 4), ("b", 5, 8)]


def test_source_tree_and_catalog(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes("é".encode())
    (tmp_path / "src" / "b.PY").write_bytes("é".encode("latin-1"))
    (tmp_path / "src" / "c.txt").write_text("no")
    (tmp_path / "src" / "node_modules" / "d.js").write_text("no")
    got = S.source_tree(spark, str(tmp_path / "src")).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["content"]) for r in got) == [("a.py", "é"), ("b.PY", "é")]
    (tmp_path / "cat").mkdir()
    good = {"name": "n", "description": "d", "patterns": ["p"], "impact": "i", "mitigation": "m"}
    (tmp_path / "cat" / "one.json").write_text(json.dumps(good))
    (tmp_path / "cat" / "two.json").write_text(json.dumps(good | {"patterns": []}))
    assert [r["tag"] for r in S.catalog(spark, str(tmp_path / "cat")).collect()] == ["one"]


def test_strings_that_a_match_needs():
    assert P.needed(r"(check|has)_permission\(") == ["_permission("]
    assert P.needed(r"pickle\.loads?\(") == ["pickle.load"]
    assert P.needed(r"(md5|MD5)\(") == ["md5", "MD5"]
    assert P.needed(r"a+b|[xyz]") == [] and P.needed(r"(a|b*)") == []
    samples = {"flask": "@my_app.route('/')", "rails": "  get '/x'", "owner": "owner_id != user", "key": "api-key = 'abcdefghijklmnop'", "rsa": "-----BEGIN RSA PRIVATE KEY"}
    found = {k: [p for kinds in P.CATALOG.values() for ps in kinds.values() for p in ps if re.search(p, s)] for k, s in samples.items()}
    assert all(found.values())
    assert all(not P.needed(p) or any(w in samples[k] for w in P.needed(p)) for k, ps in found.items() for p in ps)


def test_bands_and_taint_reach_their_edges(spark):
    at = lambda n, kind, line: (1, n, kind, line)
    rows = [at(10, "flask", "@app.route("), at(7, "open", "a"), at(6, "open", "b"), at(15, "open", "c"), at(16, "open", "d"), at(76, "open", "run(x)"), at(20, "stdin", "x = input()"), at(137, "open", "run(x)"), at(76, "env", "x = getenv()")]
    h = spark.createDataFrame(rows, "file_id long, line_no long, kind string, line string")
    assert {r["line_no"] for r in E.near_entry(h, ["flask"]).filter("kind = 'open'").collect()} == {7, 15}
    flows = {(r["line_no"], r["source_kind"]) for r in E.taint_flows(h.filter("kind <> 'flask'"), ["stdin", "env"]).collect()}
    assert flows == {(76, "env")}


def test_traces(spark):
    from auditlake.operators import evidence as E

    rows = [(1, 1, '@app.route("/x")'), (1, 2, "def a(request):"), (1, 3, "    b(request)"), (2, 1, "def b(x):"), (2, 2, "    os.system(x)"), (2, 3, "def c(x):"), (2, 4, "    os.system(x)"), (3, 1, "os.system(y)"), (4, 1, None)]
    lines = spark.createDataFrame(rows, "file_id long, line_no long, line string")
    entries = spark.createDataFrame([(1, 1, "flask")], "file_id long, line_no long, kind string")
    sinks = spark.createDataFrame([(1, 3), (2, 2), (2, 2), (2, 4), (3, 1)], "file_id long, line_no long")
    found = {(r.file_id, r.line_no): (r.symbol, r.rank, r.depth, r.entry_file, r.entry_line, r.entry_kind, r.hops) for r in E.traces(lines, entries, sinks).collect()}
    assert found == {(1, 3): ("a", 1, 0, 1, 1, "flask", "1:3"), (2, 2): ("b", 1, 1, 1, 1, "flask", "1:3>2:2"), (2, 4): ("c", 1, 0, None, None, None, "2:4")}
    assert E.traces(lines, entries, sinks.limit(0)).count() == 0
    cut = E.traces(lines, entries.limit(0), sinks).collect()
    assert len(cut) == 3 and all(r.entry_line is None for r in cut)


def test_traces_without_limits(spark):
    from auditlake.operators import evidence as E

    # s holds the sink; 30 entry points call s; the chain c1 > ... > c8 > t of one entry point is longer than five; no entry point reaches u.
    rows = [(0, 1, "def s(x):"), (0, 2, "    os.system(x)")]
    for i in range(1, 31):
        rows += [(i, 1, '@app.route("/x")'), (i, 2, f"def a{i}(request):"), (i, 3, "    s(request)")]
    rows += [(50, 1, '@app.route("/y")'), (50, 2, "def b(request):"), (50, 3, "    c1(request)")]
    rows += [x for k in range(1, 9) for x in ((60 + k, 1, f"def c{k}(x):"), (60 + k, 2, f"    {'t' if k == 8 else f'c{k + 1}'}(x)"))]
    rows += [(70, 1, "def t(x):"), (70, 2, "    os.system(x)"), (71, 1, "def u(x):"), (71, 2, "    os.system(x)"), (71, 3, "    u(x)")]
    lines = spark.createDataFrame(rows, "file_id long, line_no long, line string")
    entries = spark.createDataFrame([(f, n, "flask") for f, n, x in rows if x.startswith("@")], "file_id long, line_no long, kind string")
    sinks = spark.createDataFrame([(0, 2), (0, 2), (70, 2), (71, 2)], "file_id long, line_no long")
    paths = sorted((r.symbol, r.depth, r.hops) for r in E.whole_paths(lines, entries, sinks).collect())
    long = "50:3>" + ">".join(f"{60 + k}:2" for k in range(1, 9))
    assert paths == sorted([("s", 1, f"{i}:3") for i in range(1, 31)] + [("t", 9, long)])
    assert sorted((r.file_id, r.symbol, r.entry_line) for r in E.traced_sinks(lines, entries, sinks).collect()) == [(0, "s", None), (70, "t", None), (71, "u", None)]
    assert sorted(map(tuple, E.led_sinks(lines, entries, sinks).collect())) == [(0, 2), (70, 2)]
    every = E.traces(lines, entries, sinks, None, None, None).collect()
    assert sorted(r.hops for r in every if r.entry_line) == sorted([f"{i}:3>0:2" for i in range(1, 31)] + [long + ">70:2"]) and len(every) == 32
    assert E.whole_paths(lines, entries, sinks.limit(0)).count() == 0 and E.led_sinks(lines, entries.limit(0), sinks).count() == 0


def test_phase_table(spark):
    from auditlake.functions import names as N

    texts = ["### Pipeline phases\n| Phase | Status | Progress |\n|---|---|---|\n| A | ok | 1/2 50% |\n| B | ok | one |\n\n### Next\n| C | ok | 1/2 |", "| A | ok | 1/2 |", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [[tuple(x) for x in r.p] for r in df.select(N.phase_table(F.col("t")).alias("p")).collect()] == [[("A", "ok", 1, 2)], [], [], []]


def test_stream_without_files_and_with_several_batches(spark, tmp_path):
    from auditlake.streaming import monitor as M

    (tmp_path / "in").mkdir()
    stream = lambda: M.progress_stream(M.poll(spark, str(tmp_path / "in"), files_a_batch=1))
    assert M.run_to_end(spark, M.latest_progress(stream()), "complete").count() == 0
    for i in range(3):
        spark.sql(f"SELECT {i}L AS event_id, timestamp_ntz'2024-01-0{i + 1} 00:00:00' AS ts, 7L AS user_id, 's{i % 2}' AS event_type, 0D AS value, '{{}}' AS props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [r.event_id for r in M.run_to_end(spark, M.latest_progress(stream()), "complete").collect()] == [2]
    assert M.run_to_end(spark, M.changed_status(stream()), "append").count() == 3


def test_scan_of_repeated_lines(spark, monkeypatch):
    """Each distinct line meets the patterns once; rows are those of the plain scan, whether its kinds are sent or shuffled."""
    texts = ["x = eval(y)", "x = eval(y)  ", "", None, "cursor.execute(q)", "eval(a); cursor.execute(b)", "plain"]
    lines = spark.createDataFrame([(i % 5, i, texts[i % len(texts)]) for i in range(70)], "file_id int, line_no int, line string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for chars in (P.SENT_CHARS, -1):
        monkeypatch.setattr(P, "SENT_CHARS", chars)
        for keep in (True, False):
            got = P.scan_repeated(lines, P.CATALOG["sink"], keep=keep)
            assert rows(got) == rows(P.scan(lines, P.CATALOG["sink"], keep=keep)) and got.columns == ["file_id", "line_no", "line", "kind"]
    assert P.scan_repeated(lines.limit(0), P.CATALOG["sink"]).count() == 0
    # The patterns read a held table of distinct lines, not the lines.
    held = P.scan_repeated(lines, P.CATALOG["sink"])._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in held or "LogicalRDD [_text" in held
