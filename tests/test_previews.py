"""Previews against Python's own HTML parser, function bounds on small programs of each kind of end, and the stages of fitting."""

import json
import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from auditlake.functions import html as H
from auditlake.operators import boundaries as B
from auditlake.operators import fitting as X
from auditlake.operators import previews as P


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links, self.headings, self.level, self.text = [], [], None, ""

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])
        if H.HEADING.fullmatch(tag):
            self.level, self.text = int(tag[1]), ""

    def handle_data(self, data):
        self.text += data if self.level else ""

    def handle_endtag(self, tag):
        if self.level and tag == f"h{self.level}":
            self.headings.append((self.level, " ".join(self.text.split())))
            self.level = None


def test_preview_against_a_plain_parser(spark):
    from oracle import DATA

    for row in spark.read.parquet(f"{DATA}/pages.parquet").limit(40).collect():
        text, plain = row.html.replace('href="/', 'href="../x/'), Plain()
        plain.feed(text)
        found = H.preview(text, "p/r/md")
        assert [a for a, _ in found.links] == plain.links and found.headings == plain.headings
        assert all(b.startswith("/reports/p/r/x/") for _, b in found.links)
        assert H.preview(text, "p/r/md", classes=()).html.replace("/reports/p/r/x/", "../x/") == text


def test_preview_cases():
    at = lambda text: H.preview(text, "proj/run/md")
    assert at('<a href="../pdf/a%20b.pdf">x</a>').html == '<a href="/reports/proj/run/pdf/a%20b.pdf">x</a>'
    assert at("<a class=k href='/PDF/sub/x.pdf'>x</a>").links == [("/PDF/sub/x.pdf", "/reports/proj/run/pdf/x.pdf")]
    for kept in ("#top", "https://h/x", "//h/x", "mailto:a", "/reports/x", "/other/x", "../../../../x", ""):
        assert at(f'<a href="{kept}">x</a>').links == []
    # A header goes with all that it holds, closed or not; what stands around it stays.
    assert at('a<div class="report-header"><p>b<div>c</div></div>d').html == "ad"
    assert at('<section>a<div class="report-header">b<p>c</section>d').html == "<section>a</section>d"
    assert at('<div class="report-header">b').html == ""
    assert at("</p>x<br/>y</b>").html == "</p>x<br/>y</b>"
    assert at("<script>if (a</b>) '<h1>no</h1>'</script><h2>A &amp; <i>B</i></h2>").headings == [(2, "A & B")]
    assert at("<h1>open").headings == [(1, "open")]
    assert at("a < b <!-- <a href='x'> --> <!doctype html> <").html == "a < b <!-- <a href='x'> --> <!doctype html> <"


def test_preview_takes_linear_time():
    for piece in ("<", "<a ", "<!--", '<a href="', "<div>", "</div>", "<h1>"):
        began = time.time()
        H.preview(piece * 100_000, "p/r/md")
        assert time.time() - began < 5


def test_contents(spark):
    rows = [(1, "f", "<h2>a</h2><h1>One!</h1><h2>x</h2><h3>y</h3><h3>X</h3><h2></h2><h4>no</h4><h1>x</h1>"), (2, None, None), (3, "f", "")]
    got = P.contents(P.previews(spark.createDataFrame(rows, "id int, folder string, html string")), "id").orderBy("id", "ord").collect()
    assert [(r.number, r.anchor) for r in got] == [("0.1", "a"), ("1", "one"), ("1.1", "x"), ("1.1.1", "y"), ("1.1.2", "x-2"), ("1.2", "section"), ("2", "x-3")]


def test_contents_resolve_the_asked_references(spark, tmp_path):
    import oracle
    from auditlake import registry

    texts = ["a &amp; b", "cut &amp", "t = &quot;77&quot;", "&amp;quot; &amp;amp;", "&lt;b&gt; &#65; &Amp;", " x  y "]
    rows = [(i, f"<article><p>{t}</p><p>{t}</p></article>") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).toPandas().to_parquet(tmp_path / "pages.parquet")
    assert oracle.differences(spark, "x36_contents", registry.queries(), registry.oracle_sql(), str(tmp_path)) == ""
    df = spark.createDataFrame([(1, "", f"<h1>{texts[2]}</h1>")], "id int, folder string, html string")
    assert P.previews(df).first().headings[0].title == 't = "77"' and P.previews(df, names=()).first().headings[0].title == texts[2]


PROGRAMS = {
    "js": ("// function no() {\nfunction a(x) {\n  if (x) { return '}'; }\n}\nconst b = (y) => {\n  return y;\n};\nfunction c() { return 1; }\nfunction d() {\n  /* } */ let s = \"}\";", [("a", 2, 4), ("b", 5, 7), ("c", 8, 8), ("d", 9, 10)]),
    "java": ("class K {\n  public static int f(int a)\n  {\n    /* {\n    { */\n    return a;\n  }\n  private void g() {}\n}", [("f", 2, 7), ("g", 8, 8)]),
    "py": ("def a(x):\n    y = '#'\n\n    # out\n    def inner(self):\n        pass\n    z\n# end\nasync def b():\n    pass", [("a", 1, 7), ("inner", 5, 6), ("b", 9, 10)]),
    "rb": ("def self.up?\n  1\nend\ndef b\n  2\nend", [("up?", 1, 2), ("b", 4, 5)]),
    "go": ("func (s *S) Run(a int) {\n  x := map[string]int{}\n}\nfunc two() {\n}", [("Run", 1, 3), ("two", 4, 5)]),
    "rs": ("pub fn one() {\n}\nfn two() {\n}", [("one", 1, 4), ("two", 3, 4)]),
    "zz": ("function a\nb", [("a", 1, 2)]),
}


def test_function_bounds_by_language(spark):
    rows = [(i, lang, k + 1, line) for i, (lang, (text, _)) in enumerate(PROGRAMS.items()) for k, line in enumerate(text.split("\n"))]
    rows += [(90, None, 1, None), (91, "js", 1, "")]
    got = B.function_bounds(spark.createDataFrame(rows, "file_id int, lang string, line_no long, line string").repartition(3)).collect()
    want = {(i, *f) for i, (_, found) in enumerate(PROGRAMS.values()) for f in found}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len(B.STARTS) == 27


def plain_fit(core, lists, budget):
    """The stages one after another on Python lists."""
    mark = lambda n: {"_truncated": True, "_omitted_count": n}
    text = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    doc = core | {k: list(v) for k, v in lists if v}
    if len(text(doc)) <= budget:
        return text(doc), "fits_initial"
    keys = sorted((k for k, v in lists if v and len(v) > 1), key=lambda k: -len(doc[k]))
    for k in keys:
        half = len(doc[k]) // 2
        doc[k] = doc[k][:half] + [mark(len(doc[k]) - half)]
        if len(text(doc)) <= budget:
            return text(doc), "halved_lists"
    for k in sorted(keys, key=lambda k: (k in X.EVIDENCE or k.endswith(X.EVIDENCE_ENDS), len(doc[k]), k)):
        if k in X.EVIDENCE or k.endswith(X.EVIDENCE_ENDS):
            doc[k] = doc[k] if len(doc[k]) <= X.PREFIX else doc[k][: X.PREFIX] + [mark(len(doc[k]) - X.PREFIX)]
        else:
            doc[k] = [mark(len(doc[k]))]
        if len(text(doc)) <= budget:
            return text(doc), "dropped_lists"
    if len(text(core)) <= budget:
        return text(core), "core_only"
    return (text(core)[:budget] if budget <= len(X.SUFFIX) else text(core)[: budget - len(X.SUFFIX)] + X.SUFFIX), "hard_cap"


def test_fitting_against_plain_lists(spark):
    rng, rows, want = random.Random(4), [], []
    names = ["entry_points", "citations", "notes", "scan_errors", "paths", "taint_flows"]
    for i in range(400):
        core = {"status": "é" * rng.randint(0, 30), "confidence": rng.randint(0, 99)}
        lists = [(n, None if rng.random() < 0.1 else [{"line": rng.randint(0, 999)} for _ in range(rng.choice([0, 1, 2, 5, 12]))]) for n in rng.sample(names, rng.randint(0, 6))]
        budget = rng.choice([0, 10, 20, 40, 80, 150, 250, 400, 2000])
        rows.append((i, json.dumps(core, ensure_ascii=False, separators=(",", ":")), [(n, None if v is None else [json.dumps(x, separators=(",", ":")) for x in v]) for n, v in lists], budget))
        want.append((i, *plain_fit(core, lists, budget)))
    df = spark.createDataFrame(rows, "id int, core string, lists array<struct<name: string, items: array<string>>>, budget int")
    got = df.select("id", X.fitted(F.col("core"), F.col("lists"), F.col("budget")).alias("x")).select("id", "x.text", "x.stage").orderBy("id").collect()
    assert [tuple(r) for r in got] == want
    assert len({w[2] for w in want}) == 5


def test_fitting_tries_stages_by_lengths(spark):
    """No document is made into a text at each stage: the plan names each list's texts a fixed number of times."""
    df = spark.createDataFrame([(1, "{}", [("notes", ["1", "2"])], 5)], "id int, core string, lists array<struct<name: string, items: array<string>>>, budget int")
    plan = df.select(X.fitted(F.col("core"), F.col("lists"), F.col("budget")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join(") <= 6
    long_ = spark.createDataFrame([(1, '{"k":1}', [(n, [f'"{n}{i}"' for i in range(50_000)]) for n in ("a", "b", "notes")], 200)], df.schema)
    text = long_.select(X.fitted(F.col("core"), F.col("lists"), F.col("budget")).alias("x")).first().x
    assert text.stage == "dropped_lists" and json.loads(text.text)["notes"][3] == {"_truncated": True, "_omitted_count": 24998}
