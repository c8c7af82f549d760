"""Where functions begin and end, over lines as rows.

A file is never one row: strings and comments are masked line by line, the state "within a block comment" is the last
mark before a line, brace depth is a running sum, and the end of a function is the next line of its file that closes its
level. Each line gives a row for every level that it closes (as many as it has closing braces, or as its indentation is
less than that of the line before), so the search is a window over (file, level) and not a join of ranges.

Lines: key, path suffix `lang`, line_no from 1, line. A null line is empty; an unknown or null language has the default
start; functions that begin on one line count once; a function that nothing closes ends with its file; a declaration
without a body runs to the end of the next block of its level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How a function ends: at the brace that closes it, at the next line indented no deeper, or with the file. Fixed values.
BRACES = ("c", "cpp", "cs", "go", "java", "js", "php", "ts")
INDENTED = ("py", "rb")
NAME = "([A-Za-z_][A-Za-z0-9_]*)"
#: Starts by suffix; the first group is the name. The keywords are the languages' own.
STARTS = {
    "bash": rf"^\s*(?:function\s+)?{NAME}\s*\(\s*\)",
    "c": rf"^\s*(?:[A-Za-z_][A-Za-z0-9_]*[\s*]+)+{NAME}\s*\([^;]*$",
    "cpp": rf"^\s*(?:[A-Za-z_][A-Za-z0-9_:<>]*[\s*&]+)+(?:[A-Za-z_][A-Za-z0-9_]*::)?{NAME}\s*\([^;]*$",
    "cs": rf"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[A-Za-z_][A-Za-z0-9_<>,]*\s+{NAME}\s*\(",
    "dart": rf"^\s*(?:void|[A-Za-z_][A-Za-z0-9_<>]*)\s+{NAME}\s*\([^;]*$",
    "ex": r"^\s*defp?\s+([A-Za-z_][A-Za-z0-9_?!]*)",
    "fs": rf"^\s*let\s+(?:rec\s+)?{NAME}",
    "go": rf"^\s*func\s+(?:\([^)]*\)\s*)?{NAME}\s*\(",
    "groovy": rf"^\s*(?:def|void)\s+{NAME}\s*\(",
    "hs": r"^([a-z_][A-Za-z0-9_']*)\s*::",
    "java": rf"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[A-Za-z_][A-Za-z0-9_<>,\[\]]*\s+{NAME}\s*\(",
    "js": rf"(?:^|[^A-Za-z0-9_])(?:async\s+)?(?:function\s+)?{NAME}\s*(?:\([^()]*\)\s*[{{]|[=:]\s*(?:async\s*)?(?:function\s*\(|\([^()]*\)\s*=>))",
    "kt": r"^\s*(?:[a-z]+\s+)*fun\s+(?:[A-Z][A-Za-z0-9_]*\.)?([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    "lua": r"^\s*(?:local\s+)?function\s+([A-Za-z_][A-Za-z0-9_.]*)\s*\(",
    "m": r"^\s*[-+]\s*\([^)]*\)\s*([A-Za-z_][A-Za-z0-9_:]*)",
    "matlab": rf"^\s*function\s+(?:[^=]*=\s*)?{NAME}",
    "php": rf"^\s*(?:(?:public|private|protected|static)\s+)*function\s+{NAME}\s*\(",
    "pl": rf"^\s*sub\s+{NAME}",
    "ps1": r"^\s*(?:function|filter)\s+([A-Za-z_][A-Za-z0-9_-]*)",
    "py": rf"^\s*(?:async\s+)?def\s+{NAME}\s*\(",
    "r": r"^\s*([A-Za-z_.][A-Za-z0-9_.]*)\s*<-\s*function\s*\(",
    "rb": r"^\s*def\s+(?:self\.)?([A-Za-z_][A-Za-z0-9_?!]*)",
    "rs": rf"^\s*(?:pub\s+)?(?:async\s+)?fn\s+{NAME}",
    "scala": rf"^\s*(?:override\s+)?(?:def|object)\s+{NAME}",
    "sh": rf"^\s*(?:function\s+)?{NAME}\s*\(\s*\)",
    "swift": rf"^\s*(?:(?:public|private|static|class)\s+)*func\s+{NAME}\s*[(<]",
    "ts": rf"(?:^|[^A-Za-z0-9_])(?:async\s+)?(?:function\s+)?{NAME}\s*(?:\([^()]*\)\s*(?::\s*[A-Za-z0-9_<>]+\s*)?[{{]|[=:]\s*(?:async\s*)?(?:function\s*\(|\([^()]*\)\s*=>))",
}
DEFAULT_START = rf"(?:function|def)\s+{NAME}"
#: Names that stand before a parenthesis and are no function's.
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "else", "function", "new", "sizeof", "throw")
STRING = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"""
#: Comments to the end of a line, by suffix; others have none.
HASH, SLASHES, DASHES, PERCENT = ("bash", "ex", "pl", "ps1", "py", "r", "rb", "sh"), (*BRACES, "dart", "fs", "groovy", "kt", "m", "rs", "scala", "swift"), ("hs", "lua"), ("matlab",)
COMMENTS = {"#.*$": HASH, "//.*$": SLASHES, "--.*$": DASHES, "%.*$": PERCENT}
BLOCK_COMMENTS = SLASHES


def _by_language(lang: Column, pick: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in pick.items():
        out = F.when(lang == name, value).otherwise(out)
    return out


def masked(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """The lines with `code`: what is left without strings (two quotes stand for one) and comments."""
    lang = F.lower(F.coalesce("lang", F.lit("")))
    code = F.regexp_replace(F.coalesce("line", F.lit("")), STRING, '""')
    for pattern, of in COMMENTS.items():
        # A comment that hides the opening of a block comment does so in languages with both.
        code = F.when(lang.isin(*of), F.regexp_replace(code, pattern if pattern != "//.*$" else r"/\*.*?\*/|//.*$", "")).otherwise(code)
    rows = lines.withColumn("_lang", lang).withColumn("_code", code)
    block = F.col("_lang").isin(*BLOCK_COMMENTS)
    mark = F.when(block & F.contains("_code", F.lit("/*")), F.lit(True)).when(block & F.contains("_code", F.lit("*/")), F.lit(False))
    before = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)))
    own = F.when(F.col("_within"), F.regexp_extract("_code", r"\*/(.*)$", 1)).otherwise(F.col("_code"))
    return rows.withColumn("code", F.when(block, F.substring_index(own, "/*", 1)).otherwise(own)).withColumn("lang", F.col("_lang")).drop("_lang", "_code", "_within")


def _balance(code: Column) -> Column:
    """(least, last): the least depth within a line and the depth after it, from 0 before it."""
    braces = F.split(F.regexp_replace(code, "[^{}]", ""), "")
    step = lambda s, b: s.last + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)
    return F.aggregate(braces, F.struct(F.lit(0).alias("least"), F.lit(0).alias("last")), lambda s, b: F.struct(F.least(s.least, step(s, b)).alias("least"), step(s, b).alias("last")))


def levels(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Masked lines with `level` (that a function which starts here has), `closed` (levels that the line closes), `closes_at`
    (the last line of what it closes) and `whole` (a block opens here and is closed on the line)."""
    order = W.partitionBy(key).orderBy("line_no")
    indented = F.col("lang").isin(*INDENTED)
    says = F.trim("code") != ""
    indent = F.when(indented & says, F.length(F.regexp_extract("line", r"^\s*", 0)))
    rows = lines.withColumns({"_b": _balance(F.col("code")), "_indent": indent})
    past = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_depth": F.coalesce(F.sum("_b.last").over(past), F.lit(0)), "_was": F.last("_indent", ignorenulls=True).over(past), "_said": F.last(F.when(says, F.col("line_no")), ignorenulls=True).over(past)})
    low = F.col("_depth") + F.col("_b.least")
    from_, to = F.when(indented, F.col("_indent").cast("long")).otherwise(low), F.when(indented, F.col("_was").cast("long")).otherwise(F.col("_depth") - 1)
    closed = F.when(F.coalesce(from_ <= to, F.lit(False)), F.sequence(from_, to))
    whole = ~indented & F.contains("code", F.lit("{")) & (F.col("_b.last") == F.col("_b.least"))
    return rows.select(key, "lang", "line_no", "code", from_.alias("level"), closed.alias("closed"), F.when(indented, F.col("_said")).otherwise(F.col("line_no")).alias("closes_at"), whole.alias("whole"))


def function_bounds(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, name, start_line, end_line) of every function. lines: key, lang, line_no, line."""
    rows = levels(masked(lines, key), key)
    start = _by_language(F.col("lang"), {lang: F.regexp_extract("code", p, 1) for lang, p in STARTS.items()}, F.regexp_extract("code", DEFAULT_START, 1))
    rows = rows.withColumn("name", start).withColumn("name", F.when((F.col("name") != "") & ~F.col("name").isin(*KEYWORDS), F.col("name")))
    ruled = F.col("lang").isin(*BRACES, *INDENTED)
    begins = rows.filter(F.col("name").isNotNull()).select(key, "level", "line_no", "name", F.when(ruled & F.col("whole"), F.col("line_no")).alias("own"), ruled.alias("ruled"), F.lit(None).cast("long").alias("closes_at"))
    ends = rows.filter(ruled & F.col("closed").isNotNull()).select(key, F.explode("closed").alias("level"), "line_no", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("own"), F.lit(True).alias("ruled"), "closes_at")
    # The next line of this level that closes it.
    later = W.partitionBy(key, "level").orderBy("line_no").rangeBetween(1, W.unboundedFollowing)
    nexts = begins.union(ends).withColumn("next", F.first("closes_at", ignorenulls=True).over(later)).filter("name is not null")
    last = lines.groupBy(key).agg(F.max("line_no").alias("last"))
    end = F.coalesce("own", F.when(F.col("ruled"), F.col("next")), F.col("last"))
    return nexts.join(last, key).select(key, "name", F.col("line_no").alias("start_line"), end.alias("end_line"))


# --- the same in SQL -----------------------------------------------------------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _listed(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_quoted, names)) + ")"


def bounds_sql(source: str, key: str = "file_id") -> str:
    """The twin of `function_bounds`: ends by looking, for each start, at all later lines."""
    code = f"regexp_replace(coalesce(line, ''), {_quoted(STRING)}, '\"\"', 'g')"
    for p, of in COMMENTS.items():
        pattern = p if p != "//.*$" else r"/\*.*?\*/|//.*$"
        code = f"CASE WHEN lang IN {_listed(of)} THEN regexp_replace({code}, {_quoted(pattern)}, '', 'g') ELSE {code} END"
    start = "CASE lang " + " ".join(f"WHEN '{lang}' THEN regexp_extract(code, {_quoted(p)}, 1)" for lang, p in STARTS.items()) + f" ELSE regexp_extract(code, {_quoted(DEFAULT_START)}, 1) END"
    return f"""m0 AS (SELECT {key}, lang, line_no, line, {code} AS c0, lang IN {_listed(BLOCK_COMMENTS)} AS block FROM {source}),
m1 AS (SELECT *, CASE WHEN block AND contains(c0, '/*') THEN 1 WHEN block AND contains(c0, '*/') THEN 0 END AS mark FROM m0),
m2 AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM m1),
m3 AS (SELECT *, CASE WHEN inside = 1 THEN regexp_extract(c0, '\\*/(.*)$', 1) ELSE c0 END AS c1 FROM m2),
m AS (SELECT {key}, lang, line_no, line, CASE WHEN block THEN split_part(c1, '/*', 1) ELSE c1 END AS code FROM m3),
b0 AS (SELECT *, regexp_replace(code, '[^{{}}]', '', 'g') AS br, lang IN {_listed(INDENTED)} AS indented, lang IN {_listed((*BRACES, *INDENTED))} AS ruled FROM m),
b1 AS (SELECT *, length(replace(br, '}}', '')) - length(replace(br, '{{', '')) AS net, list_min(list_transform(range(0, length(br) + 1), lambda i: length(replace(left(br, i), '}}', '')) - length(replace(left(br, i), '{{', '')))) AS least FROM b0),
b AS (SELECT *, coalesce(sum(net) OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth, CASE WHEN indented AND trim(code) <> '' THEN length(regexp_extract(line, '^\\s*', 0)) END AS ind, {start} AS nm FROM b1),
s AS (SELECT * FROM b WHERE nm <> '' AND nm NOT IN {_listed(KEYWORDS)})
SELECT {key}, nm AS name, line_no AS start_line, CAST(coalesce(
  CASE WHEN ruled AND NOT indented AND contains(code, '{{') AND net = least THEN line_no END,
  CASE WHEN ruled AND NOT indented THEN (SELECT min(x.line_no) FROM b x WHERE x.{key} = s.{key} AND x.line_no > s.line_no AND x.depth > s.depth + s.least AND x.depth + x.least <= s.depth + s.least) END,
  CASE WHEN indented THEN (SELECT max(y.line_no) FROM b y WHERE y.{key} = s.{key} AND y.line_no >= s.line_no AND trim(y.code) <> '' AND y.line_no < (SELECT min(x.line_no) FROM b x WHERE x.{key} = s.{key} AND x.line_no > s.line_no AND x.ind <= s.ind)) END,
  (SELECT max(x.line_no) FROM b x WHERE x.{key} = s.{key})) AS BIGINT) AS end_line FROM s"""
