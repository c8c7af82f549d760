"""Evidence joins and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.session import cut_lineage

#: Definition lines: the name is the first group.
DEFINITION = r"^\s*(?:def|function|func|fn|sub)\s+([A-Za-z0-9_]+)\s*\("
CALL = r"([A-Za-z0-9_]+)\("
#: Lines before and after an entry point that still belong to it.
BEFORE, AFTER = 3, 5
TAINT_RADIUS = 60
MAX_DEPTH, MAX_FANOUT, MAX_CALLERS = 5, 6, 20
#: Left and right side of an assignment.
ASSIGNMENT = r"^\s*(?:let |var |const |final )?([$@]?[A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*([^=].*)$"


def enclosing(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """`lines` with the nearest definition at or above each line: symbol and symbol_line."""
    name = F.nullif(F.regexp_extract("line", DEFINITION, 1), F.lit(""))
    above = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    own = F.when(name.isNotNull(), F.struct(name.alias("symbol"), F.col("line_no").alias("symbol_line")))
    return lines.withColumn("_d", F.last(own, ignorenulls=True).over(above)).withColumn("symbol", F.col("_d.symbol")).withColumn("symbol_line", F.col("_d.symbol_line")).drop("_d")


def around(below: int, above: int) -> W:
    """The rows of a file from `below` lines before a line to `above` lines after it. A frame over the file's
    own order keeps the partitions of the line numbers: no join, no further shuffle."""
    return W.partitionBy("file_id").orderBy("line_no").rangeBetween(-below, above)


def entry_near(entry_kinds: list[str]) -> Column:
    """Of hits of all kinds: the first entry point in whose band a line stands, or null."""
    entry = F.when(F.col("kind").isin(entry_kinds), F.struct(F.col("line_no").alias("entry_line"), F.col("kind").alias("entry_kind")))
    return F.min(entry).over(around(AFTER, BEFORE))


def near_entry(hits: DataFrame, entry_kinds: list[str]) -> DataFrame:
    """hits: file_id, line_no, kind, of entry points and others. The others within the band of an entry point
    of their file, with the first such entry point."""
    near = hits.withColumn("e", entry_near(entry_kinds)).filter(~F.col("kind").isin(entry_kinds) & F.col("e").isNotNull())
    return near.select("file_id", "line_no", "kind", "e.entry_line", "e.entry_kind")


def call_edges(lines: DataFrame) -> DataFrame:
    """callee, caller, file_id, line_no: the first MAX_CALLERS places that call each name."""
    placed = enclosing(lines)
    calls = placed.filter(~F.col("line").rlike(DEFINITION)).select("file_id", "line_no", F.col("symbol").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)))).alias("callee"))
    first = W.partitionBy("callee").orderBy("file_id", "line_no")
    return calls.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= MAX_CALLERS).drop("_n")


def callers(edges: DataFrame, symbols: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Breadth first from `symbols` (symbol): every caller with its least depth and, of the shortest chains
    to it, the first by name. A round reads only the newest symbols; those seen are left out."""
    edges = cut_lineage(edges.filter(F.col("caller").isNotNull() & (F.col("caller") != F.col("callee"))).select("callee", "caller").distinct())
    front = symbols.select("symbol", F.lit(0).alias("depth"), F.col("symbol").alias("chain")).distinct()
    seen = cut_lineage(front)
    front = seen
    for depth in range(1, max_depth + 1):
        found = front.join(edges, front.symbol == edges.callee).select(F.col("caller").alias("symbol"), F.concat_ws(">", "caller", "chain").alias("chain"))
        found = found.groupBy("symbol").agg(F.min("chain").alias("chain")).join(seen.select("symbol"), "symbol", "left_anti")
        front = cut_lineage(found.select("symbol", F.lit(depth).alias("depth"), "chain"))
        seen = seen.union(front)
    return seen


#: Lines above a definition at which an entry point's decorator still belongs to it.
ATTACHED = 4


def traced_lines(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """`lines` with the enclosing symbol, the entry point near each line (e), and the one attached to the
    enclosing definition (attached). entries: file_id, line_no, kind. One shuffle, by file, for all windows."""
    first = entries.groupBy("file_id", "line_no").agg(F.min("kind").alias("entry_kind"))
    entry = F.when(F.col("entry_kind").isNotNull(), F.struct(F.col("line_no").alias("entry_line"), "entry_kind"))
    marked = lines.join(first, ["file_id", "line_no"], "left").withColumns({"e": F.min(entry).over(around(AFTER, BEFORE)), "_above": F.min(entry).over(around(ATTACHED, 0))})
    own = F.when(F.col("line").rlike(DEFINITION), F.struct(F.col("_above").alias("a")))
    up_to = W.partitionBy("file_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return enclosing(marked.withColumn("attached", F.last(own, ignorenulls=True).over(up_to).getField("a"))).drop("_above", "entry_kind")


def call_places(placed: DataFrame, max_callers: int | None = MAX_CALLERS) -> DataFrame:
    """file_id, line_no, e, caller, callee of traced lines within definitions: all places that call each name, or the first `max_callers`."""
    calls = placed.filter(~F.col("line").rlike(DEFINITION)).select("file_id", "line_no", "e", F.col("symbol").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)))).alias("callee"))
    if max_callers is None:
        return calls
    first = W.partitionBy("callee").orderBy("file_id", "line_no")
    return calls.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max_callers).drop("_n")


def _place() -> Column:
    return F.concat(F.col("file_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))


def paths_up(calls: DataFrame, symbols: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth first from each of `symbols` (symbol), all side by side, over call_places to those near an entry point: root, depth,
    file_id, line_no, callee, e, hops (from the entry point down). Of the ways to one caller the first by (file, line) stands.
    A round reads only the newest symbols; without `max_depth` rounds go on until there are none."""
    front = cut_lineage(symbols.select(F.col("symbol").alias("root"), "symbol").distinct().withColumn("hops", F.array().cast("array<string>")))
    seen, found, depth = front.select("root", "symbol"), [], 1
    while True:
        hits = front.join(calls, front.symbol == calls.callee).select("root", "file_id", "line_no", "e", "caller", "callee", F.concat(F.array(_place()), "hops").alias("hops"))
        found.append(hits.filter("e is not null").select("root", F.lit(depth).alias("depth"), "file_id", "line_no", "callee", "e", "hops"))
        if depth == max_depth:
            break
        new = hits.filter("e is null").join(seen, (hits.root == seen.root) & (hits.caller == seen.symbol), "left_anti")
        new = new.groupBy("root", F.col("caller").alias("symbol")).agg(F.min(F.struct("file_id", "line_no", "callee", "hops")).alias("m"))
        front = cut_lineage(new.select("root", "symbol", "m.hops"))
        if max_depth is None and front.isEmpty():
            break
        seen, depth = seen.union(front.select("root", "symbol")), depth + 1
    return reduce(DataFrame.union, found)


def _asked(sinks: DataFrame, placed: DataFrame) -> DataFrame:
    return sinks.select("file_id", "line_no").distinct().join(placed, ["file_id", "line_no"]).select("file_id", "line_no", "symbol", "attached")


def _placed(lines: DataFrame, entries: DataFrame) -> DataFrame:
    return traced_lines(lines, entries).filter("symbol is not null").select("file_id", "line_no", "line", "symbol", "e", "attached")


def traced_sinks(lines: DataFrame, entries: DataFrame, sinks: DataFrame) -> DataFrame:
    """The sinks within definitions: file_id, line_no, symbol, and the entry_line and entry_kind of the definition itself (a path of depth 0)."""
    return _asked(sinks, _placed(lines, entries)).select("file_id", "line_no", "symbol", "attached.entry_line", "attached.entry_kind")


def whole_paths(lines: DataFrame, entries: DataFrame, sinks: DataFrame) -> DataFrame:
    """The paths of `traces` without limits of callers, depth and paths, once for each symbol that holds sinks: its sinks (`traced_sinks`)
    share them. symbol, depth, entry_file, line_no, callee, entry_line, entry_kind, hops."""
    placed = _placed(lines, entries)
    up = paths_up(cut_lineage(call_places(placed, None)), _asked(sinks, placed))
    return up.select(F.col("root").alias("symbol"), "depth", F.col("file_id").alias("entry_file"), "line_no", "callee", "e.entry_line", "e.entry_kind", F.array_join("hops", ">").alias("hops"))


def led_sinks(lines: DataFrame, entries: DataFrame, sinks: DataFrame) -> DataFrame:
    """file_id, line_no of the sinks to which a path leads, without limits of callers and depth. Only symbols are walked, from those
    called near an entry point down to what they call, until a round finds no more."""
    placed = _placed(lines, entries)
    edges = cut_lineage(call_places(placed, None).groupBy("callee", "caller").agg(F.max(F.col("e").isNotNull()).alias("near")))
    led = front = cut_lineage(edges.filter("near").select(F.col("callee").alias("symbol")).distinct())
    while not front.isEmpty():
        below = front.join(edges, front.symbol == edges.caller).select(F.col("callee").alias("symbol")).distinct()
        front = cut_lineage(below.join(led, "symbol", "left_anti"))
        led = led.union(front)
    asked = _asked(sinks, placed)
    return asked.join(led.withColumn("_led", F.lit(True)), "symbol", "left").filter("attached is not null or _led").select("file_id", "line_no")


def traces(lines: DataFrame, entries: DataFrame, sinks: DataFrame, max_depth: int | None = MAX_DEPTH, max_paths: int | None = MAX_FANOUT, max_callers: int | None = MAX_CALLERS) -> DataFrame:
    """sinks: file_id, line_no. Call paths from entry points to each sink: a path of depth 0 where the sink's own
    definition is an entry point, else up the callers of the sink's symbol, breadth first, ending at call places
    near an entry point. At most `max_paths` a sink, in order of (depth, file, line); hops are places file:line from
    the entry point down to the sink. Of the ways to one caller the first by (file, line) stands. A sink that no
    entry point reaches has one partial path (no entry point); one outside of any definition has none. A limit of None is none;
    `whole_paths` has the same paths in less room.

    The search runs once for each symbol that holds sinks, all symbols side by side; a round reads only the newest."""
    placed = cut_lineage(_placed(lines, entries))
    calls = cut_lineage(call_places(placed, max_callers))
    asked = _asked(sinks, placed)
    up = paths_up(calls, asked, max_depth)
    if max_paths is not None:
        order = W.partitionBy("root").orderBy("depth", "file_id", "line_no", "callee")
        up = up.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_paths)
    up = up.select(F.col("root").alias("symbol"), F.struct("depth", F.col("file_id").alias("f"), F.col("line_no").alias("l"), "callee", F.col("file_id").alias("entry_file"), "e", "hops").alias("p"))
    none = F.array().cast("array<string>")
    at_once = lambda entry: F.struct(F.lit(0).alias("depth"), F.col("file_id").alias("f"), F.col("line_no").alias("l"), F.lit("").alias("callee"), F.when(entry.isNotNull(), F.col("file_id")).alias("entry_file"), entry.alias("e"), none.alias("hops"))
    direct = asked.filter("attached is not null").select("file_id", "line_no", "symbol", at_once(F.col("attached")).alias("p"))
    both = direct.union(asked.join(up, "symbol").select("file_id", "line_no", "symbol", "p"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("file_id", "line_no").orderBy("p")))
    if max_paths is not None:
        ranked = ranked.filter(F.col("rank") <= max_paths)
    partial = asked.join(ranked.select("file_id", "line_no").distinct(), ["file_id", "line_no"], "left_anti")
    nothing = F.lit(None).cast(placed.schema["attached"].dataType)
    partial = partial.select("file_id", "line_no", "symbol", at_once(nothing).alias("p"), F.lit(1).alias("rank"))
    out = ranked.select("file_id", "line_no", "symbol", "p", "rank").union(partial)
    return out.select("file_id", "line_no", "symbol", "rank", "p.depth", "p.entry_file", "p.e.entry_line", "p.e.entry_kind", F.array_join(F.concat("p.hops", F.array(_place())), ">").alias("hops"))


def assigned(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, ASSIGNMENT, 1), F.lit(""))


NAMES = r"([$@]?[A-Za-z_][A-Za-z0-9_]*)"


def sources_near(source_kinds: list[str], radius: int = TAINT_RADIUS) -> Column:
    """Of hits of all kinds: the sources within the radius of a line (at most one of each kind a line)."""
    order = F.array_position(F.array(*(F.lit(k) for k in source_kinds)), F.col("kind"))
    source = F.struct(F.col("line_no").alias("at"), (-order).alias("first"), F.col("kind").alias("source_kind"), assigned(F.col("line")).alias("variable"))
    return F.collect_list(F.when(F.col("kind").isin(source_kinds), source)).over(around(radius, radius))


def reaches_line(variable: Column) -> Column:
    """Whether a source reaches the line: it assigns no variable, or one that the line uses."""
    return variable.isNull() | F.array_contains(F.regexp_extract_all("line", F.lit(NAMES), F.lit(1)), variable)


def taint_flows(hits: DataFrame, source_kinds: list[str], radius: int = TAINT_RADIUS) -> DataFrame:
    """hits: file_id, line_no, kind, line, of sources (kinds in order of precedence) and sinks. A source line
    within the radius reaches a sink line that uses the variable it assigns, or any if it assigns none; a
    variable assigned again counts for its last source. One flow a sink line, source kind and sink kind."""
    near = hits.withColumn("s", sources_near(source_kinds, radius)).filter(~F.col("kind").isin(source_kinds))
    near = near.select("file_id", "line_no", "kind", "line", F.explode("s").alias("s"))
    own = F.coalesce("s.variable", F.concat(F.lit("#"), F.col("s.at").cast("string")))
    last = near.groupBy("file_id", "line_no", "kind", "line", own.alias("v")).agg(F.max("s").alias("s"))
    return last.filter(reaches_line(F.col("s.variable"))).select("file_id", "line_no", F.col("kind").alias("sink_kind"), "s.source_kind").distinct()


def joined_evidence(hits: DataFrame, kinds: dict[str, list[str]], nullifying: list[str], required: list[str], rank: Column) -> DataFrame:
    """hits: file_id, line_no, line, kind (null where a line has no match). kinds: those of each group.
    Findings of three families with the evidence that their verdicts read: of each file and kind of sink
    (flow), and of each file (access, config). `rank` is the severity of a configuration kind."""

    def of(group: str) -> Column:
        return F.coalesce(F.col("kind").isin(kinds[group]), F.lit(False))

    whole = W.partitionBy("file_id")
    null = F.coalesce(F.col("kind").isin(nullifying), F.lit(False))
    reached = F.coalesce(F.exists("s", lambda s: reaches_line(s.variable)), F.lit(False))
    marked = hits.withColumns({"s": sources_near(kinds["source"]), "e": entry_near(kinds["entry"]), "nullified": F.max(null).over(whole), "soft": F.max(of("mitigation") & ~null).over(whole), "entries": F.max(of("entry")).over(whole)})
    flow = marked.filter(of("sink")).groupBy("file_id", "kind").agg(*(F.max(c).alias(c) for c in ("nullified", "soft", "entries")), F.max(F.col("e").isNotNull()).alias("reaches"), F.max(reached).alias("taint")).withColumn("family", F.lit("flow"))
    present = F.count_distinct(F.when(F.col("kind").isin(required), F.col("kind")))
    files = hits.groupBy("file_id").agg((F.lit(len(required)) - present).alias("missing"), F.max(of("control")).alias("authz"), F.count_if(of("config")).alias("found"), F.coalesce(F.max(F.when(of("config"), rank)), F.lit(0)).alias("top_rank"))
    files = files.withColumn("checks", F.lit(len(required))).withColumn("family", F.explode(F.array(F.lit("access"), F.lit("config")))).withColumn("kind", F.col("family"))
    return flow.unionByName(files, allowMissingColumns=True)


def traced_evidence(evidence: DataFrame, sinks: DataFrame, paths: DataFrame) -> DataFrame:
    """joined_evidence with `reaches` by call paths: whether `traces` (paths) lead an entry point to one of the finding's sinks
    (file_id, line_no, kind), in place of an entry point nearby."""
    return led_evidence(evidence, sinks, paths.filter("entry_line is not null").select("file_id", "line_no").distinct())


def led_evidence(evidence: DataFrame, sinks: DataFrame, led: DataFrame) -> DataFrame:
    """traced_evidence by the sinks (file_id, line_no) to which paths lead."""
    reached = sinks.join(led, ["file_id", "line_no"], "left_semi").select("file_id", "kind").distinct().withColumn("_led", F.lit(True))
    return evidence.join(reached, ["file_id", "kind"], "left").withColumn("reaches", F.when(F.col("family") == "flow", F.coalesce("_led", F.lit(False)))).drop("_led")


def required_controls(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """asked: finding_id, file_id, kind. Every required control with its places, and whether it is there."""
    found = hits.groupBy("file_id", "kind").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    return asked.join(found, ["file_id", "kind"], "left").select("finding_id", "kind", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n_places"), "first_line")


#: Verdicts and confidences, in the order in which they are tried. Fixed values.
def flow_verdict(nullified: Column, soft: Column, reaches: Column, taint: Column, entries: Column) -> Column:
    return (
        F.when(nullified, _v("fully_mitigated", 0.85))
        .when(reaches & taint & ~soft, _v("confirmed_exploitable", 0.90))
        .when((reaches | taint) & soft, _v("partial_mitigation", 0.60))
        .when(reaches | taint, _v("likely_exploitable", 0.65))
        .when(~entries, _v("unreachable", 0.55))
        .otherwise(_v("insufficient_signal", 0.30))
    )


def access_verdict(checks: Column, missing: Column, authz: Column) -> Column:
    """checks and missing: numbers of required and of missing controls; authz: any control at all."""
    return (
        F.when((checks > 0) & (missing == 0), _v("fully_mitigated", 0.85))
        .when((missing > 0) & (missing == checks), _v("confirmed_exploitable", 0.85))
        .when(missing > 0, _v("partial_mitigation", 0.60))
        .when(authz, _v("likely_exploitable", 0.55))
        .otherwise(_v("insufficient_signal", 0.30))
    )


def config_verdict(findings: Column, top_rank: Column) -> Column:
    return F.when(findings == 0, _v("fully_mitigated", 0.70)).when(top_rank >= 3, _v("confirmed_exploitable", 0.80)).otherwise(_v("partial_mitigation", 0.55))


def combined_verdict(family: Column, flow: Column, access: Column, config: Column, only_errors: Column, exhausted: Column) -> Column:
    chosen = F.when(only_errors, _v("error", 0.0)).when(family == "flow", flow).when(family == "access", access).otherwise(config)
    less = F.greatest(F.lit(0.1), chosen.confidence - 0.15)
    return F.struct(chosen.status.alias("status"), F.round(F.when(exhausted & ~only_errors, less).otherwise(chosen.confidence), 2).alias("confidence"))


def _v(status: str, confidence: float) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))
