"""Line, chunk and window operators over texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 2048


def lines_of(text: Column) -> Column:
    """Lines without their ends; one line end at the end of the text starts no line."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"))


def exploded(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with a row for each line: line_no from 1, and line."""
    others = [c for c in files.columns if c != content]
    return files.select(*others, F.posexplode(lines_of(F.col(content))).alias("_i", "line")).select(*others, (F.col("_i") + 1).cast("long").alias("line_no"), "line")


def pack_lines(lines: list[str], limit: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of chunks of at most `limit` characters, line ends counted. A line that
    doesn't fit any chunk is cut into pieces that all carry its number."""
    held: list[str] = []
    size = 0
    for number, line in enumerate(lines, 1):
        cost = len(line) + 1
        if held and size + cost > limit:
            yield number - len(held), number - 1, "\n".join(held)
            held, size = [], 0
        if cost > limit:
            for at in range(0, len(line), limit):
                yield number, number, line[at : at + limit]
        else:
            held.append(line)
            size += cost
    if held:
        yield len(lines) - len(held) + 1, len(lines), "\n".join(held)


def chunks(files: DataFrame, key: str, content: str = "content", limit: int = CHUNK_CHARS) -> DataFrame:
    """key, chunk (from 0), start_line, end_line, text. The running length that starts anew with each
    chunk is no window function, so whole texts go through Arrow batches."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = list(pack_lines((text or "").splitlines(), max(1, limit)))
                if rows:
                    cols = [pa.array([k.as_py()] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int32()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string())))]
                    yield pa.RecordBatch.from_arrays(cols, names=[key, "chunk", "start_line", "end_line", "text"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, chunk int, start_line int, end_line int, text string")


def expanded(lines: Column, start: Column, end: Column, before: int, after: int, max_chars: int) -> Column:
    """(text, start_line, end_line) of a window about lines start..end: padded if that fits; else grown a line
    on both sides as long as it fits; the core alone, when too long, is cut."""
    n = F.size(lines)
    lo, hi = F.greatest(F.lit(1), start - before), F.least(n, end + after)
    joined = lambda a, b: F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")
    core_lo, core_hi = F.greatest(lo, start), F.least(hi, end)
    at = lambda k: (F.greatest(lo, core_lo - k), F.least(hi, core_hi + k))
    steps = F.sequence(F.lit(0), F.greatest(core_lo - lo, hi - core_hi, F.lit(0)))
    best = F.coalesce(F.array_max(F.filter(steps, lambda k: F.length(joined(*at(k))) <= max_chars)), F.lit(-1))
    cut = F.substring(joined(core_lo, core_hi), 1, max_chars)
    cut_end = core_lo + F.length(cut) - F.length(F.replace(cut, F.lit("\n")))
    whole = F.struct(joined(lo, hi).alias("text"), lo.alias("start_line"), hi.alias("end_line"))
    core = F.struct(cut.alias("text"), core_lo.alias("start_line"), cut_end.alias("end_line"))
    grown = F.struct(joined(*at(best)).alias("text"), at(best)[0].alias("start_line"), at(best)[1].alias("end_line"))
    none = F.struct(F.lit("").alias("text"), start.alias("start_line"), end.alias("end_line"))
    return F.when(n == 0, none).when(F.length(joined(lo, hi)) <= max_chars, whole).when(best < 0, core).otherwise(grown)


def line_span(text: Column, needle: Column) -> Column:
    """(start_line, end_line) of the first place of a snippet in a text; else of its first line if that has
    eight characters; else null."""
    first = F.trim(F.get(F.split(F.trim(needle), "\n"), F.lit(0)))
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n")))

    def span(piece: Column) -> Column:
        at = F.instr(text, piece)
        line = breaks(F.left(text, at - 1)) + 1
        return F.when(at > 0, F.struct(line.alias("start_line"), (line + breaks(piece)).alias("end_line")))

    return F.when(F.length(F.trim(needle)) > 0, F.coalesce(span(needle), F.when(F.length(first) >= 8, span(first))))


def safe_cut(text: Column, limit: int) -> Column:
    """The text up to the last paragraph, else line, that ends before the limit."""
    head = F.left(text, F.lit(limit))
    paragraph = F.length(head) - F.instr(F.reverse(head), F.lit("\n\n")) - 1
    line = F.length(head) - F.instr(F.reverse(head), F.lit("\n"))
    has_p, has_l = F.contains(head, F.lit("\n\n")), F.contains(head, F.lit("\n"))
    return F.when(F.length(text) <= limit, text).when(has_p, F.left(text, paragraph)).when(has_l, F.left(text, line)).otherwise(head)


def truncated(text: Column, limit: int, suffix: str = "…") -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(max(0, limit - len(suffix)))), F.lit(suffix)))
