"""Previews of HTML pages, and their tables of contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions.html import preview

LINK, HEAD = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])), pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string())]))
#: Pages of a batch that are held in Python at a time.
ROWS = 64


def previews(pages: DataFrame, tags: tuple[str, ...] = (), classes: tuple[str, ...] = ("report-header",), names: tuple[str, ...] | None = None) -> DataFrame:
    """key, html, links (before, after), headings (level, title) of pages (key, folder, html). A null text stays null.
    Titles have the character references `names` resolved (all, if None)."""
    key = pages.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                found = [None if t is None else preview(t, f or "", tags, classes, names) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                links = [[] if p is None else [{"before": a, "after": b} for a, b in p.links] for p in found]
                heads = [[] if p is None else [{"level": a, "title": b} for a, b in p.headings] for p in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p and p.html for p in found], pa.string()), pa.array(links, LINK), pa.array(heads, HEAD)], names=[key, "html", "links", "headings"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.mapInArrow(run, f"`{key}` {kind}, html string, links array<struct<before: string, after: string>>, headings array<struct<level: int, title: string>>")


def contents(found: DataFrame, key: str, deepest: int = 3) -> DataFrame:
    """key, ord, level, number (a counter of each level since the last heading of a higher one), anchor, title. Anchors
    are the titles' letters and digits; a second one of a page gets a number."""
    rows = found.select(key, F.posexplode("headings").alias("ord", "h")).select(key, "ord", "h.level", "h.title").filter(F.col("level") <= deepest)
    above: list[str] = [key]
    for level in range(1, deepest + 1):
        here = W.partitionBy(*above).orderBy("ord")
        rows = rows.withColumn(f"_n{level}", F.sum((F.col("level") == level).cast("long")).over(here))
        above.append(f"_n{level}")
    number = F.array_join(F.slice(F.array(*(F.col(f"_n{i}").cast("string") for i in range(1, deepest + 1))), F.lit(1), F.col("level")), ".")
    slug = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit("-"))
    rows = rows.withColumn("_slug", F.when(slug == "", "section").otherwise(slug))
    again = F.row_number().over(W.partitionBy(key, "_slug").orderBy("ord"))
    anchor = F.when(again == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", again.cast("string")))
    return rows.withColumn("anchor", anchor).select(key, "ord", "level", number.alias("number"), "anchor", "title")
