"""Report trees as a data source: artifacts are written as files and read back as index rows, with pruning by run directory.

A tree holds run directories in three layouts, `<name>_<stamp>`, `<stamp>` and `<folder>/<stamp>`, and in each run
`<model>/<format>/<stem>.<format>`. Options of the reader: `path`, `runs_per_partition`, `filters`, and JSON lists of wanted `folder`, `run_key`, `model`, `format`. Paths are local or of any file system that
pyarrow opens by its URI. Only this module is sent to Python workers, so it uses no other one of the package."""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Formats of artifacts and the counters of a report. Fixed values.
FORMATS = ("json", "md", "html", "pdf", "sarif")
COUNTERS = ("critical", "high", "medium", "low")

INDEX = (
    "path string, folder string, run_key string, date string, model string, format string, stem string, vulnerability_type string, project string, language string, "
    + ", ".join(f"{c} long" for c in COUNTERS)
    + ", completed long, total long, alternatives string, size long"
)
PRUNED = ("folder", "run_key", "model", "format")
STAMP = r"\d{8}_\d{6}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if re.match(r"file:/(?!/)", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listing(files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The entries of a directory by name; none where there is no such directory."""
    return sorted(files.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.base_name)


def folders(files: fs.FileSystem, path: str) -> list[str]:
    return [f.base_name for f in listing(files, path) if f.type == fs.FileType.Directory]


def shown_date(run_key: str) -> str:
    """2026-01-02 03:04:05 for a run of 20260102_030405; empty where the stamp is no date."""
    import datetime

    try:
        return str(datetime.datetime.strptime(run_key[-15:], "%Y%m%d_%H%M%S"))
    except ValueError:
        return ""


def payload(files: fs.FileSystem, path: str) -> dict:
    """A JSON report; empty where the file is absent or no JSON object."""
    try:
        with files.open_input_stream(path) as f:
            doc = json.loads(f.read())
    except (OSError, ValueError):
        return {}
    return doc if isinstance(doc, dict) else {}


def whole(x: object) -> int:
    """A counter as a whole number of 64 bits; 0 where there is none."""
    try:
        n = int(x)
    except (TypeError, ValueError, OverflowError):
        return 0
    return n if -(1 << 63) <= n < 1 << 63 else 0


def text(x: object) -> str | None:
    return x if isinstance(x, str) and x else None


class Runs(InputPartition):
    def __init__(self, keys: list[tuple[str | None, str]]):
        self.keys = keys


class ReportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.step = options["path"], max(1, int(options.get("runs_per_partition", 16)))
        self.wanted = {name: set(json.loads(options[name])) for name in PRUNED if name in options}

    def admits(self, name: str, value: str | None) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def runs(self) -> Iterator[tuple[str | None, str]]:
        """(folder, key) of each run directory; only two levels of directories are listed, and only folders that can match."""
        files, root = opened(self.root)
        for name in folders(files, root):
            if re.fullmatch(STAMP, name):
                found = [(None, name)]
            elif m := re.fullmatch(rf"(.+)_{STAMP}", name):
                found = [(m[1], name)]
            elif self.admits("folder", name):
                found = [(name, f"{name}/{x}") for x in folders(files, f"{root}/{name}") if re.fullmatch(STAMP, x)]
            else:
                continue
            yield from (r for r in found if self.admits("folder", r[0]) and self.admits("run_key", r[1]))

    def partitions(self) -> list[Runs]:
        keys = list(self.runs())
        return [Runs(keys[i : i + self.step]) for i in range(0, len(keys), self.step)] or [Runs([])]

    def read(self, partition: Runs) -> Iterator[tuple]:
        files, root = opened(self.root)
        for folder, key in partition.keys:
            for model in folders(files, f"{root}/{key}"):
                if self.admits("model", model):
                    yield from self.artifacts(files, root, folder, key, model)

    def artifacts(self, files: fs.FileSystem, root: str, folder: str | None, key: str, model: str) -> Iterator[tuple]:
        """Index rows of one model of one run. A stem's JSON gives language and project to its other formats."""
        base, stems, rows = f"{root}/{key}/{model}", {}, []
        for fmt in folders(files, base):
            if fmt not in FORMATS:
                continue
            for f in listing(files, f"{base}/{fmt}"):
                stem = f.base_name[: -len(fmt) - 1]
                if f.type == fs.FileType.File and f.base_name.endswith(f".{fmt}") and stem and not stem.endswith(".progress"):
                    stems.setdefault(stem, []).append(fmt)
                    if self.admits("format", fmt):
                        rows.append((stem, fmt, f.size))
        last, doc = None, {}
        for stem, fmt, size in sorted(rows):
            if stem != last:
                last, doc = stem, payload(files, f"{base}/json/{stem}.json") if "json" in stems[stem] else {}
            kind = " ".join(w.capitalize() for w in re.sub(r"_\d+$", "", stem).split("_") if w)
            stats = doc.get("stats") if fmt == "json" and doc else None
            progress = doc.get("progress") if fmt == "json" and kind == "Executive Summary" else None
            yield (
                f"{key}/{model}/{fmt}/{stem}.{fmt}", folder, key, shown_date(key), model, fmt, stem, kind, text(doc.get("project")) or folder, text(doc.get("language")),
                *((whole(stats.get(c)) for c in COUNTERS) if isinstance(stats, dict) else (None,) * 4),
                *((whole(progress.get(c)) for c in ("completed", "total")) if isinstance(progress, dict) else (None, None)),
                ",".join(sorted(stems[stem])), size,
            )


class FilteredReader(ReportReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on what directories are named by; all others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PRUNED and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values - {None}
            elif not (name in PRUNED[1:] and isinstance(f, IsNotNull)):
                yield f


class TreeWriter(DataSourceWriter):
    """Files of rows (path, content), the path under the root. A file appears whole or not at all, and a repeated task
    writes the same files again. Of rows with equal paths one stays. A path that is null or leaves the root is an error."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = opened(self.root)
        made = set()
        for r in rows:
            if not r.path or r.path.startswith("/") or ".." in r.path.split("/"):
                raise ValueError(f"not a path within the tree: {r.path}")
            where, part = f"{root}/{r.path}", f"{root}.parts/{uuid.uuid4().hex}"
            for folder in (where.rpartition("/")[0], f"{root}.parts"):
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
            with files.open_output_stream(part) as f:
                f.write((r.content or "").encode())
            files.move(part, where)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        """Removes what failed attempts left."""
        files, root = opened(self.root)
        if files.get_file_info(f"{root}.parts").type == fs.FileType.Directory:
            files.delete_dir(f"{root}.parts")

    abort = commit


class ReportTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_tree"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("filters") == "true" else ReportReader)(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"])


def write_tree(files: DataFrame, root: str) -> None:
    """Writes rows (path, content) as files under a root; other columns are left out."""
    files.sparkSession.dataSource.register(ReportTree)
    files.select(F.col("path").cast("string"), F.col("content").cast("string")).write.format("report_tree").mode("append").save(root)


def report_artifacts(spark: SparkSession, root: str, runs_per_partition: int = 16, **only: list[str]) -> DataFrame:
    """One index row an artifact of a tree. `only` gives the wanted folders (folder), runs (run_key), models (model) and formats (format);
    others are not listed. Filters of the query prune in the same way where spark.sql.python.filterPushdown.enabled is true."""
    if unknown := set(only) - set(PRUNED):
        raise ValueError(f"no directories are named by: {', '.join(sorted(unknown))}")
    spark.dataSource.register(ReportTree)
    reader = spark.read.format("report_tree").option("runs_per_partition", runs_per_partition).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, values in only.items():
        reader = reader.option(name, json.dumps(list(values)))
    return reader.load(root)


def json_reports(artifacts: DataFrame) -> DataFrame:
    """The JSON reports of each run and model in order of their files; progress sidecars are no artifacts."""
    from pyspark.sql import Window as W

    order = W.partitionBy("run_key", "model").orderBy("path")
    return artifacts.filter("format = 'json'").select("run_key", "model", "path", F.row_number().over(order).cast("long").alias("position"))


def _walked(batches: Iterator, depth: int | None) -> Iterator:
    """Files under the paths of a batch; with a depth, directories that lie deeper are given as they are."""
    import pandas as pd

    for batch in batches:
        found: list[str] = []
        for uri in batch["path"]:
            scheme = uri[: uri.index("://") + 3] if "://" in uri else ""
            files, path = opened(uri)
            given = files.get_file_info(path)
            stack = [(given, 0)] if given.type != fs.FileType.NotFound else []
            while stack:
                at, level = stack.pop()
                if at.type == fs.FileType.Directory and (depth is None or level < depth):
                    stack += [(f, level + 1) for f in listing(files, at.path)]
                else:
                    found.append(scheme + at.path)
                if len(found) >= 4096:
                    yield pd.DataFrame({"path": found}, dtype="object")
                    found = []
        yield pd.DataFrame({"path": found}, dtype="object")


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that an input stands for (column path): a file itself, all files under a directory, or those of the files and
    directories in a `.txt` list (one path a line, blank ones skipped; the list may itself be a folder of text parts). What does not
    exist gives nothing; what is listed twice is given twice. Directories are walked by tasks, each from two levels down."""
    files, inner = opened(path)
    kind = files.get_file_info(inner).type
    if kind == fs.FileType.NotFound:
        return spark.createDataFrame([], "path string")
    if path.endswith(".txt"):
        given = spark.read.text(path).select(F.trim("value").alias("path")).filter("path != ''")
    else:
        given = spark.createDataFrame([(path,)], "path string")
    upper = given.repartition(F.col("path")).mapInPandas(lambda b: _walked(b, 2), "path string")
    return upper.repartition(F.col("path")).mapInPandas(lambda b: _walked(b, None), "path string")
