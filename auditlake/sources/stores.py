"""File sources and the stores that a code audit keeps: index, cache, reports, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions.names import extension

MAX_FILE_BYTES = 1 << 20
#: Source suffixes that are read, and folders that are not. Fixed values.
EXTENSIONS = ("py", "js", "ts", "jsx", "tsx", "java", "go", "rb", "php", "cs", "c", "cpp", "h", "hpp", "rs", "kt", "swift", "scala", "sh", "sql", "html", "vue", "yml", "yaml", "json", "xml")
IGNORED = ("node_modules", ".git", "venv", "__pycache__", "dist", "build", "target", "vendor")
VULNERABILITY = "tag string, name string, description string, patterns array<string>, impact string, mitigation string, _corrupt_record string"


#: Files of a guarded walk.
WALK_FILES = 5000


def guarded_walk(files: DataFrame, allowed: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """The first WALK_FILES of the files (path, content) by path that have an allowed `suffix`, at most MAX_FILE_BYTES, no
    ignored folder, and a path that does not leave the root."""
    suffix = F.lower(F.regexp_extract("path", r"[^/.][^/]*\.([A-Za-z0-9]+)$", 1))
    folders = F.split(F.lower(F.regexp_extract("path", "^(.*)/", 1)), "/")
    barred = F.arrays_overlap(folders, F.array(*(F.lit(x) for x in (*ignored, ".."))))
    kept = files.filter((F.octet_length("content") <= MAX_FILE_BYTES) & ~barred & ~F.col("path").startswith("/"))
    return kept.join(F.broadcast(allowed), suffix == F.col("suffix"), "left_semi").orderBy("path").limit(WALK_FILES)


def source_tree(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED, limit: int | None = None) -> DataFrame:
    """path and content of the source files under a folder: by suffix, none too large, none in ignored
    folders. Size and path are checked before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.filter(extension(F.col("path")).isin(*extensions) & (F.col("length") <= MAX_FILE_BYTES))
    for name in ignored:
        kept = kept.filter(~F.contains("path", F.lit(f"/{name}/")))
    if limit:
        kept = kept.orderBy("path").limit(limit)
    return kept.select("path", decoded(F.col("content")).alias("content"))


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are, else Latin-1, which reads anything."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def with_replacement(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def listed_paths(spark: SparkSession, list_file: str) -> DataFrame:
    """The paths in a list file, one a line."""
    from auditlake.functions.names import clean_path

    return spark.read.text(list_file).select(clean_path(F.col("value")).alias("path")).filter("path != ''")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerability definitions, one JSON file each; ill-formed ones are left out."""
    rows = spark.read.schema(VULNERABILITY).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
    text = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    good = F.col("_corrupt_record").isNull() & text("name") & text("description") & text("impact") & text("mitigation") & (F.size("patterns") > 0) & F.forall("patterns", lambda p: F.trim(p) != "")
    return rows.withColumn("tag", F.coalesce("tag", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))).filter(good).drop("_corrupt_record")


def run_of(path: Column) -> Column:
    """(project, run, model, format, stem) of a report file, in any of the three layouts."""
    tail = r"([^/]+)/(json|md|html|pdf|sarif)/([^/]+)\.[a-z]+$"
    stamp = r"([0-9]{8}_[0-9]{6})"
    return F.struct(
        F.nullif(F.regexp_extract(path, rf"([^/]+)/{stamp}/{tail}", 1), F.lit("")).alias("project"),
        F.regexp_extract(path, stamp, 1).alias("run"),
        F.regexp_extract(path, tail, 1).alias("model"),
        F.regexp_extract(path, tail, 2).alias("format"),
        F.regexp_extract(path, tail, 3).alias("stem"),
    )


def report_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON reports with their place in the tree; progress sidecars are left out."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(path)
    return rows.withColumn("_r", run_of(F.col("_metadata.file_path"))).filter(~F.endswith("_r.stem", F.lit(".progress"))).select("*", "_r.*").drop("_r")


def misses(asked: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return asked.join(cache.select(key), key, "left_anti")


def looked_up(asked: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return asked.join(cache, key, "left")


def newest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """An upsert: the last version of each key."""
    w = W.partitionBy(*key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
