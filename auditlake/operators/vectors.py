"""Vector similarity, pooling and score audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Norms above this are taken for broken vectors.
MAX_NORM = 1e12
CUT_OFFS = (-0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4)
BANDS = (("high", 0.25), ("medium", 0.15), ("low", 0.05))
TIERS = (("strong", 0.8), ("moderate", 0.6), ("weak", 0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x * x))


def usable(v: Column) -> Column:
    """A vector that can be compared: no null, every element finite, norm above 0 and not absurd."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & (norm(v) > 0) & (norm(v) <= MAX_NORM)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a norm is 0; null where dimensions differ."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    return F.when(F.size(a) == F.size(b), F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb)))


def similarity_join(files: DataFrame, types: DataFrame, least: float | None = None, max_types: int = 10_000) -> DataFrame:
    """Every file against every type (type_id, v): theta join by score. The catalog of types is small by
    nature; its size is checked before it is broadcast, and a larger one is joined without."""
    t = types.select("type_id", F.col("v").alias("_tv"), norm(F.col("v")).alias("_tn"))
    small = types.limit(max_types + 1).count() <= max_types
    scored = files.withColumn("_fn", norm(F.col("v"))).crossJoin(F.broadcast(t) if small else t)
    scored = scored.withColumn("score", cosine(F.col("_tv"), F.col("v"), F.col("_tn"), F.col("_fn"))).drop("_tv", "_tn", "_fn", "v")
    return scored if least is None else scored.filter(F.col("score") >= least)


def pooled(chunks: DataFrame, key: str, vector: str = "v") -> DataFrame:
    """Element-wise mean of each key's usable vectors; null where dimensions differ."""
    good = chunks.filter(usable(F.col(vector)))
    sizes = good.groupBy(key).agg(F.min(F.size(vector)).alias("_lo"), F.max(F.size(vector)).alias("_hi"))
    means = good.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg("_x").alias("_m"))
    vectors = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_p"))
    return vectors.join(sizes, key).select(key, F.when(F.col("_lo") == F.col("_hi"), F.col("_p._m")).alias("v"))


def threshold_histogram(scores: DataFrame, by: list[str], score: str = "score", cut_offs: tuple[float, ...] = CUT_OFFS) -> DataFrame:
    """Counts and percents at or above each cut-off, in one pass."""
    aggs = [F.count_if(F.col(score) >= t).alias(f"_{i}") for i, t in enumerate(cut_offs)]
    wide = scores.groupBy(*by).agg(F.count("*").alias("_n"), *aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("cut_off"), F.col(f"_{i}").alias("n")) for i, t in enumerate(cut_offs))))
    return wide.select(*by, "_n", rows.alias("_r")).select(*by, "_r.cut_off", F.col("_r.n").alias("n_at_least"), F.round(F.col("_r.n") * 100 / F.col("_n"), 4).alias("percent"))


def score_statistics(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Average, upper-middle median, extremes and count. The median is found by rank, so a group need not
    fit one row."""
    ranked = scores.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(score)))
    base = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"), F.max(score).alias("max_score"), F.min(score).alias("min_score"))
    middle = ranked.join(F.broadcast(base.select(*by, F.floor(F.col("n") / 2 + 1).alias("_r"))), [*by, "_r"]).select(*by, F.col(score).alias("median_upper"))
    return base.join(middle, by).select(*by, "n", F.round("avg_score", 6).alias("avg_score"), F.round("median_upper", 6).alias("median_upper"), F.round("max_score", 6).alias("max_score"), F.round("min_score", 6).alias("min_score"))


def banded_counts(scores: DataFrame, by: str, score: str = "score", bands: tuple[tuple[str, float], ...] = BANDS) -> DataFrame:
    """Counts by band for each value of `by` and for all of them, marked TOTAL."""
    (high, h), (medium, m), (low, lo) = bands
    s = F.col(score)
    counts = [F.count_if(s >= h).alias(high), F.count_if((s >= m) & (s < h)).alias(medium), F.count_if((s >= lo) & (s < m)).alias(low)]
    rolled = scores.rollup(by).agg(F.grouping(by).alias("_g"), F.count("*").alias("n"), *counts)
    return rolled.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(by).cast("string")).alias("name"), "n", high, medium, low, (F.col("_g") == 1).alias("is_total"))


def audit_metrics(scores: DataFrame, score: str = "score") -> DataFrame:
    finite = scores.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    return finite.agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("avg_score"), F.round(F.percentile(score, F.lit(0.5)), 6).alias("median"), F.round(F.min(score), 6).alias("min_score"), F.round(F.max(score), 6).alias("max_score"))


def tier(score: Column, tiers: tuple[tuple[str, float], ...] = TIERS) -> Column:
    """Not finite: the weakest; otherwise clamped to 0..1, lower bounds inclusive."""
    broken = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    weakest = F.when(broken, F.lit(tiers[-1][0]))
    for name, least in tiers[:-1]:
        weakest = weakest.when(clamped >= least, F.lit(name))
    return weakest.otherwise(F.lit(tiers[-1][0]))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; tasks keep n of a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)
