"""Operator 13, a similarity join of n-gram sets by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes, so pivots that cut it into even fragments are known
beforehand and no frequency has to be counted for them. A set is a row of fragments.

Candidates. Linked sets of sizes x and y differ in at most (100 - p) (x + y) / (100 + p) members, so of F fragments
all but that many, d, are equal as a whole. Sizes lie in bands, each with a d and F = d + T: linked sets of a band
agree on T fragments at least (T about half of d). A set is posted under its fragments, in its own band and in
those below that hold sizes it may be linked with; a fragment that no other set has can't agree, and of s that
others have too, the s - T + 1 rarest are enough. Many sets that share a passage agree on few whole fragments, so
they don't meet; a band whose d is 0 links equal sets only and posts nothing.

Overlaps. Each candidate pair is dealt out by coarse fragments; the members that both have are counted in each
fragment separately and summed per pair. No task needs a whole set of either side.

A posting is not expanded into its pairs: equal sets are one class; each member is held against the posting's least
one first, and links join classes to components. What is still in postings of several components is posted anew
by single n-grams under the order by their frequency among those sets (a set that shares s n-grams with others
needs the s - ceil(p n / 100) + 1 rarest, and none if it shares too few). In those postings members are held against
members of other components in cells of bounded size. Pairs are ruled out first by sizes and by parity sketches,
which never rule out a link. So no link between different components is lost.

A null text and one without words have an empty set and are linked with nothing; fewer than WORDS words are one
n-gram; a null doc_id is linked with nothing (component_id null); rows that repeat a doc_id are one node; an empty
table gives an empty result; other columns are not read; long texts are read as a whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, free_shuffles, importable, short, table, text_bytes
from auditlake.llm.op8_neardup import _mixed, components, near_hubs, near_in_postings, open_postings, shingles, sketch

WORDS = 3
PERCENT = 90
#: A band's sizes: from its least one to 1.5 times that.
BAND = 1.5
#: Coarse fragments of a small set; twice as many for each doubling of the size above SEGMENT members a fragment.
SEGMENTS_LOG, SEGMENT = 2, 4096
#: Pairs of a member with one component that are counted before all are.
BEST = 8


class Bands:
    """Size bands with the fragments of each and how many of them linked sets have in common."""

    def __init__(self, percent: int) -> None:
        self.percent, self.low = percent, [1]

    def _bound(self, band: int) -> int:
        while len(self.low) <= band:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND)))
        return self.low[band]

    def most(self, n: int) -> int:
        """The greatest size that a set of n members may be linked with."""
        return 100 * n // self.percent

    def numbers(self, band: int) -> tuple[int, int]:
        """Differences at most and fragments; no fragments if linked sets are equal."""
        x = self._bound(band + 1) - 1
        d = (100 - self.percent) * (x + self.most(x)) // (100 + self.percent)
        return d, d + self.agreeing(d) if d else 0

    @staticmethod
    def agreeing(d: int) -> int:
        return max(1, d // 2)

    def of(self, n: int) -> list[int]:
        """Bands a set of n members is posted in."""
        band = 0
        while self._bound(band + 1) <= n:
            band += 1
        found = [band]
        while found[-1] and self.most(self._bound(found[-1]) - 1) >= n:
            found.append(found[-1] - 1)
        return found


def fragments(s: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray]]:
    """(least agreeing, a code for each whole fragment) of a set, band by band."""
    out = []
    for band in bands.of(len(s)):
        d, count = bands.numbers(band)
        if count:
            # Pivots are multiples of 2^64 / count; the high half of the product with count is the fragment.
            at = ((s >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s), dtype=np.uint64)])
            ends = np.searchsorted(at, np.arange(count + 1))
            value = total[ends[1:]] - total[ends[:-1]]
            mark = np.arange(count, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1)
            out.append((bands.agreeing(d), _mixed(value + _mixed(mark)).view(np.int64)))
    return out


def prepared(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty set) and posts (need, codes) of every row."""
    importable(docs.sparkSession)
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            sets = [shingles(t or b"", words) for t in text_bytes(batch.column(1))]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            posts = [fragments(s, bands) if len(s) else [] for s in sets]
            flat = [p for own in posts for p in own]
            ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
            codes = pa.ListArray.from_arrays(ends(len(c) for _, c in flat), pa.array(np.concatenate([np.empty(0, np.int64), *(c for _, c in flat)])))
            each = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.int32()), codes], names=["need", "codes"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends(map(len, posts)), each)], names=["doc_id", "n_shingles", "set_key", "posts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, posts array<struct<need: int, codes: array<long>>>")


def rarest(values: DataFrame) -> DataFrame:
    """(code, node): each node under the rarest of its codes that it shares with others, as many as are needed for two
    linked ones to meet. values: code, node, group (codes of one group count together), need."""
    shared = values.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")
    own = W.partitionBy("node", "group")
    ranked = values.join(shared, "code").select("code", "node", "need", F.row_number().over(own.orderBy("n", "code")).alias("rank"), F.count("*").over(own).alias("s"))
    return ranked.filter(F.col("rank") <= F.col("s") - F.col("need") + 1).select("code", "node")


def postings_of(every: DataFrame) -> DataFrame:
    """(code, node, hub): postings of several members with their least one. Those of the same members are one."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    members = every.groupBy("code").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size"), mark(1).alias("m1"), mark(2).alias("m2")).filter("hub < last")
    one = members.groupBy("hub", "size", "m1", "m2").agg(F.min("code").alias("code")).select("code", "hub")
    return every.join(one, "code")


def members(texts: DataFrame, words: int) -> DataFrame:
    """node, n, brief (a parity sketch), lg and segments (the set, cut at the 2^lg-quantiles of the order). texts: node,
    set_key, text; rows whose text has another set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 2):
            sets = [(node, s) for node, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True) if hashlib.blake2b((s := shingles(t, words)).tobytes(), digest_size=16).digest() == key]
            lg = [segments_log(len(s)) for _, s in sets]
            cut = [[x.tobytes() for x in np.split(s, np.searchsorted(s, np.arange(1, 1 << k, dtype=np.uint64) << np.uint64(64 - k)))] for (_, s), k in zip(sets, lg, strict=True)]
            columns = [([x for x, _ in sets], pa.int64()), ([len(s) for _, s in sets], pa.int64()), ([sketch(s).tobytes() for _, s in sets], pa.binary()), (lg, pa.int32()), (cut, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns], names=["node", "n", "brief", "lg", "segments"])

    return texts.mapInArrow(run, "node long, n long, brief binary, lg int, segments array<binary>").dropDuplicates(["node"])


def segments_log(n: int) -> int:
    lg = SEGMENTS_LOG
    while n > SEGMENT << lg:
        lg += 1
    return lg


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: overlaps are counted fragment by fragment and summed."""
    size = sets.select("node", "n", "lg")
    sized = pairs.join(size.toDF("a", "n_a", "lg_a"), "a").join(size.toDF("b", "n_b", "lg_b"), "b")
    # The side that is cut finer leads; the fragment of the other holds all of its fragment.
    turned = F.col("lg_a") < F.col("lg_b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    led = sized.select("a", "b", "n_a", "n_b", pick("a", "b").alias("fine"), pick("b", "a").alias("coarse"), F.abs(F.col("lg_a") - F.col("lg_b")).alias("shift"))
    cut = sets.select("node", F.posexplode("segments").alias("g", "own"))
    dealt = led.join(cut.toDF("fine", "g", "x"), "fine").withColumn("g", F.expr("shiftright(g, shift)"))
    dealt = dealt.join(cut.toDF("coarse", "g", "y"), ["coarse", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], names=["a", "b", "n_a", "n_b", "part"])

    parts = dealt.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long, n_a long, n_b long, part long")
    total = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("both"))
    return total.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def grams(sets: DataFrame, percent: int) -> DataFrame:
    """code, node, group, need: every n-gram of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = np.frombuffer(own, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.full(len(code), node)), pa.array(np.zeros(len(code), np.int32)), pa.array(np.full(len(code), -(-percent * n // 100)))], names=["code", "node", "group", "need"])

    return sets.select("node", "n", F.explode("segments").alias("own")).mapInArrow(run, "code long, node long, group int, need long")


def similarity_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(prepared(docs, words, percent), "rows")
    known = rows.filter("set_key is not null and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("posts").alias("posts"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    free_shuffles(spark)
    posts = classes.select("node", F.posexplode("posts").alias("group", "post")).select("node", "group", F.col("post.need").alias("need"), F.explode("post.codes").alias("code"))
    every = scratch.write(rarest(posts), "every")
    free_shuffles(spark)
    postings = scratch.write(postings_of(every), "postings")
    scratch.drop("every")
    taking = classes.select("node", "set_key", F.col("least").alias("doc_id")).join(postings.select("node").distinct(), "node")
    texts = docs.filter("text is not null").select("doc_id", "text").join(taking, "doc_id").select("node", "set_key", "text")
    sets = scratch.write(members(texts, words), "sets")
    briefs = sets.select("node", "n", "brief")
    free_shuffles(spark)
    # A doc_id with several sets ties their classes together.
    of_doc = known.join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    tied = of_doc.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last")
    of_doc = of_doc.join(tied, "doc_id").filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    hubs = lambda p: p.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = scratch.write(overlapping(near_hubs(hubs(postings), briefs, percent, 0, 0), sets, percent).union(of_doc), "links-0")
    free_shuffles(spark)
    roots = components(scratch, links, "parts-0")
    rooted = lambda p: p.join(roots, "node", "left").select("code", "node", F.coalesce("root", "node").alias("root"))
    # Sets in postings that are several components yet, by their n-grams.
    placed = rooted(postings)
    open_ = scratch.write(placed.join(open_postings(placed), "code", "left_semi").select("node").distinct(), "open")
    if not open_.isEmpty():
        finer = scratch.write(postings_of(rarest(grams(sets.join(open_, "node", "left_semi"), percent))), "finer")
        links = scratch.write(overlapping(near_hubs(hubs(finer), briefs, percent, 0, 0), sets, percent), "links-1")
        free_shuffles(spark)
        if not links.isEmpty():
            roots = components(scratch, roots.toDF("a", "b").union(links), "parts-1")
        codes = None
        for k, best in ((2, BEST), (3, 0)):
            held = finer if codes is None else finer.join(codes, "code", "left_semi")
            held = scratch.write(rooted(held), f"placed-{k}")
            near = scratch.write(near_in_postings(held, briefs, best, percent=percent, coordinates=0, matches=0), f"near-{k}")
            links = scratch.write(overlapping(near.select("a", "b").distinct(), sets, percent), f"links-{k}")
            free_shuffles(spark)
            if not links.isEmpty():
                roots = components(scratch, roots.toDF("a", "b").union(links), f"parts-{k}")
            codes = near.filter("more").select("code").distinct()
            if codes.isEmpty():
                break
    rep = classes.select("set_key", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = rep.groupBy("root").agg(F.min("least").alias("component_id"))
    rep = rep.select("set_key", "root").join(of_root, "root").select("set_key", "component_id")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(rep, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))
