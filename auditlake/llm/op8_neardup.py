"""Operator 8, MinHash near-duplicates by an inverted join of signature coordinates.

Texts with equal shingle sets are one class. A class has a signature of COORDINATES minima; two classes of
similarity 0.75 agree on 48 of 64 coordinates on average, and on fewer than MATCHES with a chance of about
4e-7, so agreeing on MATCHES makes a candidate. Classes are posted under coordinate-value pairs. Values that
one class alone has can't collide, and by the prefix principle a class that shares s values with others is
posted only under the s - MATCHES + 1 rarest of them: two that agree on MATCHES coordinates share at least
one posted pair. So a passage that a third of the corpus holds fills no posting, and a long posting is one
of near copies. Collisions are counted over whole signatures (their low bytes move, which can only add
candidates), and links are confirmed on full shingle sets.

What moves to a posting is brief: a class's low signature bytes and the parity sketch of its set, a bit for
each hash value. Two sketches differ in at most as many bits as the sets have members apart, so a pair that
they rule out is no link; texts move only for pairs that pass.

A posting is not expanded into its pairs. Each member is first held against the posting's least one (its
hub), and merging skips postings whose members have become one component. In those that stay open, each
member outside the largest component is held against all of other components, in cells of at most about
CELL_ROWS rows a side, so that no posting has to fit one task. Of a member's pairs with one component the
BEST are confirmed first; postings that had more, and whose members are still apart then, give all. So no
link between different components is lost. Postings are joined by their code; adaptive execution splits a
code that many rows have.

A null text and one without words have an empty set and are linked with nothing; a null doc_id is linked
with nothing and is kept (component_id null); rows that repeat a doc_id are one node; an empty table gives
an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, free_shuffles, importable, runs, short, table, text_bytes

SHINGLE = 5
COORDINATES = 64
MATCHES = 30
#: Rows of a posting that meet in one cell, a side.
CELL_ROWS = 4096
#: Pairs of a member with one component that are confirmed before all are.
BEST = 8
#: Greatest sketch, in bits. Larger sets than a quarter of it are told apart less sharply.
SKETCH_BITS = 1 << 16
RUN_BYTES = 1 << 20
CACHE_WORDS = 400_000

_ODD = np.random.default_rng(20_240_607).integers(1, 1 << 63, COORDINATES + SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_words = _WordHash()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `size` words (SHINGLE at most)."""
    words = text.lower().split()
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed(total + h[k : k + len(total)] * _ODD[COORDINATES + k])
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set, which is not empty, under every coordinate's hash."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(((flat * _ODD[i]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of a set's members by hash value, over four to eight bits a member, as bytes."""
    bits = min(SKETCH_BITS, max(64, 1 << (4 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def apart(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bits in which the sketch x differs from each row's; the longer ones are folded to the shorter width."""
    width = min(x.shape[-1], rows.shape[-1])
    x, rows = _folded(x, width), _folded(rows, width)
    return np.bitwise_count(x ^ rows).sum(axis=-1, dtype=np.int64)


def _folded(a: np.ndarray, width: int) -> np.ndarray:
    while a.shape[-1] > width:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty set), signature and brief of every row."""
    importable(docs.sparkSession)
    names = ["doc_id", "n_shingles", "set_key", "signature", "brief"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            texts = [t or b"" for t in text_bytes(batch.column(1))]
            sizes, keys, sigs, briefs = [], [], [], []
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                sets = [shingles(t) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full).view(np.int32) if full else ())
                for s in sets:
                    sizes.append(len(s))
                    row = next(rows) if len(s) else None
                    sigs.append(row)
                    keys.append(None if row is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    briefs.append(None if row is None else row.astype(np.uint8).tobytes() + sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(briefs, pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature array<int>, brief binary")


def posted(classes: DataFrame) -> DataFrame:
    """(code, node): every class under the rarest of the coordinate-value pairs that it shares."""
    code = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    values = classes.select(F.posexplode("signature").alias("i", "v"), "node").select(code.alias("code"), "node")
    shared = values.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")
    # By frequency, then by code: one order for all classes.
    own = W.partitionBy("node")
    order = own.orderBy("n", "code")
    ranked = values.join(shared, "code").select("code", "node", F.row_number().over(order).alias("rank"), F.lag("code").over(order).alias("before"), F.count("*").over(own).alias("s"))
    # A node of several sets may hold a pair twice.
    return ranked.filter((F.col("rank") <= F.col("s") - (MATCHES - 1)) & ~F.col("before").eqNullSafe(F.col("code"))).select("code", "node")


def compressed(texts: DataFrame) -> DataFrame:
    """(node, text): texts, which move once for each open posting, as compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t) for t in text_bytes(batch.column(1))], pa.binary())], names=["node", "text"])

    return texts.mapInArrow(run, "node long, text binary")


def similar(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray | None] = (None, None)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in short(batches, 2):
            keep = []
            for x, y in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True):
                if last[0] != x:
                    last = (x, shingles(unpack(x)))
                s, t = last[1], shingles(unpack(y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _read(briefs: list[bytes], coordinates: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Low signature bytes, a row each, and sketches."""
    flat = [np.frombuffer(b, np.uint8) for b in briefs]
    return np.stack([b[:coordinates] for b in flat]), [np.ascontiguousarray(b[coordinates:]).view(np.uint64) for b in flat]


def near_hubs(pairs: DataFrame, briefs: DataFrame, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(a, b): of each a's pairs with hubs that may be links, the closest. Briefs without signature bytes: 0 coordinates, 0 matches."""
    one = briefs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("brief").alias("p"))
    two = briefs.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("brief").alias("q"))
    rows = pairs.join(one, "a").join(two, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 4):
            n, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                (p, x), (q, y) = _read(batch.column(4).to_pylist(), coordinates), _read(batch.column(5).to_pylist(), coordinates)
                n = (p == q).sum(axis=1)
                far = np.array([int(apart(s, t)) for s, t in zip(x, y, strict=True)])
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = pa.array((n >= matches) & ((100 - percent) * both >= (100 + percent) * far))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(far / np.maximum(both, 1)).filter(keep)], names=["a", "b", "far"])

    found = rows.select("a", "b", "n_a", "n_b", "p", "q").mapInArrow(run, "a long, b long, far double")
    return found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", "x.b")


class Cell:
    """Members of a posting that meet in one task: `asking` ones are held against `asked` ones of other components."""

    def __init__(self, node: np.ndarray, root: np.ndarray, n: np.ndarray, briefs: list[bytes], asking: np.ndarray, asked: np.ndarray, main: np.ndarray, coordinates: int = COORDINATES, matches: int = MATCHES) -> None:
        self.matches = matches
        self.node, self.root, self.n, self.asking, self.asked, self.main = node, root, n, asking, asked, main
        self.low, sketches = _read(briefs, coordinates)
        # Sketches of one width stand in one table.
        width = np.array([len(s) for s in sketches])
        self.tables = [(w, np.stack([sketches[i] for i in np.flatnonzero(width == w)])) for w in np.unique(width).tolist()]
        self.width, self.place = width, np.empty(len(node), np.int64)
        for w, table_ in self.tables:
            self.place[width == w] = np.arange(len(table_))

    def near(self, x: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be linked with row x, and how far apart they are for their size. Two members outside the
        largest component meet twice; the one of the greater node asks."""
        fits = self.asked & (self.root != self.root[x]) & (100 * np.minimum(self.n, self.n[x]) >= percent * np.maximum(self.n, self.n[x]))
        at = np.flatnonzero(fits & ((self.root == self.main) | (self.node < self.node[x])))
        at = at[(self.low[at] == self.low[x]).sum(axis=1) >= self.matches]
        far = np.zeros(len(at), np.int64)
        own = next(t for w, t in self.tables if w == self.width[x])[self.place[x]]
        for w, rows in self.tables:
            here = self.width[at] == w
            if here.any():
                far[here] = apart(own, rows[self.place[at[here]]])
        both = self.n[at] + self.n[x]
        keep = (100 - percent) * both >= (100 + percent) * far
        return at[keep], far[keep] / both[keep]

    def pairs(self, best: int, percent: int = 75) -> Iterator[tuple[int, int, bool]]:
        """(asking node, asked node, whether there were more): the `best` closest pairs of a member with a component; 0: all."""
        for x in np.flatnonzero(self.asking).tolist():
            at, far = self.near(x, percent)
            if not len(at):
                continue
            by = np.lexsort((far, self.root[at]))
            at = at[by]
            first = np.flatnonzero(np.concatenate([[True], np.diff(self.root[at]) != 0]))
            size = np.diff(np.append(first, len(at)))
            rank = np.arange(len(at)) - np.repeat(first, size)
            for y, k, m in zip(self.node[at].tolist(), rank.tolist(), np.repeat(size, size).tolist(), strict=True):
                if not best or k < best:
                    yield int(self.node[x]), y, bool(best and m > best)


def open_postings(placed: DataFrame) -> DataFrame:
    """(code, main, outside, total): postings with members in several components, the largest of them, members outside
    it and all members. placed: code, node, root."""
    parts = placed.groupBy("code", "root").agg(F.count("*").alias("k"))
    found = parts.groupBy("code").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("parts"), F.sum("k").alias("total"))
    return found.filter("parts > 1").select("code", F.col("m.root").alias("main"), (F.col("total") - F.col("m.k")).alias("outside"), "total")


def near_in_postings(placed: DataFrame, briefs: DataFrame, best: int, cell_rows: int = CELL_ROWS, *, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(code, a, b, more): pairs of different components within a posting that may be links, as `Cell.pairs` gives them."""
    side = lambda n: F.ceil(F.col(n) / cell_rows).cast("int")
    rows = placed.join(open_postings(placed), "code").withColumn("out", F.col("root") != F.col("main"))
    rows = rows.select("code", "node", "root", "main", "out", side("outside").alias("no"), side("total").alias("na"))
    rows = rows.withColumn("o", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("no")).cast("int")).withColumn("p", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("na")).cast("int"))
    # As one that is asked a member goes to the cells of all who ask; as one that asks, to the cells of all others.
    asked = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda i: F.struct(i.alias("o"), F.col("p").alias("p"), (F.col("out") & (i == F.col("o"))).alias("asking"), F.lit(True).alias("asked")))
    asks = F.transform(F.filter(F.sequence(F.lit(0), F.col("na") - 1), lambda i: F.col("out") & (i != F.col("p"))), lambda i: F.struct(F.col("o").alias("o"), i.alias("p"), F.lit(True).alias("asking"), F.lit(False).alias("asked")))
    rows = rows.select("code", "node", "root", "main", F.explode(F.concat(asked, asks)).alias("c")).join(briefs, "node")
    rows = rows.select("code", "c.o", "c.p", "node", "root", "main", "n", "c.asking", "c.asked", "brief").repartition("code", "o", "p").sortWithinPartitions("code", "o", "p")

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        root, n, main, node = (t.column(c).to_numpy() for c in ("root", "n", "main", "node"))
        cell = Cell(node, root, n, t.column("brief").to_pylist(), t.column("asking").to_numpy(), t.column("asked").to_numpy(), main, coordinates, matches)
        code, out = t.column("code")[0].as_py(), []
        for pair in cell.pairs(best, percent):
            out.append((code, *pair))
            if len(out) == 65_536:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and key != tuple(keys[a].tolist()):
                    yield from solve(held)
                    held = []
                key = tuple(keys[a].tolist())
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(held)

    return rows.mapInArrow(run, "code long, a long, b long, more boolean")


def _pairs(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["code", "a", "b", "more"])


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every linked node but the roots, by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.join(least, "a")
        out = moved.filter("b > a").select("b", "m") if large else moved.select("b", "m").union(least)
        return out.toDF("a", "b").filter("a != b").distinct()

    edges, k = scratch.write(links.select("a", "b"), f"{name}-0"), 0
    while True:
        edges, k = scratch.write(star(star(edges, True), False), f"{name}-{k + 1}"), k + 1
        # Done when every node has one root and no root has one.
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("id").agg(F.sum("low").alias("low"), F.max("high").alias("high")).filter("low > 1 OR (low > 0 AND high > 0)")
        if open_.isEmpty():
            return edges.toDF("node", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(prepared(docs), "rows")
    known = rows.filter("set_key is not null and doc_id is not null")
    first = lambda c: F.first(c).alias(c)
    classes = scratch.write(known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), first("signature"), first("brief")), "classes")
    free_shuffles(spark)
    every = scratch.write(posted(classes), "every")
    free_shuffles(spark)
    # Postings of the same members are one: copies share dozens.
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    members = every.groupBy("code").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size"), mark(1).alias("m1"), mark(2).alias("m2")).filter("hub < last")
    one = members.groupBy("hub", "size", "m1", "m2").agg(F.min("code").alias("code")).select("code", "hub")
    postings = scratch.write(every.join(one, "code"), "postings")
    scratch.drop("every")
    # Sketches and texts of the classes that share a posting.
    taking = scratch.write(postings.select("node").distinct(), "taking")
    briefs = scratch.write(classes.join(taking, "node", "left_semi").select("node", "n", "brief"), "briefs")
    # Of the rows of a class any one will do: all have the same set.
    texts = scratch.write(compressed(docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("node"), "text")).join(taking, "node").dropDuplicates(), "texts")
    free_shuffles(spark)
    # A doc_id with several sets ties their classes together.
    of_doc = known.join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    tied = of_doc.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last")
    of_doc = of_doc.join(tied, "doc_id").filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    hubs = postings.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = scratch.write(similar(near_hubs(hubs, briefs), texts).union(of_doc), "links-0")
    free_shuffles(spark)
    roots = components(scratch, links, "parts-0")
    codes = None
    for k, best in ((1, BEST), (2, 0)):
        # Postings whose members are not one component yet; in the end those that had more pairs than were confirmed.
        placed = postings if codes is None else postings.join(codes, "code", "left_semi")
        placed = scratch.write(placed.join(roots, "node", "left").select("code", "node", F.coalesce("root", "node").alias("root")), f"placed-{k}")
        near = scratch.write(near_in_postings(placed, briefs, best), f"near-{k}")
        links = scratch.write(similar(near.select("a", "b").distinct(), texts), f"links-{k}")
        free_shuffles(spark)
        if not links.isEmpty():
            roots = components(scratch, roots.toDF("a", "b").union(links), f"parts-{k}")
        codes = near.filter("more").select("code").distinct()
        if codes.isEmpty():
            break
    scratch.drop("postings", "taking", "briefs", "texts", "placed-1", "near-1", "placed-2", "near-2")
    rep = classes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("root"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(rep, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
