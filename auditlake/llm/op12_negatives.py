"""Operator 12, hard negatives by dual-tree search.

A target asks for the K best rows by integer inner product with its vector, among rows of its label or of other
labels, with a score between two bounds. Both sides stand in trees: a top tree, fitted on at most SAMPLE rows,
deals rows into cells; a cell's rows are dealt into shards, its targets into blocks, and each shard and block has
a tree of its own, whose nodes hold a centre, a radius, and the least and greatest label. A pair of nodes bounds
all inner products between them: (centre . centre) +- (|c| r' + |c'| r + r r'). Pairs that can't reach what every
target of a node has already, lie outside of all of its bounds, or can't hold a wanted label are dropped with
all rows below; pairs of leaves are scored exactly. A block is first held against one shard of its own cell, whose
scores are the floor for the rest; then it visits the shards of all cells that its bounds leave.

Vectors that no bound tells apart are scored one by one: the search is exact, whatever the data.

`hard_negatives` takes positives (the first 5 rows of an anchor's label) and, for each, the first 10 rows of
other labels in the band of its score. Rows with a null label, a null vector or a null or non-finite component
take no part. A null id is last among ties and is no anchor; rows that repeat an id are rows of their own (each
an anchor where the id is one, and a positive of the other); vectors of different lengths are filled up with
zeros; an empty table gives an empty result; other columns are not read. Scores are exact: 32-bit floats,
64-bit floats or whole numbers of any size by the vectors' norms; one beyond a long is given as the nearest long."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, importable, table

#: Rows the top tree is fitted on, chosen by hash; its cells, at most.
SAMPLE = 8192
MAX_CELLS = 256
#: Rows of a shard, targets of a block.
SHARD_ROWS = 16384
BLOCK_ROWS = 1024
LEAF_ROWS, LEAF_TARGETS = 128, 32
#: Candidate leaves that are scored together.
LEAVES = 16
SCALE = 256
NO_ID = (1 << 63) - 1
#: Bounds of scores, for targets that have none. Whole numbers that 64-bit floats hold.
LEAST, GREATEST = -(1 << 62), 1 << 62

ROW = "row long, id long, label long, vector binary"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as 32-bit floats where those hold them."""
    narrow = not x.size or np.abs(x).max() <= 1 << 24
    return b"4" + x.astype("<f4").tobytes() if narrow else b"8" + x.astype("<f8").tobytes()


def components(v: bytes) -> np.ndarray:
    return np.frombuffer(v, "<f4" if v[:1] == b"4" else "<f8", offset=1).astype(np.float64)


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row (a number of its own), id, label and vector (floors of SCALE times each component) of rows that take part."""
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    held = rows.filter(F.col(label).isNotNull()).filter(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            with np.errstate(over="ignore"):
                flat = np.nan_to_num(np.floor(SCALE * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)))
            at = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([packed(flat[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["row", "id", "label", "vector"])

    return held.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>")).mapInArrow(run, ROW)


def matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    flat = [components(v) for v in vectors]
    width = max([width, *map(len, flat)])
    out = np.zeros((len(flat), width))
    for i, v in enumerate(flat):
        out[i, : len(v)] = v
    return out


def _same_width(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(x.shape[1], y.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))


def halves(x: np.ndarray) -> tuple[int, float, np.ndarray]:
    """The dimension in which rows differ most, where to cut it, and who lies below: at the widest gap of the middle half
    of the values, so that what lies together stays together. All lie below if that dimension has one value there."""
    d = int(np.argmax(x.max(axis=0) - x.min(axis=0))) if x.shape[1] else 0
    values = x[:, d] if x.shape[1] else np.zeros(len(x))
    middle = np.sort(values)[len(x) // 4 : len(x) - len(x) // 4]
    gaps = np.diff(middle)
    at = int(np.argmax(gaps)) if len(gaps) else 0
    cut = float(middle[at])
    return d, cut, values <= cut


class Tree:
    """Rows in the order of leaves, and nodes: bounds of rows, children, centre, radius, labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(x))
        begin, end, left, right, centre, radius, low, high = ([] for _ in range(8))

        def grow(a: int, b: int) -> int:
            at, own = len(begin), self.order[a:b]
            rows = x[own]
            mid = rows.mean(axis=0)
            begin.append(a), end.append(b), left.append(-1), right.append(-1), centre.append(mid)
            radius.append(float(norms(rows - mid).max()))
            low.append(int(labels[own].min())), high.append(int(labels[own].max()))
            if b - a > leaf:
                _, _, below = halves(rows)
                if below.all() or not below.any():  # no gap: any halves do
                    below = np.arange(b - a) < (b - a) // 2
                self.order[a:b] = np.concatenate([own[below], own[~below]])
                cut = a + int(below.sum())
                left[at], right[at] = grow(a, cut), grow(cut, b)
            return at

        grow(0, len(x))
        self.begin, self.end, self.left, self.right, self.low, self.high = (np.array(v, np.int64) for v in (begin, end, left, right, low, high))
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.norm = norms(self.centre)


def intervals(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between nodes i of a and j of b, with room for rounding."""
    both = min(a.centre.shape[1], b.centre.shape[1])
    mid = np.einsum("ij,ij->i", a.centre[i, :both], b.centre[j, :both])
    wide = a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
    wide += 1 + 1e-9 * (wide + a.norm[i] * b.norm[j])
    return mid - wide, mid + wide


class Block:
    """Targets: vectors that several may share, and for each target its row, label, whether it asks for its own
    label, its bounds, and the least score that is still of use."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray, of: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray) -> None:
        self.x, self.rows, self.labels, self.of, self.same, self.low, self.high = x, rows, labels, of, same, low, high
        self.floor = np.maximum(low, floor)
        self.tree = Tree(x, labels, LEAF_TARGETS)
        self.asks = [np.flatnonzero(of == v) for v in range(len(x))]

    def under(self, node: int) -> np.ndarray:
        """Targets of a node."""
        t = self.tree
        return np.concatenate([self.asks[v] for v in t.order[t.begin[node] : t.end[node]]])


def search(block: Block, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, tree: Tree, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, place of row, score): the k best rows for each target; fewer where rows can't be among the k best of all."""
    a = block.tree
    own = [block.under(i) for i in range(len(a.begin))]
    floor = block.floor.copy()
    low = np.array([floor[t].min() for t in own])
    high = np.array([block.high[t].max() for t in own])
    same, other = np.array([block.same[t].any() for t in own]), np.array([(~block.same[t]).any() for t in own])
    block_x, x = _same_width(block.x, x)
    dtype = exact(norms(block_x).max(), norms(x).max())

    def left_over(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, most = intervals(a, i, tree, j)
        held = (a.low[i] <= tree.high[j]) & (tree.low[j] <= a.high[i])
        one = (a.low[i] == a.high[i]) & (tree.low[j] == tree.high[j]) & (a.low[i] == tree.low[j])
        return ~(most < low[i]) & ~(least > high[i]) & ((same[i] & held) | (other[i] & ~one)), most

    # Pairs of nodes, a level at a time.
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves_i, leaves_j, bounds = [], [], []
    while len(i):
        keep, most = left_over(i, j)
        i, j, most = i[keep], j[keep], most[keep]
        done = (a.left[i] < 0) & (tree.left[j] < 0)
        leaves_i.append(i[done]), leaves_j.append(j[done]), bounds.append(most[done])
        i, j = i[~done], j[~done]
        first = (a.left[i] >= 0) & ((tree.left[j] < 0) | (a.radius[i] >= tree.radius[j]))
        x_, y_ = i[first], j[first]
        z_, w_ = i[~first], j[~first]
        i = np.concatenate([a.left[x_], a.right[x_], z_, z_])
        j = np.concatenate([y_, y_, tree.left[w_], tree.right[w_]])
    i, j, most = np.concatenate(leaves_i), np.concatenate(leaves_j), np.concatenate(bounds)
    found = [(np.empty(0, np.int64),) * 3]
    for node in np.unique(i).tolist():
        mine, bound = j[i == node], most[i == node]
        by = np.argsort(-bound, kind="stable")
        mine, bound, targets = mine[by], bound[by], own[node]
        vectors, of = np.unique(block.of[targets], return_inverse=True)
        best = (np.empty(0, np.int64),) * 3
        for s in range(0, len(mine), LEAVES):
            if bound[s] < floor[targets].min():
                break
            at = np.concatenate([tree.order[tree.begin[m] : tree.end[m]] for m in mine[s : s + LEAVES].tolist()])
            score = scores(block_x[vectors], x[at], dtype)[of]
            fits = (score >= floor[targets][:, None]) & (score <= block.high[targets][:, None])
            fits &= (labels[at][None, :] == block.labels[block.of[targets]][:, None]) == block.same[targets][:, None]
            fits &= rows[at][None, :] != block.rows[block.of[targets]][:, None]
            t, p = np.nonzero(fits)
            best = first_k(np.concatenate([best[0], t]), np.concatenate([best[1], at[p]]), np.concatenate([best[2], score[t, p].astype(np.int64)]), ids, rows, k)
            # A target that has k rows takes nothing below the last of them.
            full, last = np.unique(best[0][::-1], return_index=True)
            enough = np.bincount(best[0], minlength=len(targets))[full] == k
            floor[targets[full[enough]]] = np.maximum(floor[targets[full[enough]]], best[2][::-1][last[enough]])
        found.append((targets[best[0]], best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def exact(x: float, y: float) -> type:
    """The narrowest type that holds inner products of whole vectors of these norms, and all sums on the way."""
    most = x * y * 1.01 + 1
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(axis=1))


def scores(x: np.ndarray, y: np.ndarray, dtype: type) -> np.ndarray:
    if dtype is not object:
        return x.astype(dtype) @ y.astype(dtype).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(x) @ whole(y).T, -NO_ID, NO_ID).astype(np.int64) if x.shape[1] else np.zeros((len(x), len(y)), np.int64)


def first_k(target: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each target: higher scores, smaller ids, then rows."""
    by = np.lexsort((rows[place], ids[place], -score, target))
    t = target[by]
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
    rank = np.arange(len(t)) - np.repeat(start, np.diff(np.append(start, len(t))))
    by = by[rank < k]
    return target[by], place[by], score[by]


class Cells:
    """The top tree: cuts of single dimensions, and a centre for each cell."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.cuts: list[tuple[int, float, int, int]] = []
        centres: list[np.ndarray] = []

        def grow(x: np.ndarray, cells: int) -> int:
            if cells > 1 and len(x) > 1:
                d, cut, below = halves(x)
                if not below.all():
                    at = len(self.cuts)
                    self.cuts.append((d, cut, 0, 0))
                    # Rows lie below a cut that is the next value of the sample.
                    cut = float(x[~below, d].min())
                    self.cuts[at] = (d, cut, grow(x[below], cells // 2), grow(x[~below], cells - cells // 2))
                    return at
            centres.append(x.mean(axis=0))
            return -len(centres)

        self.root = grow(sample if len(sample) else np.zeros((1, sample.shape[1])), cells)
        self.centres = np.array(centres)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Each row's cell."""
        out = np.empty(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
            else:
                d, cut, below, rest = self.cuts[node]
                low = (x[at, d] if d < x.shape[1] else np.zeros(len(at))) < cut
                todo += [(below, at[low]), (rest, at[~low])]
        return out


def with_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """The rows with their cell and how far they are from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = _same_width(matrix(batch.column(3).to_pylist()), cells.centres)
                cell = cells.of(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(norms(x - c[cell]), pa.float64())], names=[*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(run, f"{ROW}, cell int, away double")


def dealt(rows: DataFrame, parts: list[int], by: str) -> DataFrame:
    """The rows with the part of their cell that they are dealt to, and in its order."""
    many = F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)
    return rows.withColumn("part", F.pmod(F.xxhash64(by), many).cast("int")).repartition("cell", "part").sortWithinPartitions("cell", "part", by)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell and part each; these come first among the columns."""
    key, held = None, []
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and key != tuple(keys[a]):
                    yield pa.Table.from_batches(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def shards(placed: DataFrame, parts: list[int]) -> DataFrame:
    """cell, part, numbers (row, id and label of each row), vectors (width first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            x = matrix(t.column("vector").to_pylist())
            numbers = np.stack([t.column(c).to_numpy() for c in ("row", "id", "label")])
            yield pa.RecordBatch.from_arrays([t.column("cell").combine_chunks()[:1], t.column("part").combine_chunks()[:1], pa.array([numbers.tobytes()]), pa.array([x.shape[1]], pa.int32()), pa.array([packed(x)])], names=["cell", "part", "numbers", "width", "vectors"])

    return dealt(placed, parts, "row").select("cell", "part", "row", "id", "label", "vector").mapInArrow(run, "cell int, part int, numbers binary, width int, vectors binary")


#: What a target has beside its vector.
TARGET = ("target", "row", "label", "same", "low", "high", "floor")


def blocks(targets: DataFrame, parts: list[int]) -> DataFrame:
    """cell, part, asked (the numbers of TARGET for each target), width, vectors (one a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            asked = np.stack([t.column(c).to_numpy() for c in TARGET])
            _, first = np.unique(asked[1], return_index=True)
            vectors = t.column("vector")
            x = matrix([vectors[i].as_py() for i in first.tolist()])
            yield pa.RecordBatch.from_arrays([t.column("cell").combine_chunks()[:1], t.column("part").combine_chunks()[:1], pa.array([asked.tobytes()]), pa.array([x.shape[1]], pa.int32()), pa.array([packed(x)])], names=["cell", "part", "asked", "width", "vectors"])

    return dealt(targets, parts, "row").select("cell", "part", *TARGET, "vector").mapInArrow(run, "cell int, part int, asked binary, width int, vectors binary")


def _read(numbers: bytes, count: int, width: int, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = components(vectors)
    n = np.frombuffer(numbers, np.int64).reshape(count, -1)
    return n, x.reshape(-1, width) if width else np.zeros((len(np.unique(n[1])) if count == len(TARGET) else n.shape[1], 0))


@lru_cache(2)
def _block(asked: bytes, width: int, vectors: bytes) -> Block:
    (_, row, label, same, low, high, floor), x = _read(asked, len(TARGET), width, vectors)
    rows, first, of = np.unique(row, return_index=True, return_inverse=True)
    return Block(x, rows, label[first], of, same.astype(bool), low, high, floor)


def to_visit(held: DataFrame, cells: Cells, radius: np.ndarray) -> DataFrame:
    """The blocks with `cells`: those that may hold a row for a target of theirs. Drops a block from a cell with all of its targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for asked, width, vectors in zip(*(batch.column(c).to_pylist() for c in ("asked", "width", "vectors")), strict=True):
                n, x = _read(asked, len(TARGET), width, vectors)
                x, c = _same_width(x, cells.centres)
                mid = x.mean(axis=0)
                r, size = norms(x - mid).max(), norms(mid[None])[0]
                wide = size * radius + norms(c) * r + r * radius
                wide += 1 + 1e-9 * (wide + size * norms(c))
                near = c @ mid
                keep = ~(near + wide < np.maximum(n[4], n[6]).min()) & ~(near - wide > n[5].max()) & (radius >= 0)
                found.append(np.flatnonzero(keep).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return held.mapInArrow(run, "cell int, part int, asked binary, width int, vectors binary, cells array<int>")


FOUND = "target long, id long, row long, score long"


def visited(visits: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """FOUND: what each visit (a block's columns, to_cell, to_part) adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            for cell, part, asked, width, vectors, numbers, wide, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, part) != key:
                    (rows, ids, labels), x = _read(numbers, 3, wide, other)
                    key, shard = (cell, part), (x, ids, rows, labels, Tree(x, labels, LEAF_ROWS))
                block = _block(asked, width, vectors)
                t, p, s = search(block, *shard, k)
                target = np.frombuffer(asked, np.int64).reshape(len(TARGET), -1)[0]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (target[t], shard[1][p], shard[2][p], s)], names=["target", "id", "row", "score"])

    there = held.select(F.col("cell").alias("to_cell"), F.col("part").alias("to_part"), "numbers", F.col("width").alias("wide"), F.col("vectors").alias("other"))
    return visits.join(there, ["to_cell", "to_part"]).select("to_cell", "to_part", "asked", "width", "vectors", "numbers", "wide", "other").mapInArrow(run, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each target, with their rank."""
    order = W.partitionBy("target").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Index:
    """All rows in cells and shards."""

    def __init__(self, rows: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> None:
        importable(rows.sparkSession)
        self.scratch, self.block_rows, self.k = scratch, block_rows, 0
        self.rows = scratch.write(rows, "rows")
        n = self.rows.count()
        sample = self.rows.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").collect()
        self.cells = Cells(matrix([bytes(r.vector) for r in sample]) if sample else np.zeros((0, 0)), min(MAX_CELLS, max(1, -(-n // shard_rows))))
        self.placed = scratch.write(with_cells(self.rows, self.cells), "placed")
        count, self.radius = np.zeros(len(self.cells.centres), np.int64), np.full(len(self.cells.centres), -1.0)
        for r in self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
            count[r.cell], self.radius[r.cell] = r.n, r.away
        self.parts = np.maximum(1, -(-count // shard_rows)).tolist()
        self.shards = scratch.write(shards(self.placed, self.parts), "shards")

    def best(self, targets: DataFrame, k: int) -> DataFrame:
        """target, id, row, score, rank. targets: target, row, cell, label, vector, same (1: of its own label, 0: of others), low, high."""
        self.k += 1
        targets = targets.withColumn("floor", F.lit(LEAST))
        count = [0] * len(self.parts)
        for r in targets.groupBy("cell").agg(F.count("*").alias("n")).collect():
            count[r.cell] = r.n
        parts = [max(1, -(-n // self.block_rows)) for n in count]
        shards_of = F.element_at(F.array(*map(F.lit, self.parts)), F.col("to_cell") + 1)
        first = blocks(targets, parts).withColumn("to_cell", F.col("cell")).withColumn("to_part", F.pmod("part", shards_of))
        seeds = first_of(visited(first, self.shards, k), k).groupBy("target").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        seeds = self.scratch.write(seeds.select("target", "least"), f"seeds-{self.k}")
        targets = targets.join(seeds, "target", "left").withColumn("floor", F.coalesce("least", "floor"))
        held = to_visit(blocks(targets, parts), self.cells, self.radius)
        visits = held.select("asked", "width", "vectors", F.explode("cells").alias("to_cell"))
        visits = visits.select("*", F.explode(F.sequence(F.lit(0), shards_of - 1)).alias("to_part"))
        return self.scratch.write(first_of(visited(visits, self.shards, k), k), f"best-{self.k}")


def hard_negatives(rows: DataFrame, is_anchor: str, scratch: Scratch, positives: int = 5, negatives: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: as `prepared` gives them;
    is_anchor: a condition on `id`."""
    index = Index(rows, scratch, shard_rows, block_rows)
    anchors = index.placed.filter(F.col("id") != NO_ID).filter(is_anchor)
    near = index.best(anchors.select(F.col("row").alias("target"), "row", "cell", "label", "vector", F.lit(1).cast("long").alias("same"), F.lit(LEAST).alias("low"), F.lit(GREATEST).alias("high")), positives)
    pairs = scratch.write(near.select((F.col("target") * positives + F.col("rank") - 1).alias("pair"), F.col("target").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "pairs")
    whole, rest = F.expr("positive_score div 10"), F.expr("positive_score % 10")
    band = pairs.select(F.col("pair").alias("target"), "row", (3 * whole + F.ceil(3 * rest / 10)).cast("long").alias("low"), (9 * whole + F.floor(9 * rest / 10)).cast("long").alias("high"))
    wanted = band.filter("low <= high").join(anchors.select("row", "cell", "label", "vector"), "row")
    found = index.best(wanted.withColumn("same", F.lit(0).cast("long")), negatives)
    ids = anchors.select("row", F.col("id").alias("anchor_id"))
    out = found.select(F.col("target").alias("pair"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, "pair").join(ids, "row")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select("anchor_id", real("positive_id"), F.col("rank").cast("int").alias("rank"), real("negative_id"), "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """The contract's noise: one label in seven is another."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(relabelled(table(spark, sf_dir, "embeddings")))
    return hard_negatives(rows, "id % 100 = 0", Scratch(spark))
