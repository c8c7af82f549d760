"""Operator 4, suffix-array dedup: removes every byte covered by a 200-byte string that starts anywhere
else too.

The suffixes that matter are found first. In each 200-byte window the ANCHOR-byte string of least hash is
its anchor; equal windows have equal anchors at equal places, so only suffixes that start at an anchor
that occurs twice are compared at all. Anchors that occur in equal surroundings (all bytes that a window
around them can hold) are repeated as a whole. Of the others, one per surrounding is sorted with those of
its anchor: the suffixes that start there, and the reversed prefixes that end there. Deep-shallow sorting
orders them: a multikey quicksort (three-way partition about a pivot, eight bytes a step and all groups at
once) to a shallow depth; then blind tries for the groups that still have a common prefix. Neighbours'
common prefix lengths, compared byte by byte, then tell, for each place of the window around the anchor,
which suffixes and prefixes agree far enough.

Equal surroundings are told by 192 bits of hashes (of the anchor, and two of the surroundings), rows by a
128-bit digest of doc_id and text.

A group of more surroundings than MAX_GROUP is dealt out by whole windows instead, so no group has to fit
one task. A null text counts as empty; a repeated row is another copy of its text; texts have no length
limit; a null doc_id is a value like any other; an empty table gives an empty result; other columns are
not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, importable, short, table, text_bytes

WINDOW = 200
ANCHOR = 40
#: Anchor places of a window.
SPAN = WINDOW - ANCHOR + 1
#: Windows of text handled at once.
CHUNK = 1 << 18
#: Bytes sorted by multikey quicksort before blind tries take over.
SHALLOW = 48
#: Surroundings of one anchor that are sorted in one task; and of all anchors sorted at once.
MAX_GROUP = 20_000
SORT_ROWS = 20_000

_BYTE = np.random.default_rng(40).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(CHUNK * 4 - 1)


def anchor_hashes(block: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place, by doubling: 1, 2, 4, 8, 16, 32, then 32 + 8."""
    h, eight = _BYTE[block], None
    span = 1
    while span < 32:
        h = h[:-span] * _M1 + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
        if span == 8:
            eight = h
    n = len(block) - ANCHOR + 1
    out = h[:n] * _M2 + eight[32 : 32 + n]
    out ^= out >> np.uint64(32)
    out *= _M2
    return out ^ (out >> np.uint64(31))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours, from minima that run forward and backward in blocks."""
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - width + 1], ahead[width - 1 : len(x)])


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])


_UP = powers(_M1, 2 * CHUNK)
_DOWN = powers(np.uint64(pow(int(_M1), -1, 1 << 64)), 2 * CHUNK)
#: Of a second, independent hash.
_BYTE_2 = np.random.default_rng(41).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UP_2, _DOWN_2 = powers(_M2, 2 * CHUNK), powers(np.uint64(pow(int(_M2), -1, 1 << 64)), 2 * CHUNK)


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, tail, hash, context, second) of every anchor of the texts' windows."""
    group: list[int] = []
    size = 0

    def found() -> tuple[np.ndarray, ...]:
        block = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        sizes = np.array([len(texts[i]) for i in group])
        return _anchors(block, np.array(group), sizes, 0, 0, len(block))

    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        if len(t) > CHUNK:
            whole = np.frombuffer(t, np.uint8)
            for a in range(0, len(t) - WINDOW + 1, CHUNK):
                # With all bytes that a window about an anchor of these windows can hold.
                low, high = max(0, a - WINDOW), min(len(t), a + CHUNK + 2 * WINDOW)
                yield _anchors(whole[low:high], np.array([i]), np.array([high - low]), low, a - low, a - low + CHUNK)
            continue
        if size + len(t) > CHUNK:
            yield found()
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield found()


def _anchors(block: np.ndarray, owners: np.ndarray, sizes: np.ndarray, base: int, first: int, end: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that start in first..end - 1 of a block of texts; `base`: bytes of its text before the block."""
    h = anchor_hashes(block)
    # The low bits hold the place, so of equal hashes the leftmost is least.
    least = window_minima((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), SPAN)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside = np.ones(len(least), bool)
    inside[:first] = inside[end:] = False
    for e in ends[:-1]:
        inside[max(0, e - WINDOW + 1) : e] = False
    at = np.unique((least[inside] & _LOW).astype(np.int64))
    if first:
        # The chunk before has this one: an anchor of windows on both sides of a cut is that of the last window before it.
        at = at[at != int(least[first - 1] & _LOW)]
    own = np.searchsorted(ends, at, "right")
    low, high = np.maximum(starts[own], at - SPAN + 1), np.minimum(ends[own], at + WINDOW)
    # A hash of the surroundings, and of the anchor's place in them.
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[block] * _UP[: len(block)])])
    context = ((sums[high] - sums[low]) * _DOWN[low] + (at - low).astype(np.uint64)) * _M2
    context ^= context >> np.uint64(32)
    context = (context * _M1) ^ (high - low).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_2[block] * _UP_2[: len(block)])])
    second = (sums[high] - sums[low]) * _DOWN_2[low]
    return owners[own], at - starts[own] + base, high - at, h[at].view(np.int64), context.view(np.int64), second.view(np.int64)


def row_key() -> F.Column:
    """Rows are known by doc_id and text, so equal rows share a key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce("text", F.lit("")))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def all_anchors(docs: DataFrame) -> DataFrame:
    """(key, place, tail, hash, context, second): `tail` bytes of the text from the anchor on, at most a window."""
    names = ["key", "place", "tail", "hash", "context", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            for own, at, tail, h, context, second in anchors(text_bytes(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(at, pa.int64()), pa.array(tail.astype(np.int32)), pa.array(h), pa.array(context), pa.array(second)], names=names)

    return _keyed(docs).mapInArrow(run, "key binary, place long, tail int, hash long, context long, second long")


def surroundings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(hash, key, place, left, around, once, big) of the anchors in `places` (key, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "key", "place", "left", "around", "once", "big"]
        for batch in short(batches, 1):
            for i, text in enumerate(text_bytes(batch.column(1))):
                key, found = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                for a in range(0, len(found), 2000):
                    part = found[a : a + 2000]
                    at = [x["place"] for x in part]
                    left = [min(p, SPAN - 1) for p in at]
                    around = [text[p - n : p + WINDOW] for p, n in zip(at, left, strict=True)]
                    cols = [pa.array([x["hash"] for x in part], pa.int64()), pa.array([key] * len(part), pa.binary()), pa.array(at, pa.int64()), pa.array(left, pa.int32()), pa.array(around, pa.binary()), *(pa.array([x[c] for x in part], pa.bool_()) for c in ("once", "big"))]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return _keyed(docs).join(places, "key").select("key", "text", "found").mapInArrow(run, "hash long, key binary, place long, left int, around binary, once boolean, big boolean")


class BlindTrie:
    """Orders strings by a trie that keeps only branching depths and branching bytes. A string goes down
    blindly, is compared once with a string below, and enters where they part."""

    def __init__(self) -> None:
        self.root: list | None = None  # inner node: [depth, {byte: child}]; leaf: (string, row)

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = len(a)
        x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        return n - (x.bit_length() + 7) // 8

    def add(self, s: bytes, row: int) -> None:
        if self.root is None:
            self.root = [len(s), {-1: [(s, row)]}]
            return
        node = self.root
        path = []
        while node[0] < len(s):
            path.append(node)
            child = node[1].get(s[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        depth = self.common(s, node[1][-1][0][0])
        if depth >= len(s):
            node[1][-1].append((s, row))
            return
        leaf = [len(s), {-1: [(s, row)]}]
        parent = None
        node = self.root
        while node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return
        below = next(x for x in self._some(node))
        inner = [depth, {below[depth]: node, s[depth]: leaf}]
        if parent is None:
            self.root = inner
        else:
            parent[1][s[parent[0]]] = inner

    @staticmethod
    def _some(node: list) -> Iterator[bytes]:
        while -1 not in node[1]:
            node = next(iter(node[1].values()))
        yield node[1][-1][0][0]

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(row, common prefix with the one before), smallest string first."""
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if -1 in node[1]:
                for k, (s, row) in enumerate(node[1][-1]):
                    yield row, len(s) if k else shared
                continue
            for k, byte in reversed(list(enumerate(sorted(node[1])))):
                stack.append((node[1][byte], node[0] if k else shared))


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings (rows of bytes) within groups that stand together, and the common
    prefix of each with the one before it in that order (0 for the first of a group)."""
    n, width = strings.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[0], np.diff(group[order]) != 0]))
    depth = np.zeros(int(part[-1]) + 1, np.int64)
    # Multikey quicksort of all parts at once: rows below, equal to and above the part's pivot part ways, and equal ones go
    # on to their next eight bytes, until a part is one row or shallow depth is reached.
    while True:
        size = np.bincount(part)
        todo = np.flatnonzero(((size > 1) & (depth < SHALLOW // 8))[part])
        if not len(todo):
            break
        own = part[todo]
        word = words[order[todo], depth[own]]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = size[own[first]]
        three = np.sort(np.stack([word[first], word[first + count // 2], word[first + count - 1]]), axis=0)
        pivot = np.repeat(three[1], count)
        side = (word > pivot).astype(np.int64) - (word < pivot) + 1
        by = np.argsort(own * 3 + side, kind="stable")
        order[todo], side = order[todo][by], side[by]
        # Parts are numbered anew; those of pivots are a word deeper.
        key = part * 3 + 1
        key[todo] = own * 3 + side
        deeper = depth[part]
        deeper[todo] += side == 1
        cut = np.concatenate([[True], key[1:] != key[:-1]])
        part, depth = np.cumsum(cut) - 1, deeper[cut]
    # Blind tries for what is still together.
    size = np.bincount(part)
    starts = np.cumsum(size) - size
    for p in np.flatnonzero(size > 1).tolist():
        a, b = int(starts[p]), int(starts[p] + size[p])
        trie = BlindTrie()
        for row in order[a:b].tolist():
            trie.add(strings[row].tobytes(), row)
        order[a:b] = [row for row, _ in trie.ordered()]
    # Neighbours are compared byte by byte.
    common = np.zeros(n, np.int64)
    for a in range(1, n, 4096):
        x, y = strings[order[a : a + 4096]], strings[order[a - 1 : a + 4095][: len(order[a : a + 4096])]]
        differ = x != y
        common[a : a + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[np.flatnonzero(np.diff(group[order])) + 1] = 0
    return order, common


def repeated_windows(group: np.ndarray, left: np.ndarray, around: list[bytes]) -> np.ndarray:
    """[row, n]: does the window that starts n bytes before the row's anchor stand in another row of its
    group too, around the anchor at the same place?"""
    n = len(around)
    ahead, behind = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.uint8)
    right = np.empty(n, np.int64)
    for i, (s, k) in enumerate(zip(around, left.tolist(), strict=True)):
        x = np.frombuffer(s, np.uint8)
        right[i] = len(s) - k
        ahead[i, : right[i]] = x[k:]
        behind[i, :k] = x[:k][::-1]
    out = np.zeros((n, SPAN), bool)
    by_ahead, common_ahead = deep_shallow(group, ahead)
    by_behind, common_behind = deep_shallow(group, behind)
    first_ahead = np.concatenate([[True], np.diff(group[by_ahead]) != 0])
    first_behind = np.concatenate([[True], np.diff(group[by_behind]) != 0])
    suffix, prefix = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(SPAN):
        fits = (left >= k) & (right >= WINDOW - k)
        suffix[by_ahead] = np.cumsum(first_ahead | (common_ahead < WINDOW - k))
        prefix[by_behind] = np.cumsum(first_behind | (common_behind < k))
        rows = np.flatnonzero(fits)
        if len(rows) < 2:
            continue
        both = suffix[rows] * (n + 1) + prefix[rows]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        hit = np.zeros(len(rows), bool)
        hit[by[1:][same]] = hit[by[:-1][same]] = True
        out[rows[hit], k] = True
    return out


def _stretches(key: bytes, place: int, starts: np.ndarray) -> list[tuple[bytes, int, int]]:
    """(key, from, to) of the bytes of the windows that start `starts` bytes before a place."""
    at = place - np.flatnonzero(starts)[::-1]
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > WINDOW) + 1
    return [(key, int(x[0]), int(x[-1]) + WINDOW) for x in np.split(at, cut)]


def sorted_stretches(rows: DataFrame) -> DataFrame:
    """(key, start, end) of repeated windows about anchors; rows of an anchor stand together."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        # A row that is repeated has brought its anchors more than once.
        keys = t.column("key").to_pylist()
        ids = list(zip(t.column("hash").to_pylist(), keys, t.column("place").to_pylist(), strict=True))
        t = t.take(sorted({x: i for i, x in enumerate(ids)}.values()))
        group = np.unique(t.column("hash").to_numpy(), return_inverse=True)[1]
        hits = repeated_windows(group, t.column("left").to_numpy().astype(np.int64), t.column("around").to_pylist())
        out = [x for key, place, once, row in zip(t.column("key").to_pylist(), t.column("place").to_pylist(), t.column("once").to_pylist(), hits, strict=True) if once for x in _stretches(key, place, row)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            # A group may go on in the next batch: all before this batch's last group can be solved.
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            if cut or (held and held[-1].column(0)[-1].as_py() != h[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                if sum(b.num_rows for b in held) >= SORT_ROWS:
                    yield solve(held)
                    held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(held)

    return rows.mapInArrow(run, "key binary, start long, end long")


def windows(rows: DataFrame) -> DataFrame:
    """(window, key, start): a digest of every window about the anchors of very large groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, place, left, s in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "left", "around")), strict=True):
                at = range(max(0, len(s) - WINDOW + 1))
                digest = [hashlib.blake2b(s[i : i + WINDOW], digest_size=16).digest() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([key] * len(digest), pa.binary()), pa.array([place - left + i for i in at], pa.int64())], names=["window", "key", "start"])

    return rows.select("key", "place", "left", "around").mapInArrow(run, "window binary, key binary, start long")


def repeated_stretches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, cut): the stretches to remove from each row that has any."""
    every = scratch.write(all_anchors(docs), "anchors")
    twice = scratch.write(every.groupBy("hash").count().filter("count > 1").select("hash"), "twice")
    found = scratch.write(every.join(twice, "hash"), "found")
    scratch.drop("anchors", "twice")
    contexts = scratch.write(found.groupBy("hash", "context", "second").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("at")), "contexts")
    groups = scratch.write(contexts.groupBy("hash").agg(F.count("*").alias("size")).filter("size > 1"), "groups")
    # Repeated whole: every window within the surroundings.
    left = F.least("place", F.lit(SPAN - 1))
    again = contexts.filter("n > 1").select("hash", "context", "second")
    whole = found.filter(left + F.col("tail") >= WINDOW).join(again, ["hash", "context", "second"]).select("key", (F.col("place") - left).alias("start"), (F.col("place") + F.col("tail")).alias("end"))
    whole = scratch.write(whole, "whole")
    # One of each surroundings is sorted with the others of its anchor.
    chosen = contexts.join(groups, "hash").select("at.key", F.struct("at.place", "hash", (F.col("n") == 1).alias("once"), (F.col("size") > MAX_GROUP).alias("big")).alias("x"))
    near = scratch.write(surroundings(docs, chosen.groupBy("key").agg(F.collect_set("x").alias("found"))), "around")
    scratch.drop("found", "contexts", "groups")
    parts = whole.union(sorted_stretches(near.filter("not big").select("hash", "key", "place", "left", "around", "once").repartition("hash").sortWithinPartitions("hash")))
    if near.filter("big").limit(1).count():
        wide = scratch.write(windows(near.filter("big")).distinct(), "windows")
        more = wide.groupBy("window").count().filter("count > 1").select("window")
        parts = parts.union(wide.join(more, "window").select("key", "start", (F.col("start") + WINDOW).alias("end")))
    parts = scratch.write(parts.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cut")), "stretches")
    scratch.drop("around", "whole", "windows")
    return parts


def merged(cut: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in cut:
        if out and x["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["end"]))
        else:
            out.append((x["start"], x["end"]))
    return out


def with_stretches(docs: DataFrame) -> DataFrame:
    """`docs` with _cut: the stretches to remove, as an array, or null."""
    importable(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    # A row that is repeated as it is (same doc_id, same text) stands in another place: all of it goes.
    copies = docs.filter(F.octet_length("text") >= WINDOW).groupBy(row_key().alias("_auditlake_key")).agg(F.count("*").alias("_auditlake_copies")).filter("_auditlake_copies > 1")
    stretches = repeated_stretches(docs, scratch).withColumnRenamed("key", "_auditlake_key").withColumnRenamed("cut", "_auditlake_cut")
    copies = scratch.write(copies, "copies")
    marks = stretches.join(copies, "_auditlake_key", "full_outer")
    return docs.withColumn("_auditlake_key", row_key()).join(marks, "_auditlake_key", "left").withColumn("_auditlake_cut", F.when(F.col("_auditlake_copies").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))).otherwise(F.col("_auditlake_cut"))).drop("_auditlake_key", "_auditlake_copies")


def kept_parts(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cut:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            rows = []
            for doc, text, cut in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                text, cut = text or b"", merged(cut or [])
                kept = kept_parts(text, cut)
                rows.append((doc, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_stretches(docs).select("doc_id", "text", "_auditlake_cut").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
