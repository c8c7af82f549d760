"""Operator 9, best-fit packing by exact-complement hashing.

Documents become token counts; only a document longer than a sequence is cut, into full pieces and one
shorter first piece. Which lengths share a sequence is planned on the histogram of piece lengths, which
has at most `capacity` entries whatever the number of documents; the plan is then dealt out to the
pieces by their number among the pieces of their length. Numbers come from counts by length and salt, of
which a length has one for every SALT_ROWS pieces, so a length that a third of all pieces have is never
gathered in one task.

A null text counts as empty (its one id is the end mark); repeated rows are packed each on its own; an
empty table gives an empty result; a null doc_id stays null; other columns are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.bpe import NOT_PLAIN, PRE_TOKEN, Encoder, Vocabulary
from auditlake.llm.common import Scratch, importable, short, table

CAPACITY = 2048
#: Pieces of one length that are numbered in one task; a length of more is dealt over as many salts.
SALT_ROWS = 1_000_000
#: Rows of the plan that are broadcast at most; each combination but the last few exhausts a length.
PLAN_ROWS = 1 << 20


class Packer:
    """Plans sequences on counts of lengths 1..capacity.

    Sequences that are exactly full come first: for each length, longest first, the rest of the
    sequence is looked up among single lengths and in an index of the sums of two and of three, and
    combinations are consumed as far as the supply allows. What is left is packed longest first into the open sequence with the least room that
    still takes it. Open sequences of the same contents are handled as one with a count."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.left = counts.astype(np.int64).copy()
        self.capacity = capacity
        self.plan: list[tuple[tuple[int, ...], int]] = []

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consumes a combination as often as the supply allows."""
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(int(self.left[n]) // k for n, k in need.items())
        if times:
            for n, k in need.items():
                self.left[n] -= k * times
            self.plan.append((lengths, times))
        return times

    def index(self) -> None:
        """The sums of two and of three lengths in supply: the greater lengths of the pairs of each sum, and the greatest
        lengths of the triples of each sum, both descending."""
        cap = self.capacity
        lengths = np.flatnonzero(self.left[: cap + 1])
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        fits = (a >= b) & (a + b < cap)
        a, total = a[fits], (a + b)[fits]
        by = np.lexsort((-a, total))
        self.pair, self.pair_at = a[by], np.searchsorted(total[by], np.arange(cap + 2))
        # A triple is its greatest length and a pair of the rest, of which neither is greater.
        least = np.full(cap + 1, cap + 1)
        np.minimum.at(least, total, a)
        greatest, rest = np.meshgrid(lengths, np.flatnonzero(least <= cap), indexing="ij")
        fits = (greatest + rest < cap) & (least[rest] <= greatest)
        greatest, total = greatest[fits], (greatest + rest)[fits]
        by = np.lexsort((-greatest, total))
        self.triple, self.triple_at = greatest[by], np.searchsorted(total[by], np.arange(cap + 2))

    def pairs(self, gap: int, top: int) -> list[tuple[int, int]]:
        """Two lengths that sum to the gap, neither above `top`, from the index; those still in supply."""
        if gap < 2:
            return []
        a = self.pair[self.pair_at[gap] : self.pair_at[gap + 1]]
        a = a[(a <= top) & (self.left[a] > 0) & (self.left[gap - a] > 0)]
        return [(x, gap - x) for x in a.tolist()]

    def exact(self) -> None:
        cap = self.capacity
        self.take((cap,))
        for n in range(cap - 1, 0, -1):
            if self.left[n] and self.left[cap - n]:
                self.take((n, cap - n))
        self.index()
        for n in range(cap - 2, 0, -1):
            if self.left[n]:
                for pair in self.pairs(cap - n, n):
                    self.take((n, *pair))
                    if not self.left[n]:
                        break
        for n in range(cap - 3, 0, -1):
            gap = cap - n
            if not self.left[n]:
                continue
            for b in self.triple[self.triple_at[gap] : self.triple_at[gap + 1]].tolist():
                if not self.left[n]:
                    break
                if b <= n and self.left[b]:
                    for pair in self.pairs(gap - b, b):
                        self.take((n, b, *pair))
                        if not self.left[n] or not self.left[b]:
                            break

    def best_fit(self) -> None:
        """open[r]: combinations with room r and how many of each."""
        cap = self.capacity
        open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(cap + 1)]
        for n in range(cap, 0, -1):
            while self.left[n] > 0:
                room = next((r for r in range(n, cap) if open_[r]), cap)
                if room == cap:
                    # A new sequence takes as many of this length as fit.
                    each = min(cap // n, int(self.left[n]))
                    base, times = (n,) * each, int(self.left[n]) // each
                else:
                    base, have = next(iter(open_[room].items()))
                    each = min(room // n, int(self.left[n]))
                    times = min(have, int(self.left[n]) // each)
                    open_[room].pop(base)
                    if have > times:
                        open_[room][base] = have - times
                    base += (n,) * each
                self.left[n] -= each * times
                rest = cap - sum(base)
                open_[rest][base] = open_[rest].get(base, 0) + times
        for group in open_:
            self.plan += list(group.items())

    def run(self) -> list[tuple[tuple[int, ...], int]]:
        self.exact()
        self.best_fit()
        return self.plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, end number, sequence of the first, offset): the pieces of a length whose
    numbers lie in a range go to consecutive sequences, at the same place in each."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in plan:
        at = 0
        for n in lengths:
            first = used.get(n, 0)
            rows.append((n, first, first + times, sequence, at))
            used[n] = first + times
            at += n
        sequence += times
    return rows


@lru_cache(maxsize=2)
def _fast(vocabulary: str):
    """Ids of whole texts: a compiled library over the same vocabulary for texts of common characters,
    the engine's own encoder where character classes may differ between libraries."""
    import tiktoken

    voc = Vocabulary(vocabulary)
    ranks = {s: i for i, s in voc.strings.items() if i not in voc.added.values()}
    ordered = all(a < b for a, b in zip(voc.merged, voc.merged[1:], strict=False))
    library = tiktoken.Encoding("own", pat_str=PRE_TOKEN.pattern, mergeable_ranks=ranks, special_tokens=voc.added) if ordered else None
    return library, Encoder(voc)


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    library, own = _fast(vocabulary)
    if library is not None and not NOT_PLAIN.search(text):
        return np.asarray(library.encode_to_numpy(text, allowed_special="all"), "<u4")
    return np.frombuffer(own.encode(text), "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what full pieces leave."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and row_key, which tells repeated rows apart."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = (TaskContext.get().partitionId() << 40) - 1
        mark = np.array([end_id], "<u4")
        for batch in short(batches, 1):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row += 1
                ids = np.concatenate([token_ids(text or "", vocabulary), mark])
                out += [(doc, row, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    spark = df.sparkSession
    scratch = Scratch(spark)
    cuts = scratch.write(pieces(df, vocabulary, capacity, end_id), "pieces")
    # At most a row for each length, by construction.
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        histogram[n] = k
    salts = spark.createDataFrame([(n, -(-k // SALT_ROWS)) for n, k in counts.items()], "length long, _salts long")
    salted = cuts.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("row_key", "piece"), F.col("_salts")).cast("int"))
    # A row for each length and one more for every SALT_ROWS pieces of it.
    base, seen = [], {}
    for r in salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).orderBy("length", "_salt").collect():
        base.append((r["length"], r["_salt"], seen.get(r["length"], 0)))
        seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    bases = spark.createDataFrame(base, "length long, _salt int, _base long")
    rows = slots(Packer(histogram, capacity).run())
    if len(rows) > PLAN_ROWS:
        raise ValueError(f"a plan of {len(rows)} rows is too large to broadcast")
    plan = spark.createDataFrame(rows, "length long, _from long, _to long, _sequence long, offset long")
    within = W.partitionBy("length", "_salt").orderBy("row_key", "piece")
    numbered = salted.withColumn("_n", F.row_number().over(within).cast("long") - 1).join(F.broadcast(bases), ["length", "_salt"]).withColumn("_n", F.col("_n") + F.col("_base"))
    p = F.broadcast(plan.withColumnRenamed("length", "_length"))
    dealt = numbered.join(p, (F.col("length") == F.col("_length")) & (F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_to")))
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_n") - F.col("_from")).alias("sequence_id"), "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
