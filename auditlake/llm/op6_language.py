"""Operator 6, language identification by cross-parsing entropy.

A suffix automaton of some labelled text per language gives, at every place of a text, the longest match
with that language's text. Parsing greedily, a text needs few long phrases under its own language and
many short ones under others; the language with the fewest phrases, each weighed by the logarithm of its
training text's length, wins. Texts are parsed whole, in blocks that each start a new phrase, so many
blocks advance together, one character a step.

Learning takes a bounded sample, TRAIN_PASSAGES passages of PASSAGE characters a language, from rows with
language, text and doc_id whose crc32(doc_id) mod 5 is not 0. A null text or one without a letter gives
`und` (score 0), as does every text when nothing could be learned; equal counts go to the first language
by name; a null doc_id counts as not held out; repeated rows each give a row; an empty table gives an
empty result; other columns are not read."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import extended, importable, runs, short, table

#: Bound of the labelled sample, for each language, in passages; every passage of every labelled text may be one.
TRAIN_PASSAGES = 60
PASSAGE = 512
#: Characters parsed as one sequence.
BLOCK = 512
#: Codes of characters: 0 none that was learned, 1 anything but letters, then all letters of the sample, the most
#: frequent first. Codes below DENSE have columns in the table of transitions; the others' are kept sparse.
DENSE = 64
UNDETERMINED = "und"
RUN_BYTES = 2 << 20

Sample = tuple[tuple[str, str], ...]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, passages: int = TRAIN_PASSAGES, chars: int = PASSAGE) -> Sample:
    """(language, text) of the sample; at most `passages` passages of `chars` characters a language."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    last = F.greatest(F.ceil(F.length("text") / chars) - 1, F.lit(0)).cast("int")
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i")
    # Only ids, numbers and languages are ranked; each task keeps `passages` of a language before the shuffle.
    parts = known.select("doc_id", "lang", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    picked = parts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= passages).select("doc_id", "lang", "i").distinct()
    texts = known.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", F.xxhash64("doc_id", "i").alias("h"), "doc_id", "i", F.substring(F.col("text"), F.col("i") * chars + 1, F.lit(chars)).alias("text")).distinct().collect()
    by: dict[str, list[str]] = {}
    for r in sorted(texts):
        by.setdefault(r["lang"], []).append(r["text"])
    return tuple((lang, " ".join(by[lang])) for lang in sorted(by))


class Alphabet:
    """Codes of characters, lower-cased, by their frequency in the sample."""

    def __init__(self, texts: list[str]) -> None:
        letters: Counter[str] = Counter()
        for t in texts:
            for c, n in Counter(t).items():
                if c.isalpha():
                    letters[c.lower()] += n
        codes = {c: i + 2 for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0])))}
        self.size = len(codes) + 2
        self.code = np.ones(sys.maxunicode + 1, np.int32)
        self.letter = np.zeros(sys.maxunicode + 1, bool)
        for c, s in enumerate(map(chr, range(sys.maxunicode + 1))):
            if s.isalpha():
                self.letter[c] = True
                self.code[c] = codes.get(s.lower(), 0)

    def read(self, text: str) -> tuple[np.ndarray, bool]:
        """Codes, runs of other characters as one, and whether there is a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        codes = self.code[points]
        other = codes == 1
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(other[1:] & other[:-1])
        return codes[keep], bool(self.letter[points].any())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of `codes`; 0 is its root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Parser:
    """The automata of all languages as one table: row = state, column = code. A negative entry ~s ends
    the phrase; the next one starts with that character, in state s. Transitions by codes from DENSE on are
    in `keys` (state and code), in order, and `targets`; `first` has the states where phrases start."""

    def __init__(self, sample: Sample) -> None:
        self.languages = [lang for lang, _ in sample]
        self.alphabet = Alphabet([t for _, t in sample])
        tables, sparse, self.roots, self.weights, base = [], [], [], [], 0
        self.first = np.zeros((len(sample), self.alphabet.size), np.int32)
        for (_, text), first in zip(sample, self.first, strict=True):
            codes, _ = self.alphabet.read(text)
            moves = suffix_automaton([c for c in codes.tolist()])
            first[:] = base
            for c, s in moves[0].items():
                first[c] = base + s
            dense = np.full(DENSE, ~base, np.int32)
            dense[: self.alphabet.size] = ~first[:DENSE]
            rows = np.tile(dense, (len(moves), 1))
            for s, out in enumerate(moves):
                for c, to in out.items():
                    if c < DENSE:
                        rows[s, c] = base + to
                    else:
                        sparse.append(((base + s) * self.alphabet.size + c, base + to))
            tables.append(rows)
            self.roots.append(base)
            self.weights.append(math.log2(len(codes) + 2))
            base += len(moves)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        # The last key is none's, so that every search ends at a key.
        self.keys, self.targets = np.array([*sorted(sparse), (np.iinfo(np.int64).max, 0)], np.int64).T.copy()

    def rare(self, k: int, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Entries for codes from DENSE on under language k."""
        key = state * self.alphabet.size + code
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.targets[at], ~self.first[k, code])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text under each language."""
        sizes = [min(BLOCK, len(t) - i) for t in texts for i in range(0, len(t), BLOCK)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // BLOCK) for t in texts])
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        if not sizes:
            return total
        size = np.array(sizes)
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((BLOCK, len(size)), np.int64)
        flat = np.concatenate(texts)
        lows = np.cumsum(size) - size
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        within = np.arange(len(flat)) - np.repeat(lows, size)
        grid[within, np.repeat(place, size)] = flat
        active = np.searchsorted(-size[order], -np.arange(BLOCK), "left")
        far = grid >= DENSE
        dense = np.where(far, 0, grid)
        rare = [np.flatnonzero(row) for row in far] if far.any() else []
        for k, root in enumerate(self.roots):
            state = np.full(len(size), root, np.int64)
            count = np.ones(len(size), np.int64)
            for t in range(int(size[order[0]])):
                n = active[t]
                to = self.table[state[:n] * DENSE + dense[t, :n]]
                if rare and len(rare[t]):
                    to[rare[t]] = self.rare(k, state[rare[t]], grid[t, rare[t]])
                ends = to < 0
                count[:n] += ends
                state[:n] = np.where(ends, ~to, to)
            np.add.at(total[:, k], owner[order], count)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        read = [self.alphabet.read(t or "") for t in texts]
        counts = self.phrases([c for c, _ in read]) * np.array(self.weights)
        found = []
        for (_, letters), row in zip(read, counts.tolist(), strict=True):
            if not letters or not row:
                found.append((UNDETERMINED, 0.0))
                continue
            best = min(range(len(row)), key=row.__getitem__)
            second = min((x for i, x in enumerate(row) if i != best), default=0.0)
            found.append((self.languages[best], 1 - row[best] / second if second else 0.0))
        return found


@lru_cache(maxsize=2)
def parser(sample: Sample) -> Parser:
    return Parser(sample)


def predictions(batch: pa.RecordBatch, text: int, sample: Sample) -> list[tuple[str, float]]:
    texts = batch.column(text).to_pylist()
    return [x for a, b in runs([len(t or "") for t in texts], RUN_BYTES) for x in parser(sample).predict(texts[a:b])]


def with_language(df: DataFrame, sample: Sample, text: str = "text") -> DataFrame:
    """`df` with lang_pred and score."""
    importable(df.sparkSession)
    schema = extended(df, lang_pred="string", score="double")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, at, 1024):
            found = predictions(batch, at, sample)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs.select("doc_id", "text"), training_sample(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
