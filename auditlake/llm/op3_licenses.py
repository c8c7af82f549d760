"""Operator 3, license scans: fuzzy search for short notices.

A notice of which at most k edits are allowed is split into k + 1 pieces; by the pigeonhole principle an
occurrence holds one piece unchanged. Pieces are looked up exactly in the texts' words, and around each
place the regex library's bounded-error matching verifies the notice, counts edits and gives the span.

A null text counts as empty (no words, no labels, score 0); rows are independent; texts have no length
limit; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import importable, runs, short, table, text_bytes

BLOCK_BYTES = 1 << 20
#: One edit allowed in so many characters of a notice.
CHARS_PER_EDIT = 15
#: Before the costly matching: of so many pieces more than edits, as many must stand unchanged.
SPARE_PIECES = 4
#: Label and phrase of the base scan.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Label and words of common short notices.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("proprietary", "all rights reserved"),
)
#: Bytes that end a word: all of ASCII but digits and letters.
TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Place:
    label: str
    first_word: int
    end_word: int
    edits: int
    score: float


class Notice:
    def __init__(self, label: str, words: str) -> None:
        self.label, self.words = label, words.encode()
        self.edits = max(1, len(words) // CHARS_PER_EDIT)
        self.pieces = self.split(self.edits + 1)
        self.finer = [x for x, _ in self.split(self.edits + SPARE_PIECES)]
        self.pattern = regex.compile(rb"(?b)(?:%s){e<=%d}" % (regex.escape(words, special_only=True).encode(), self.edits))

    def split(self, k: int) -> list[tuple[bytes, int]]:
        cuts = [len(self.words) * i // k for i in range(k + 1)]
        return [(self.words[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def verify(self, text: bytes, at: int) -> tuple[int, int, int] | None:
        """Start, end and edits of the best occurrence about `at`, where the notice would start."""
        low = max(0, at - self.edits)
        window = text[low : at + len(self.words) + self.edits]
        if sum(x in window for x in self.finer) < SPARE_PIECES:
            return None
        m = self.pattern.search(window)
        return m and (low + m.start(), low + m.end(), sum(m.fuzzy_counts))


@cache
def notices() -> list[Notice]:
    return [Notice(*x) for x in NOTICES]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def scan(texts: list[bytes]) -> list[tuple[int, list[Place], list[Place]]]:
    """Number of words, base places and fuzzy places of each text."""
    words = [words_of(t) for t in texts]
    # One space before and after each text's words; line ends keep texts apart.
    lines = [b" %s " % b" ".join(w) for w in words]
    starts, total = [], 0
    for line in lines:
        starts.append(total)
        total += len(line) + 1
    block = b"\n".join(lines)
    base: list[list[Place]] = [[] for _ in texts]
    near: list[dict[tuple[str, int], Place]] = [{} for _ in texts]

    spaces: dict[int, np.ndarray] = {}

    def word_at(i: int, offset: int) -> int:
        if i not in spaces:
            spaces[i] = np.flatnonzero(np.frombuffer(lines[i], np.uint8) == 0x20)
        return int(np.searchsorted(spaces[i], offset, "right")) - 1

    def places(piece: bytes) -> Iterator[tuple[int, int]]:
        at = block.find(piece)
        while at >= 0:
            i = bisect_right(starts, at) - 1
            yield i, at - starts[i]
            at = block.find(piece, at + 1)

    for label, phrase in PHRASES:
        for i, at in places(b" %s " % phrase.encode()):
            first = word_at(i, at)
            base[i].append(Place(label, first, first + phrase.count(" ") + 1, 0, 1.0))
    for notice in notices():
        tried: set[tuple[int, int]] = set()
        for piece, offset in notice.pieces:
            for i, at in places(piece):
                if (i, at - offset) in tried:
                    continue
                tried.add((i, at - offset))
                if m := notice.verify(lines[i], at - offset):
                    start, end, edits = m
                    while start < end - 1 and lines[i][start] == 0x20:
                        start += 1
                    first = word_at(i, start)
                    place = Place(notice.label, first, word_at(i, max(start, end - 1)) + 1, edits, 1 - edits / len(notice.words))
                    old = near[i].get((notice.label, first))
                    if old is None or old.score < place.score:
                        near[i][notice.label, first] = place
    return [(len(w), b, sorted(n.values(), key=lambda p: (p.first_word, p.label))) for w, b, n in zip(words, base, near, strict=True)]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in short(batches, 1):
        texts = [t or b"" for t in text_bytes(batch.column(1))]
        yield batch, [x for a, b in runs([len(t) for t in texts], BLOCK_BYTES) for x in scan(texts[a:b])]


def license_places(df: DataFrame) -> DataFrame:
    """doc_id and every place found: label, words, edits and score, base and fuzzy."""
    importable(df.sparkSession)
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[vars(p) for p in [*b, *n]] for _, b, n in found], kind)], names=["doc_id", "places"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, places array<struct<label:string,first_word:bigint,end_word:bigint,edits:bigint,score:double>>")


def license_digest(df: DataFrame) -> DataFrame:
    importable(df.sparkSession)

    def labels(places: list[Place]) -> str:
        return ",".join(sorted({p.label for p in places}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches):
            cols = [
                ("n_words", pa.int64(), [n for n, _, _ in found]),
                ("n_base", pa.int64(), [len(b) for _, b, _ in found]),
                ("first_word", pa.int64(), [min((p.first_word for p in b), default=None) for _, b, _ in found]),
                ("last_word", pa.int64(), [max((p.first_word for p in b), default=None) for _, b, _ in found]),
                ("base_labels", pa.string(), [labels(b) for _, b, _ in found]),
                ("labels", pa.string(), [labels([*b, *n]) for _, b, n in found]),
                ("score", pa.float64(), [max((p.score for p in [*b, *n]), default=0.0) for _, b, n in found]),
                ("places", pa.string(), [",".join(f"{p.label}:{p.first_word}:{p.end_word}:{p.edits}" for p in n) for _, _, n in found]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for _, t, v in cols)], names=["doc_id", *(c for c, _, _ in cols)])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))
