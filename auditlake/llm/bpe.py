"""Byte-level BPE: merges by a priority queue of ranks over a doubly linked symbol list; decoding by
concatenating vocabulary strings."""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import regex

#: The pre-tokenizer pattern of byte-level BPE vocabularies.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for texts of PLAIN characters only, where `re`, which is faster, sees the same classes.
PLAIN_TOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\n -~À-ɏ]")
#: Two white-space characters in a row: then a space-separated part is not a unit of its own.
GAPS = ("  ", " \n", "\n ", "\n\n")
#: Entries a worker's cache holds; words after that are computed each time.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    own = set(shown)
    return [chr(b) if b in own else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file: ids, merge ranks and added tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") is not None or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("only plain byte-level vocabularies are supported")
        ids = spec["model"]["vocab"]
        self.symbols = byte_symbols()
        of_symbol = {s: b for b, s in enumerate(self.symbols)}
        self.byte_ids = [ids[s] for s in self.symbols]
        self.left, self.right, self.merged = [], [], []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.merged.append(ids[a + b])
        self.rank = {pair: r for r, pair in reversed(list(enumerate(zip(self.left, self.right, strict=True))))}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {}
        for token, i in ids.items():
            self.strings[i] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        for token, i in self.added.items():
            self.strings[i] = token.encode()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token. The queue holds rank and place of every adjacent pair that merges; an
        entry whose symbols have changed since is stale and skipped."""
        symbols = [self.byte_ids[b] for b in word]
        end = len(symbols)
        if end < 2:
            return symbols
        rank, left, right = self.rank, self.left, self.right
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(r, i) for i in range(end - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left[r] or j >= end or symbols[j] != right[r]:
                continue
            symbols[i], symbols[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Parts(dict):
    """Ids, as packed bytes, of parts of a text; bounded."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        packed = self.make(part)
        if len(self) < CACHE_WORDS:
            self[part] = packed
        return packed


class Encoder:
    """Whole texts to ids, packed as little-endian unsigned 32-bit integers.

    `merge` turns one pre-token's bytes into ids. Most texts are runs of parts set apart by single
    spaces or line ends; such a part (with its space or line end) is cut and merged the same way
    wherever it stands, so its ids are cached whole. All other texts are cut by the full pattern."""

    def __init__(self, vocabulary: Vocabulary, merge: Callable[[bytes], list[int]] | None = None) -> None:
        self.vocabulary = vocabulary
        self.merge = merge or vocabulary.merge
        self.words = _Parts(self._word)
        self.parts = _Parts(lambda part: self._cut(part if part[:1] == "\n" else f" {part}"))
        self.added = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None

    def _word(self, word: str) -> bytes:
        ids = self.merge(word.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cut(self, text: str) -> bytes:
        pattern = PRE_TOKEN if NOT_PLAIN.search(text) else PLAIN_TOKEN
        return b"".join(map(self.words.__getitem__, pattern.findall(text)))

    def _plain(self, text: str) -> bytes:
        if any(gap in text for gap in GAPS) or NOT_PLAIN.search(text):
            return self._cut(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._cut(first) + b"".join(map(self.parts.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self.added is None or not any(x in text for x in self.vocabulary.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.vocabulary.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    return Encoder(Vocabulary(path))
