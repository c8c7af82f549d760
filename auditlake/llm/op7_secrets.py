"""Operator 7, secret scans by a trigram inverted index.

Each rule's pattern is parsed and turned into a Boolean query over trigrams that every match must hold.
Texts are taken in blocks; a block's index posts its texts under the trigrams that the rules ask for,
the query intersects and unites postings, and only candidates are run through the pattern. A rule
without mandatory trigrams (here: hexadecimal runs) scans every text.

A null text counts as empty; rows are independent, so repeated rows give the same result each; texts
have no length limit; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import importable, runs, short, table, text_bytes

BLOCK_BYTES = 1 << 20
#: Strings that a part of a pattern may expand to before it no longer counts as literal.
MAX_STRINGS = 24

Query = tuple  # ("tri", code) | ("and", queries) | ("or", queries); ("and", ()) holds for every text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length must reach `least`.
    group: int = 0
    least: int = 0


#: The base rules, then the method's own. Fixed values.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = 3


def _trigrams(text: str) -> Query:
    raw = text.lower().encode()
    return ("and", tuple({("tri", int.from_bytes(raw[i : i + 3], "big")) for i in range(len(raw) - 2)}))


def _any(strings: set[str]) -> Query:
    return ("or", tuple(_trigrams(s) for s in sorted(strings)))


def _literals(op: object, arg: object) -> set[str] | None:
    """The strings a single-character node stands for, if few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < MAX_STRINGS:
                found |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 6 else None
    return None


def _analyse(nodes: list) -> tuple[set[str] | None, Query]:
    """The strings a sequence of nodes stands for (None: too many), and a query that any match meets."""
    parts: list[Query] = []
    run: set[str] = {""}
    whole = True

    def close() -> None:
        nonlocal run
        parts.append(_any(run))
        run = {""}

    for op, arg in nodes:
        name, strings, query = str(op), None, ("and", ())
        if name == "SUBPATTERN":
            strings, query = _analyse(list(arg[3]))
        elif name == "BRANCH":
            found = [_analyse(list(x)) for x in arg[1]]
            query = ("or", tuple(q for _, q in found))
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = arg
            strings, query = _analyse(list(body))
            if (least, int(most)) == (0, 1) and strings is not None:
                strings, query = strings | {""}, ("and", ())
            elif (least, int(most)) != (1, 1):
                strings, query = None, query if least else ("and", ())
        elif name == "AT":
            strings = {""}
        else:
            strings = _literals(op, arg)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            close()
            if strings is not None:
                run = strings
            else:
                whole = False
                parts.append(query)
    exact = run if whole and not parts else None
    parts.append(_any(run))
    return exact, ("and", tuple(parts))


def _simplify(q: Query) -> Query | None:
    """None: holds for every text."""
    if q[0] == "tri":
        return q
    parts = [_simplify(x) for x in q[1]]
    if q[0] == "or":
        return None if any(x is None for x in parts) else ("or", tuple(dict.fromkeys(parts)))
    found = tuple(dict.fromkeys(x for x in parts if x is not None))
    return ("and", found) if found else None


def trigram_query(pattern: str) -> Query | None:
    """The Boolean trigram query of a pattern over lower-cased text; None where it has no mandatory one."""
    return _simplify(_analyse(list(_parser.parse(pattern, re.ASCII)))[1])


def _leaves(q: Query) -> set[int]:
    return {q[1]} if q[0] == "tri" else set().union(*map(_leaves, q[1]))


class Scanner:
    """Rules compiled once for each worker."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.asked = np.array(sorted(set().union(*(_leaves(q) for q in self.queries if q))), np.uint32)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.asked] = True

    def postings(self, block: np.ndarray, starts: np.ndarray) -> dict[int, set[int]]:
        """Texts of the block under each trigram that some rule asks for."""
        if len(block) < 3:
            return {}
        wide = block.astype(np.uint32)
        codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        at = np.flatnonzero(self.wanted[codes])
        keys = np.unique(codes[at].astype(np.int64) << 32 | (np.searchsorted(starts, at, "right") - 1))
        found: dict[int, set[int]] = {}
        for code, doc in zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True):
            found.setdefault(code, set()).add(doc)
        return found

    def candidates(self, q: Query, postings: dict[int, set[int]]) -> set[int]:
        if q[0] == "tri":
            return postings.get(q[1], set())
        found = [self.candidates(x, postings) for x in q[1]]
        return set.union(*found) if q[0] == "or" else set.intersection(*found)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text, in code points, by start and rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        postings = self.postings(np.frombuffer(b"\n".join(texts).lower(), np.uint8), starts)
        decoded: dict[int, str] = {}
        for k, (rule, pattern, q) in enumerate(zip(self.rules, self.patterns, self.queries, strict=True)):
            for i in range(len(texts)) if q is None else sorted(self.candidates(q, postings)):
                if i not in decoded:
                    decoded[i] = texts[i].decode("utf-8", "replace")
                for m in pattern.finditer(decoded[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scanned(batches: Iterator[pa.RecordBatch], text: int, rules: tuple[Rule, ...] = RULES) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[tuple[int, int, int]]]]]:
    """Batches with their texts and the spans found in them."""
    scan = scanner(rules).scan
    for batch in short(batches, text):
        texts = [t or b"" for t in text_bytes(batch.column(text))]
        spans = [s for a, b in runs([len(t) for t in texts], BLOCK_BYTES) for s in scan(texts[a:b])]
        yield batch, texts, spans


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every found span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def rows_with(df: DataFrame, schema: str, make: Callable[[list[bytes], list], list[pa.Array]], rules: tuple[Rule, ...]) -> DataFrame:
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch, texts, spans in scanned(batches, 1, rules):
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(texts, spans)], names=names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


def secret_spans(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and its spans as an array of (kind, start, end, secret)."""

    def make(texts: list[bytes], spans: list) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
        return [pa.array([[{"kind": rules[k].kind, "start": a, "end": b, "secret": t.decode("utf-8", "replace")[a:b]} for a, k, b in s] for t, s in zip(texts, spans, strict=True)], kind)]

    return rows_with(df, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,secret:string>>", make, rules)


def digest_spans(df: DataFrame) -> DataFrame:
    def make(texts: list[bytes], spans: list) -> list[pa.Array]:
        base = [[x for x in s if x[1] < BASE_KINDS] for s in spans]
        counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(BASE_KINDS)]
        return [*counts, pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), pa.array([joined(s) for s in spans], pa.string())]

    return rows_with(df, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make, RULES)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_spans(table(spark, sf_dir, "documents"))
