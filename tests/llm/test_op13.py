"""Operator 13 against all pairs of sets."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from auditlake.llm import op13_jaccard as op
from conftest import EDGE, prose


def grams(text, n=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def brute(rows, percent=90):
    """Per row: (doc_id, size, least doc_id reachable)."""
    sets = [(d, grams(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(set)
    for d, s in sets:
        if d is not None and s:
            by[s].add(d)
    classes = list(by)
    for s, t in itertools.combinations(classes, 2):
        if 100 * len(s & t) >= percent * len(s | t):
            by[s] |= {min(by[t])}
    for ids in by.values():
        for d in ids:
            a, b = sorted((find(d), find(min(ids))))
            root[b] = a
    return collections.Counter((d, len(s), None if d is None else find(d)) for d, s in sets)


def near(text, changes, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"x{rng.randint(0, 10**6)}"
    return " ".join(words)


def corpus():
    rng, rows = random.Random(3), [(d, t) for d, t in EDGE if d != 6]
    ids = iter(range(1000, 10_000))
    for n in (12, 19, 20, 40, 80, 200, 900):
        text = prose(n, n)
        # Around the threshold: a changed word changes three n-grams, so two sets differ in six.
        for k in range(max(2, n // 40) + 2):
            rows += [(next(ids), near(text, k, s)) for s in range(4)]
        # Chains: each differs a little more from the first.
        chain = text
        for s in range(8):
            chain = near(chain, max(1, n // 90), 50 + s)
            rows.append((next(ids), chain))
    passage = prose(77, 150)
    rows += [(next(ids), passage + " " + prose(100 + i, rng.randint(8, 60))) for i in range(60)]
    rows += [(5000, rows[30][1]), (5000, rows[60][1]), (5000, rows[90][1]), (5000, prose(901, 30)), (None, rows[30][1]), (6000, "one"), (6001, "ONE"), (6002, "one two"), (6003, "two one")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def found(df, **options):
    return collections.Counter(tuple(r) for r in op.similarity_classes(df, **options).collect())


def test_op13_against_all_pairs(spark, rows):
    df = spark.createDataFrame([(d, t, "a", 1, b"k") for d, t in rows], "doc_id long, text string, node string, component_id int, set_key binary").repartition(4)
    assert found(df) == brute(rows)


def test_op13_open_postings(spark):
    """Sets that agree on many fragments without being links, and links among them that no hub shows."""
    passage, rows = prose(5, 400), []
    for i in range(120):
        rows.append((i, passage + " " + prose(1000 + i, 50)))
        if i % 10 == 0:
            rows.append((500 + i, near(rows[-1][1], 3, i)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_op13_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert found(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")) == {(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1}


def test_op13_linked_sets_agree():
    """Sets at the threshold, of all sizes, agree on as many fragments of one band as their posts need."""
    rng, bands = np.random.default_rng(2), op.Bands(90)
    for n in [*range(9, 120), 500, 1201]:
        s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for drop in range(n // 10 + 1):
            for add in range((n // 10 - drop) + 1):
                t = np.unique(np.concatenate([rng.permutation(s)[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))
                both = len(np.intersect1d(s, t))
                if both == len(s) == len(t) or 100 * both < 90 * (len(s) + len(t) - both):
                    continue
                x, y = ({tuple(c.tolist()): need for need, c in op.fragments(v, bands)} for v in (s, t))
                assert any(len(set(a) & set(b)) >= max(x[a], y[b]) for a in x for b in y)
            if n > 120:
                break


def test_op13_fragments_are_counted_apart(spark):
    """Sets cut at different numbers of quantiles, counted per fragment, give whole overlaps."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 64, 17_000, dtype=np.uint64))
    sets = {0: base[:16_300], 1: base, 2: base[:15_000], 3: base[300:16_500]}
    rows = []
    for i, s in sets.items():
        lg = op.segments_log(len(s))
        cut = np.split(s, np.searchsorted(s, np.arange(1, 1 << lg, dtype=np.uint64) << np.uint64(64 - lg)))
        rows.append((i, len(s), lg, [x.tobytes() for x in cut]))
    assert len({r[2] for r in rows}) == 2
    df = spark.createDataFrame(rows, "node long, n long, lg int, segments array<binary>")
    pairs = [(a, b) for a in sets for b in sets if a > b]
    got = {tuple(r) for r in op.overlapping(spark.createDataFrame(pairs, "a long, b long"), df, 95).collect()}
    assert got == {(a, b) for a, b in pairs if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 95 * (len(sets[a]) + len(sets[b]) - o)}
    assert 0 < len(got) < len(pairs)
