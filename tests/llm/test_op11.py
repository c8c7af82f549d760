"""Operator 11 against a plain dynamic programme over whole conversations, and that against all edits."""

import collections
import hashlib
import itertools
import random
import re
import zlib

from auditlake.llm import op11_repair as op

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def inserted(d):
    for _ in range(4):
        for q, (c, a, rep) in list(d.items()):
            for ch, name in NAMES.items():
                if (q, ch) in NEXT:
                    v, n = (c + 3, a + "I", (*rep, (name, ""))), NEXT[q, ch]
                    if n not in d or v[:2] < d[n][:2]:
                        d[n] = v
    return d


def repair(turns, faults):
    """Cost, audit and repaired turns, one turn after another."""
    d = inserted({"": (0, "", ())})
    for (role, text), f in zip(turns, faults, strict=True):
        e = {}

        def put(n, v, e=e):
            if n not in e or v[:2] < e[n][:2]:
                e[n] = v

        for q, (c, a, rep) in d.items():
            put(q, (c + 4, a + "D", rep))
            if f in ("b", "d"):
                continue
            more = 3 if f == "t" else 0
            if (q, role[:1]) in NEXT:
                put(NEXT[q, role[:1]], (c + more, a + "K", (*rep, (role, text))))
            for ch, name in NAMES.items():
                if (q, ch) in NEXT:
                    put(NEXT[q, ch], (c + more + 3, a + "R", (*rep, (name, text))))
        d = inserted(e)
    return min((d[q] for q in ("", "a") if q in d), key=lambda v: v[:2])


def brute(conv, rows, spoil=True):
    every = []
    spare = lambda x: " " if x is None else str(x)
    for turn, role, text in rows:
        k = zlib.crc32(f"{spare(conv)}:{spare(turn)}".encode()) % 20 if spoil else 19
        role, text = spare(role), spare(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            every += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    every.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in every if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in every:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[1][:1] for r in every]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
    cost, audit, rep = repair([r[1:] for r in every], faults)
    return (conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rep).encode()).hexdigest())


def grouped(rows):
    by = collections.defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    return by


def test_op11_against_a_plain_programme(spark):
    rng, rows = random.Random(1), []
    for c in [None, *range(40)]:
        # One conversation has a third of all rows and lies over several partitions.
        n = rng.choice([1, 3, 9, 40, 300]) if c != 7 else 2500
        rows += [(c, rng.choice([None, *range(n)]), rng.choice([None, "system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice([None, "", "a.", "b", "yes.  ", "no", "x?", "y!\n", " \t"])) for _ in range(n)]
    rows += [(99, None, "user", "same."), (99, None, "user", "same."), (98, 5, "user", "wort " * 50_000), (98, 6, "assistant", "é😀 ja.")]
    chats = spark.createDataFrame([(*r, "k", "conv", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, audit string, conv string, part int, pos int").repartition(5)
    got = {r.conv_id: tuple(r) for r in op.repair_digest(chats).collect()}
    assert got == {c: brute(c, r) for c, r in grouped(rows).items()}
    assert op.repair_digest(chats.limit(0)).count() == 0


def test_op11_dropped_conversations_stay(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = op.repair_digest(spark.createDataFrame([(c, 0, "user", "hi.") for c in gone], "conv_id long, turn long, role string, text string")).collect()
    assert {tuple(r) for r in got} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone}


def test_op11_products_in_any_order():
    rng, letters = random.Random(5), list(op.KINDS.values())
    kind = {v: k for k, v in op.KINDS.items()}
    for _ in range(300):
        kinds = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        scan = op.Scan()
        scan.add(kinds)
        cut = rng.randint(0, len(kinds))
        left, right = op.Scan(), op.Scan()
        left.add(kinds[:cut])
        right.add(kinds[cut:])
        both = op.product(left.value(), right.value())
        turns = [(kind[k][0].replace("?", "tool"), "x") for k in kinds]
        want = repair(turns, ["b" if kind[k][1] else "t" if kind[k][2] else "" for k in kinds])[:2]
        assert op.cheapest(scan.value()) == op.cheapest(both) == want


def test_op11_plain_programme_against_all_edits():
    ok = re.compile("(s?(ua)+)?$").match
    for turns in itertools.product("sua?", repeat=3):
        best = []
        for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=3):
            for gaps in itertools.product(("", "u", "a", "ua"), repeat=4):
                out, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * sum(map(len, gaps))
                for t, e, g in zip(turns, edits, gaps[1:], strict=True):
                    out += {"K": t, "D": ""}.get(e, e[1:]) + g
                    audit += e[0] + "I" * len(g)
                    cost += {"K": 0, "D": 4}.get(e, 3)
                if ok(out):
                    best.append((cost, audit))
        assert min(best) == repair([(t, "") for t in turns], [""] * 3)[:2]


def test_op11_tree_of_parts(spark):
    """Elements of many parts, combined level by level, give what one scan gives."""
    rng, letters = random.Random(6), list(op.KINDS.values())
    kinds, rows = [], []
    for part in range(70):
        e = op._Element("c", part)
        mine = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        e.scan.add(mine)
        e.counts[0] = len(mine)
        e.follow("u", "u")
        kinds.append(mine)
        rows += op._elements([e]).to_pylist()
    df = spark.createDataFrame(rows, op.ELEMENT)
    for _ in range(3):
        df = op.combined(df)
    one = op.results(df).collect()
    whole = op.Scan()
    whole.add("".join(kinds))
    assert [(r.turns, r.illegal, r.cost, r.audit) for r in one] == [(sum(map(len, kinds)), 69, *op.cheapest(whole.value()))]
