"""Fitting a verdict's evidence into a budget of characters (a staged reduction by lengths over nested arrays).

A document is an object of core fields and named lists of items, each item JSON already. Stages, left at the first
result that fits: as it is; lists halved one after another, longest first; lists cut to a prefix, or to a mark alone, the
unimportant first; the core alone; the core cut at the budget.

A null or empty list is absent; equal lengths go in the order of the document; a budget of 0 or less gives an empty text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists that are cut to a prefix rather than to a mark, the items that stay, and the end of a core cut short. Fixed values.
EVIDENCE = ("errors", "citations", "warnings", "notes")
EVIDENCE_ENDS = tuple(f"_{x}{s}" for x in ("error", "citation", "warning", "note") for s in ("", "s"))
PREFIX = 3
SUFFIX = "\n…(truncated)…"


def mark(omitted: Column) -> Column:
    """What stands for omitted items."""
    return F.concat(F.lit('{"_truncated":true,"_omitted_count":'), omitted.cast("string"), F.lit("}"))


def is_evidence(name: Column) -> Column:
    out = F.lower(name).isin(*EVIDENCE)
    for end in EVIDENCE_ENDS:
        out = out | F.endswith(F.lower(name), F.lit(end))
    return out


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _forms(lists: Column) -> Column:
    """Of each list that is not empty: name, n (items), evidence, and its items as a text: whole, halved and cut (null for one item)."""
    half, after = (lambda x: F.floor(x.n / 2).cast("int")), (lambda x: F.floor(x.n / 2).cast("int") + 1)
    text = lambda items, keep, left: F.array_join(F.concat(F.slice(items, 1, keep), F.array(mark(left))), ",")
    halved = lambda x: text(x["items"], half(x), x.n - half(x))
    # A halved list of PREFIX items at most stays; of a longer one the first are still the list's own.
    cut = lambda x: F.when(~x.evidence, mark(after(x))).when(after(x) <= PREFIX, halved(x)).otherwise(text(x["items"], F.lit(PREFIX), after(x) - PREFIX))
    some = F.filter(lists, lambda x: F.coalesce(F.size(x["items"]) > 0, F.lit(False)))
    sized = F.transform(some, lambda x: F.struct(x["name"].alias("name"), x["items"].alias("items"), F.size(x["items"]).alias("n"), is_evidence(x["name"]).alias("evidence")))
    return F.transform(sized, lambda x: F.struct(x["name"].alias("name"), x.n.alias("n"), x.evidence.alias("evidence"), F.array_join(x["items"], ",").alias("whole"), F.when(x.n > 1, halved(x)).alias("halved"), F.when(x.n > 1, cut(x)).alias("cut")))


def _steps(forms: Column) -> Column:
    """What is done to which list, in order: (i, less); lists are halved first, then cut. less: characters that a step adds."""
    at = F.filter(F.transform(forms, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y.x.n > 1)
    halve = F.transform(at, lambda y: F.struct((-y.x.n).alias("a"), y.i.alias("b"), y.x["name"].alias("c"), y.i.alias("i"), (F.length(y.x.halved) - F.length(y.x.whole)).alias("less")))
    cut = F.transform(at, lambda y: F.struct(y.x.evidence.cast("int").alias("a"), (F.floor(y.x.n / 2).cast("int") + 1).alias("b"), y.x["name"].alias("c"), y.i.alias("i"), (F.length(y.x.cut) - F.length(y.x.halved)).alias("less")))
    return F.concat(F.array_sort(halve), F.array_sort(cut))


def fitted(core: Column, lists: Column, budget: Column) -> Column:
    """(text, stage, n_cut): the first stage that fits, and how many lists were cut to a prefix or a mark. core: the JSON object of
    the core fields; lists: array of (name, items). Stages are tried by lengths; only the one that fits becomes a text."""
    none = F.lit(0)

    def taken(forms: Column, steps: Column) -> Column:
        """How many steps it takes until the document fits; -1 if it never does."""
        size = F.aggregate(forms, F.length(core), lambda n, x: n + F.length(x["name"]) + F.length(x.whole) + len(',"":[]'))
        begin = _let(size, lambda n: F.struct(n.alias("size"), none.alias("i"), F.coalesce(n <= budget, F.lit(False)).alias("fits")))
        step = lambda s, x: F.when(s.fits, s).otherwise(F.struct((s["size"] + x.less).alias("size"), (s.i + 1).alias("i"), F.coalesce(s["size"] + x.less <= budget, F.lit(False)).alias("fits")))
        return F.aggregate(steps, begin, step, lambda s: F.when(s.fits, s.i).otherwise(-1))

    def text(forms: Column, steps: Column, k: Column, n_long: Column) -> Column:
        ids = lambda start, n: F.transform(F.slice(steps, start, F.greatest(n, none)), lambda x: x.i)
        one = lambda x, i, halved, cut: F.concat(F.lit(',"'), x["name"], F.lit('":['), F.when(F.array_contains(cut, i), x.cut).when(F.array_contains(halved, i), x.halved).otherwise(x.whole), F.lit("]"))
        rest = _let(F.struct(ids(F.lit(1), F.least(k, n_long)).alias("h"), ids(n_long + 1, k - n_long).alias("c")), lambda s: F.array_join(F.transform(forms, lambda x, i: one(x, i, s.h, s.c)), ""))
        return F.concat(F.substring(core, 1, F.length(core) - 1), rest, F.lit("}"))

    def end(forms: Column, steps: Column, k: Column) -> Column:
        n_long = (F.size(steps) / 2).cast("int")
        short = F.concat(F.substring(core, F.lit(1), F.greatest(budget - len(SUFFIX), none).cast("int")), F.lit(SUFFIX))
        hard = F.when(budget <= len(SUFFIX), F.substring(core, F.lit(1), F.greatest(budget, none).cast("int"))).otherwise(short)
        fits, alone = k >= 0, F.length(core) <= budget
        stage = F.when(k == 0, "fits_initial").when(fits & (k <= n_long), "halved_lists").when(fits, "dropped_lists").when(alone, "core_only").otherwise("hard_cap")
        n_cut = F.when(fits, F.greatest(none, k - n_long)).otherwise(n_long)
        return F.struct(F.when(fits, text(forms, steps, k, n_long)).when(alone, core).otherwise(hard).alias("text"), stage.alias("stage"), n_cut.alias("n_cut"))

    return _let(_forms(lists), lambda forms: _let(_steps(forms), lambda steps: _let(taken(forms, steps), lambda k: end(forms, steps, k))))
