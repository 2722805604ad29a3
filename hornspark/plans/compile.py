"""Conjunctive queries as DataFrames of distinct bindings.

Catalyst does not turn an inner join under a distinct into a semi-join, so that is done here: an
atom whose further variables nobody asks for is reduced to the distinct values of the others, an
atom whose variables are all bound is a left semi join, and after each join the variables that are
no longer needed go, under a distinct. What remains is a chain of joins whose physical form
Catalyst and adaptive execution choose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import DIFFERENT, EQUALS, Atom, is_special, is_var, rename, variables
from hornspark.operators.special import relation_pairs
from hornspark.sources.kb import KB

#: Ends are put in classes by what they meet in where that has so few values; and pairs that a task makes of classes, about.
FEW_VALUES, PAIRS_A_TASK = 1000, 2_000_000


def scan(kb: KB, atom: Atom) -> DataFrame:
    """All bindings of one atom, a column per variable; an atom without variables gives a column-less match as ``_one``."""
    s, r, o = atom
    if is_special(r):
        df = relation_pairs(kb, s, r, o)
        terms = [("a", s), ("b", o)]
    else:
        df = kb.df
        terms = [("p", r), ("s", s), ("o", o)]
    seen: dict[str, str] = {}
    for column, term in terms:
        if not is_var(term):
            df = df.filter(F.col(column) == term)
        elif term in seen:
            df = df.filter(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    return df.select(*(F.col(c).alias(v) for v, c in seen.items())) if seen else df.select(F.lit(1).alias("_one")).limit(1)


def _unify(atoms: list[Atom], out: Sequence[str]) -> tuple[list[Atom], dict[str, str]]:
    """Atoms without equalities that other atoms decide, and what each variable is replaced by."""
    swap: dict[str, str] = {}
    rest = [a for a in atoms if a[1] != EQUALS]
    for s, _, o in (a for a in atoms if a[1] == EQUALS):
        s, o = swap.get(s, s), swap.get(o, o)
        if s == o and not is_var(s):
            continue
        bound = {t for a in rest if a[1] != DIFFERENT for t in rename([a], swap)[0]}
        if is_var(o) and (s in bound or o in bound or not is_var(s)):
            old, new = o, s
        elif is_var(s) and (s in bound or not is_var(o)):
            old, new = s, o
        else:
            rest.append((s, EQUALS, o))
            continue
        swap = {k: (new if v == old else v) for k, v in swap.items()} | {old: new}
    return list(rename(rest, swap)), swap


def _sized(kb: KB, atoms: Sequence[Atom]) -> list[tuple[float, dict[str, float]]] | None:
    """(rows, values by variable) of stored atoms that close a cycle, from one count of their relations without a shuffle of facts; None for other queries.

    Only there can an order make pairs that a later atom throws away.
    """
    own = [variables([a]) for a in atoms]
    if len(atoms) < 3 or any(is_special(a[1]) or is_var(a[1]) for a in atoms) or sum(map(len, own)) < len(atoms) + len({v for x in own for v in x}):
        return None
    counts = kb.df.filter(F.col("p").isin(sorted({a[1] for a in atoms}))).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o"))
    stats = {r.p: r for r in counts.collect()}
    out = []
    for a in atoms:
        r = stats.get(a[1])
        n = float(r.n) if r else 0.0
        for c, t in (("s", a[0]), ("o", a[2])):
            n /= max(1, r[c]) if r and not is_var(t) else 1
        out.append((n, {t: min(n, float(r[c])) if r else 0.0 for c, t in (("s", a[0]), ("o", a[2])) if is_var(t)}))
    return out


def _greedy(frames: list[DataFrame], sizes: list[tuple[float, dict[str, float]]], needed: set[str]) -> DataFrame:
    """All frames joined, each time the two that make the fewest rows; what nobody needs any more goes under a distinct."""
    parts = [(df, n, {v: d for v, d in values.items() if v in df.columns}) for df, (n, values) in zip(frames, sizes, strict=True)]
    while len(parts) > 1:
        best = None
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                (_, n, x), (_, m, y) = parts[i], parts[j]
                shared = x.keys() & y.keys()
                rows = n * m
                for v in shared:
                    rows /= max(1.0, x[v], y[v])
                best = min(best or (True, rows, i, j, shared), (not shared, rows, i, j, shared), key=lambda b: b[:4])
        apart, rows, i, j, shared = best
        (a, n, x), (b, m, y) = parts[i], parts[j]
        if apart:
            df = a.crossJoin(b)
        elif len(shared) == len(b.columns):
            df = a.join(b, sorted(shared), "left_semi")
        elif len(shared) == len(a.columns):
            df = b.join(a, sorted(shared), "left_semi")
        else:
            df = a.join(b, sorted(shared))
        rest = [p for k, p in enumerate(parts) if k not in (i, j)]
        keep = [c for c in df.columns if c in needed or any(c in p[0].columns for p in rest)]
        if rest and keep and len(keep) < len(df.columns):
            df = df.select(*keep).distinct()
        values = {v: min(rows, x.get(v, rows), y.get(v, rows)) for v in x.keys() | y.keys() if v in df.columns}
        parts = [*rest, (df, rows, values)]
    return parts[0][0]


def _by_classes(todo: Sequence[Atom], frames: list[DataFrame], sizes: list[tuple[float, dict[str, float]]], wanted: Sequence[str]) -> DataFrame | None:
    """Pairs of two variables that only meet in others of few values; None for other queries.

    Ends with the same values are one class. Classes are joined, and their members paired last: no pair is there twice, and none is shuffled.
    """
    own = [variables([a]) for a in todo]
    if len(wanted) != 2 or any(len(x) != 2 or len(set(x) & set(wanted)) != 1 for x in own):
        return None
    sides: list[dict[str, list[int]]] = [{}, {}]
    for k, x in enumerate(own):
        (end,) = set(x) & set(wanted)
        (met,) = set(x) - {end}
        sides[wanted.index(end)].setdefault(met, []).append(k)
    mets = sorted(sides[0])
    values = {m: max(min(sizes[k][1][m] for k in side.get(m, [])) if m in side else 0.0 for side in sides) for m in mets}
    if set(sides[0]) != set(sides[1]) or not mets or max(values.values()) > FEW_VALUES:
        return None
    pairs, members, sets = 1.0, [], []
    for name, end, side in zip("ab", wanted, sides, strict=True):
        df, names = None, [f"_{name}{i}" for i in range(len(mets))]
        for m, c in zip(mets, names, strict=True):
            first, *more = side[m]
            part = frames[first].select(end, m)
            for k in more:
                part = part.join(frames[k].select(end, m), [end, m], "left_semi")
            part = part.groupBy(end).agg(F.array_sort(F.collect_set(m)).alias(c))
            df = part if df is None else df.join(part, end)
        pairs *= min(sizes[k][1][end] for own_ in side.values() for k in own_)
        members.append(df)
        sets.append(names)
    apart = max([1.0, *(values[m] for m in mets if all(sizes[k][0] < 1.2 * sizes[k][1][end] for end, side in zip(wanted, sides, strict=True) for k in side[m]))])
    lead = mets.index(max(mets, key=lambda m: values[m]))
    left, right = (df.select(*names, F.explode(names[lead]).alias("_x")).distinct() for df, names in zip(members, sets, strict=True))
    classes = left.join(right, "_x")
    for i, (x, y) in enumerate(zip(*sets, strict=True)):
        classes = classes if i == lead else classes.filter(F.arrays_overlap(x, y))
    classes = classes.select(*sets[0], *sets[1]).distinct()
    tasks = int(min(10_000, max(1, pairs / apart // PAIRS_A_TASK)))
    salts = int(min(256, max(1, 8 * tasks // apart)))  # a class is dealt over so many parts, each with all of the other end's members
    ones = members[0].join(classes, sets[0]).select(wanted[0], *sets[1], F.pmod(F.hash(wanted[0]), F.lit(salts)).alias("_part"))
    others = members[1].withColumn("_part", F.explode(F.array(*map(F.lit, range(salts)))))
    by = [*sets[1], "_part"]
    return ones.repartition(tasks, *by).join(others.repartition(tasks, *by), by).select(*wanted)


def bind(kb: KB, atoms: Sequence[Atom], out: Sequence[str]) -> DataFrame:
    """The distinct bindings of ``out``; without any, one row where the query can be satisfied."""
    todo, swap = _unify(list(atoms), out)
    wanted = list(dict.fromkeys(swap.get(v, v) for v in out if is_var(swap.get(v, v))))
    unequal = [a for a in todo if a[1] == DIFFERENT]
    todo = [a for a in todo if a[1] != DIFFERENT]
    if not todo:
        raise ValueError("nothing binds the query's variables")

    def needed(left: Sequence[Atom]) -> set[str]:
        return {*wanted, *variables(left), *variables(unequal)}

    frames = []
    for k, a in enumerate(todo):
        df, keep = scan(kb, a), [v for v in variables([a]) if v in needed(todo[:k] + todo[k + 1 :])]
        frames.append((df.select(*keep).distinct() if len(keep) < len(df.columns) and keep else df, a))
    now: DataFrame | None = None
    if not unequal and all(f[0].columns != ["_one"] for f in frames) and (sizes := _sized(kb, todo)):
        if not any(v not in wanted for v in out) and (pairs := _by_classes(todo, [df for df, _ in frames], sizes, wanted)) is not None:
            return pairs.select(*out)
        now, frames = _greedy([df for df, _ in frames], sizes, needed([])), []
    frames.sort(key=lambda f: -sum(not is_var(t) for t in f[1]))
    while frames:
        k = 0
        if now is not None:
            have = set(now.columns)
            rank = lambda f: (not set(f[0].columns) <= have, not set(f[0].columns) & have)  # noqa: E731  semi-joins first, then joins
            k = min(range(len(frames)), key=lambda i: rank(frames[i]))
        df, atom = frames.pop(k)
        if now is None:
            now = df
        else:
            shared = [c for c in df.columns if c in now.columns]
            if not shared:
                # a part of the query that shares no variable: its satisfiability, or by the query's meaning all combinations
                now = now.crossJoin(df if set(df.columns) & needed([f[1] for f in frames]) else df.limit(1).select(F.lit(1).alias("_any"))).drop("_any")
            elif len(shared) == len(df.columns):
                now = now.join(df, shared, "left_semi")
            else:
                now = now.join(df, shared, "inner")
        for a in list(unequal):
            if all(not is_var(t) or t in now.columns for t in (a[0], a[2])):
                x, y = (F.col(t) if is_var(t) else F.lit(t) for t in (a[0], a[2]))
                now = now.filter(x != y)
                unequal.remove(a)
        keep = [c for c in now.columns if c in needed([f[1] for f in frames])]
        if keep and len(keep) < len(now.columns) and frames:
            now = now.select(*keep).distinct()
    if unequal:
        raise ValueError("differentFrom needs variables that another atom binds")
    if not wanted and not out:
        return now.limit(1).select(F.lit(1).alias("_one"))
    columns = [F.col(swap.get(v, v)).alias(v) if is_var(swap.get(v, v)) else F.lit(swap[v]).alias(v) for v in out]
    return now.select(*columns).distinct()
