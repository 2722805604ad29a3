"""Many rules of one shape in one plan.

Rules that differ only in relations and constants have the same joins. Their names stand in a small
table (rid, p0, p1, ..., c0, ...) that is joined with the facts, so that a generation of rules costs a
plan per shape and not a job per rule.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import DIFFERENT, Query, is_var, letters, rename, unfolded, variables
from hornspark.plans.pairs import Joints, join_order
from hornspark.sources.kb import KB

#: Rules in a table that is broadcast; longer lists go in several plans.
MOST = 10_000

Shape = tuple[tuple[str, str, str], ...]


def shape_of(rule: Query) -> tuple[Shape, tuple[str, ...]]:
    """The rule with ``@k`` for its k-th relation or constant, and those names. ``differentFrom`` is part of the shape.

    ``exists`` atoms are facts with a variable of their own there (``unfolded``): nothing asks for it, so they are semi-joined.
    """
    rule = unfolded(rename(rule, dict(zip(variables(rule), letters()))))
    names: list[str] = []

    def slot(t: str) -> str:
        if is_var(t) or t == DIFFERENT:
            return t
        names.append(t)
        return f"@{len(names) - 1}"

    return tuple((slot(s), slot(r), slot(o)) for s, r, o in rule), tuple(names)


def by_shape(rules: Iterable[tuple[int, Query]]) -> dict[Shape, list[tuple[int, tuple[str, ...]]]]:
    out: dict[Shape, list] = defaultdict(list)
    for rid, rule in rules:
        shape, names = shape_of(rule)
        out[shape].append((rid, names))
    return out


def chunks(rows: list, n: int = MOST) -> Iterable[list]:
    return (rows[i : i + n] for i in range(0, len(rows), n))


def by_order(known: Joints | None, shape: Shape, rows: Sequence[tuple[int, tuple[str, ...]]], head: bool = True) -> list[tuple[list[int] | None, list]]:
    """The rows by the order in which their atoms join best; a single list without statistics."""
    atoms = [a for a in (shape if head else shape[1:]) if a[1] != DIFFERENT]
    if known is None or len(atoms) < 3:
        return [(None, list(rows))]
    out: dict[tuple[int, ...], list] = defaultdict(list)
    for rid, names in rows:
        named = [tuple(names[int(t[1:])] if t.startswith("@") else t for t in a) for a in atoms]
        out[tuple(join_order(known, named))].append((rid, names))
    return [(list(order), own) for order, own in sorted(out.items())]


def _joined_before(order: Sequence, k: int, keep: Sequence[str]) -> bool:
    """Whether an atom has a variable of those before it or, as the first, one that is asked for later."""
    others = order[:k] if k else order[1:]
    return bool({t for t in (order[k][0], order[k][2]) if is_var(t)} & ({t for a in others for t in (a[0], a[2])} | (set(keep) if not k else set())))


def bindings(kb: KB, shape: Shape, rows: Sequence[tuple[int, tuple[str, ...]]], keep: Sequence[str], head: bool = True, order: Sequence[int] | None = None, distinct: bool = True) -> DataFrame:
    """Distinct (rid, *keep) of the rules' atoms together; without ``head``, of their bodies. ``order``: places of the atoms, those of differentFrom left out.

    Without ``distinct``, rows may come again.
    """
    n = len(rows[0][1])
    spark = kb.spark
    table = F.broadcast(spark.createDataFrame([(rid, *names) for rid, names in rows], ", ".join(["rid long", *(f"`@{i}` string" for i in range(n))])))
    atoms = list(shape if head else shape[1:])
    unequal = [a for a in atoms if a[1] == DIFFERENT]
    atoms = [a for a in atoms if a[1] != DIFFERENT]
    given, order = order, []
    if given is not None:
        order, atoms = [atoms[i] for i in given], []
    while atoms:  # each atom next to those before it
        have = {t for a in order for t in (a[0], a[2]) if is_var(t)}
        at = max(range(len(atoms)), key=lambda i: (len({t for t in (atoms[i][0], atoms[i][2]) if t in have}), sum(not is_var(t) for t in atoms[i]), -i))
        order.append(atoms.pop(at))
    # a rule alone needs no table of names, and its rows carry none
    alone = len(rows) == 1 and all(_joined_before(order, k, keep) for k in range(len(order)))
    bound = {f"@{i}": F.lit(name) for i, name in enumerate(rows[0][1])} if alone else {}
    ids = [] if alone else ["rid"]
    named = lambda t: bound.get(t, F.col(t))
    now: DataFrame | None = None
    for k, (s, r, o) in enumerate(order):
        later = {t for a in [*order[k + 1 :], *unequal] for t in (a[0], a[2])} | set(keep)
        relations = sorted({names[int(r[1:])] for _, names in rows})
        facts = kb.df.filter(F.col("p").isin(relations)) if len(relations) <= 200 else kb.df
        known = set(now.columns) if now is not None else set()
        used = {t for t in (s, o) if is_var(t) and (t in later or t in known)}
        want = [F.col(c).alias(f"_{c}") for c, t in (("s", s), ("o", o)) if not is_var(t) or t in used or s == o]
        facts = facts.select(*([] if alone else [F.col("p").alias("_p")]), *want)
        if len(want) < 2:
            facts = facts.distinct()
        on = [] if alone else [F.col("_p") == F.col(r)]
        fresh = {}
        for c, t in (("_s", s), ("_o", o)):
            if not is_var(t) or t in known:
                if c in facts.columns:
                    on.append(F.col(c) == named(t))
            elif t in fresh:
                on.append(F.col(fresh[t]) == F.col(c))
            elif t in used:
                fresh[t] = c
        if now is None and alone:
            now = reduce(DataFrame.filter, on, facts)
        elif not fresh and now is not None:
            now = now.join(facts, on, "left_semi")
        else:
            now = facts.join(table, on) if now is None else now.join(facts, on)
        names_left = [] if alone else sorted({a[1] for a in order[k + 1 :]} | {t for a in [*order[k + 1 :], *unequal] for t in (a[0], a[2]) if t.startswith("@")})
        columns = [c for c in now.columns if c in later and is_var(c)] + list(fresh)
        dropped = len(columns) < len([c for c in now.columns if is_var(c)]) + len(fresh)
        now = now.select(*ids, *names_left, *(F.col(fresh.get(c, c)).alias(c) for c in columns if c not in fresh or c in later))
        if dropped and k + 1 < len(order):
            now = now.distinct()
    for s, _, o in unequal:
        now = now.filter(named(s) != named(o))
    if alone:
        now = now.select(F.lit(rows[0][0]).cast("long").alias("rid"), *keep)
    now = now.select("rid", *keep)
    return now.distinct() if distinct else now
