"""Refinement of a generation of rules: dangling, closing, instantiated and type-specialising atoms, counted in one plan per shape."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.rules import canonical
from hornspark.functions.terms import OWN, Query, asked_variables, is_special, is_unfolded, is_var, letters, rename, unfolded, variables
from hornspark.plans.batch import MOST, bindings, by_order, by_shape, chunks
from hornspark.plans.pairs import Joints, degrees, fact_pairs, fits, functional_sides, joints, meetable
from hornspark.sources.kb import KB

#: New atoms: (kind, joined variables, relation, constant, support); a joined pair is (subject, object), a single one has its place.
CANDIDATE = "rid long, kind string, u string, v string, p string, c string, support long"


def _from_heads(kb: KB, asked: Sequence[tuple[int, str, str, str, str, int]], known: Joints) -> list[DataFrame]:
    """Candidates next to single atoms with two variables, from what relations have in common. asked: (rid, relation, kind, u, v, threshold)."""
    wanted = F.broadcast(kb.spark.createDataFrame([(*a, "s" if a[3] == "?a" else "o", a[3] == "?b") for a in asked], "rid long, p1 string, kind string, u string, v string, t long, side1 string, inverse boolean"))
    constant = F.lit(None).cast("string").alias("c")
    columns = ["rid", "kind", "u", "v", "p"]
    kinds, out = {a[2] for a in asked}, []
    rows = []
    for rid, p, kind, u, v, t in asked:
        if kind == "dangling":
            rows += [(rid, kind, u, v, q, None, met.left) for (p1, x, q, y), met in known.items() if (p1, x, y) == (p, "s" if u == "?a" else "o", v) and met.left >= t]
        elif kind == "closing" and u != "?b" and (p, "s", p, "s") in known and known[p, "s", p, "s"].left >= t:
            rows.append((rid, kind, u, v, p, None, known[p, "s", p, "s"].left))  # the facts themselves
    if rows:
        out.append(kb.spark.createDataFrame(rows, CANDIDATE))
    if "closing" in kinds and (pairs := meetable(known)):
        found = fact_pairs(kb, sorted({p for pair in pairs for p in pair[:2]})).filter("p1 <> p2 or inverse").join(wanted.filter("kind = 'closing'"), ["p1", "inverse"]).filter("n >= t")
        out.append(found.withColumnRenamed("p2", "p").select(*columns, constant, F.col("n").alias("support")))
    if "instantiated" in kinds:
        heads = degrees(kb).withColumnRenamed("p", "p1").withColumnRenamed("side", "side1").join(wanted.filter("kind = 'instantiated'"), ["p1", "side1"])
        ends = F.array(F.struct(F.lit("s").alias("v"), F.col("s").alias("e"), F.col("o").alias("c")), F.struct(F.lit("o").alias("v"), F.col("o").alias("e"), F.col("s").alias("c")))
        facts = kb.df.select("p", F.explode(ends).alias("x")).select("p", "x.v", "x.e", "x.c")
        found = facts.join(heads.select("rid", "kind", "u", "v", "t", "e", "n"), ["e", "v"]).groupBy(*columns, "c", "t").agg(F.sum("n").alias("support"), F.count(F.lit(1)).alias("values"))
        out.append(found.filter("support >= t and values >= 2").select(*columns, "c", "support"))
    return out


def _joined(base: DataFrame, kb: KB, head: list[str], kind: str, u: str, v: str, weight: DataFrame | None) -> DataFrame:
    """Supports of dangling and instantiated atoms on the bindings ``base`` of the parents.

    With ``weight`` (rid, x, n), the bindings are those of bodies that touch the head in x alone, and each x stands for its n head facts.
    """
    facts = kb.df.select(F.col("p"), F.col("s").alias("_s"), F.col("o").alias("_o"))
    column, other = ("_s", "_o") if v == "s" else ("_o", "_s")
    by = ["rid", "p"]
    if kind == "dangling":
        out = base.join(facts.select("p", F.col(column).alias("_e")).distinct(), F.col(u) == F.col("_e")).withColumn("c", F.lit(None).cast("string"))
    else:
        out = base.join(facts, F.col(u) == F.col(column)).withColumn("c", F.col(other))
        by.append("c")
    values = [F.min(F.col(u)).alias("_lo"), F.max(F.col(u)).alias("_hi")]
    per = out.groupBy(*by, *(F.col(x) for x in head)).agg(*values)
    if weight is not None:
        per = per.join(weight, ["rid", *head])
    support = F.sum("n") if weight is not None else F.count(F.lit(1))
    out = per.groupBy(*by).agg(support.alias("support"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    out = out.filter("_lo <> _hi") if kind == "instantiated" else out.withColumn("c", F.lit(None).cast("string"))
    return out.select("rid", F.lit(kind).alias("kind"), F.lit(u).alias("u"), F.lit(v).alias("v"), "p", "c", "support")


def _bodies(kb: KB, shape, rows, head: list[str], u: str) -> tuple[DataFrame, list[str], DataFrame | None]:
    """(bindings, head variables among them, weight) for atoms on ``u``: of bodies alone where these touch the head in one variable."""
    met = [x for x in head if x in variables(shape[1:])]
    if len(head) == 2 and len(met) == 1 and u in variables(shape[1:]):
        (x,) = met
        side = "s" if shape[0][0] == x else "o"
        relation = int(shape[0][1][1:])
        names = F.broadcast(kb.spark.createDataFrame([(rid, n[relation]) for rid, n in rows], "rid long, p string"))
        weight = kb.df.join(names, "p").groupBy("rid", F.col(side).alias(x)).agg(F.count(F.lit(1)).alias("n"))
        return bindings(kb, shape, rows, list(dict.fromkeys([x, u])), head=False), [x], weight
    return bindings(kb, shape, rows, list(dict.fromkeys([*head, u]))), head, None


def refinements(kb: KB, parents: Sequence[tuple[int, Query, int]], wants, known: Joints | None = None, left_out: Sequence[str] = (), count=None) -> DataFrame | None:
    """Candidates with their supports over the parents' thresholds.

    parents: (rid, rule, threshold). wants(rule): the (kind, u, v) that a rule asks for, in its own names;
    the result names variables as ``letters`` do, in order of first use. ``known``: what the store's relations share.
    Single atoms are answered from counts of what relations have in common. A closing atom next to longer rules is
    tried with the relations that can share entities with all its neighbours, each candidate counted in its cheapest order.
    Relations ``left_out`` are no candidates. ``count`` takes the place of ``support_counts`` for closing atoms next to longer rules.
    """
    limit = {rid: t for rid, _, t in parents}
    rule_of = {rid: rule for rid, rule, _ in parents}
    plans, asked, closing = [], [], []
    for shape, rows in by_shape((rid, rule) for rid, rule, _ in parents).items():
        groups: dict[tuple, list] = {}
        alone = len(shape) == 1 and len(variables(shape)) == 2
        for rid, names in rows:
            own = dict(zip(variables(rule_of[rid]), letters()))
            for kind, u, v in wants(rule_of[rid]):
                u, v = own.get(u, u), own.get(v, v)
                if alone:
                    asked.append((rid, names[0], kind, u, v, limit[rid]))
                elif kind == "closing":
                    closing.append((rid, rename(rule_of[rid], own), u, v))
                else:
                    groups.setdefault((kind, u, v), []).append((rid, names))
        head = asked_variables(shape[0])
        for (kind, u, v), own_rows in groups.items():
            for part in chunks(own_rows):
                base, met, weight = _bodies(kb, shape, part, head, u)
                least = F.broadcast(kb.spark.createDataFrame([(rid, limit[rid]) for rid, _ in part], "rid long, t long"))
                plans.append(_joined(base, kb, met, kind, u, v, weight).join(least, "rid").filter("support >= t").drop("t"))
    if asked or closing:
        known = joints(kb) if known is None else known
    for part in chunks(asked):
        plans += _from_heads(kb, part, known)
    if closing:
        relations = sorted({p for p, _, _, _ in known}.difference(left_out))
        made = [(rid, (*rule, (u, p, v)), u, v, p) for rid, rule, u, v in closing for p in relations if fits(known, unfolded(rule), (u, p, v))]
        same: dict[Query, list] = {}  # a rule that two parents lead to is counted once
        for m in made:
            same.setdefault(canonical(m[1]) if len(m[1]) <= 5 else m[1], []).append(m)
        for part in chunks(list(same.values()), 10 * MOST):
            if counts := (count or support_counts)(kb, [(k, own[0][1]) for k, own in enumerate(part)], known):
                names = F.broadcast(kb.spark.createDataFrame([(k, rid, "closing", u, v, p, limit[rid]) for k, own in enumerate(part) for rid, _, u, v, p in own], "k long, rid long, kind string, u string, v string, p string, t long"))
                found = counts.withColumnRenamed("rid", "k").join(names, "k").filter("support >= t")
                plans.append(found.select("rid", "kind", "u", "v", "p", F.lit(None).cast("string").alias("c"), "support"))
    if not plans:
        return None
    found = reduce(DataFrame.unionByName, plans)
    return found.filter(~F.col("p").isin(list(left_out))) if left_out else found


def support_counts(kb: KB, rules: Sequence[tuple[int, Query]], known: Joints | None = None) -> DataFrame | None:
    """(rid, support) of whole rules."""
    plans = [
        bindings(kb, shape, part, asked_variables(shape[0]), order=order).groupBy("rid").agg(F.count(F.lit(1)).alias("support"))
        for shape, rows in by_shape(rules).items()
        for order, own in by_order(known, shape, rows)
        for part in chunks(own)
    ]
    return reduce(DataFrame.unionByName, plans) if plans else None


def single_counts(kb: KB, rules: Sequence[tuple[int, Query, str]], known: Joints | None = None) -> DataFrame | None:
    """(rid, support) of whole rules, as values of one variable each. rules: (rid, rule, variable).

    Rules of the same atoms, whichever is the head, are joined once, and each counts its own variable of that.
    """
    sets: dict[Query, dict[str, list[int]]] = {}
    for rid, rule, v in rules:
        atoms, v = _unordered(rule, v)
        sets.setdefault(atoms, {}).setdefault(v, []).append(rid)
    asked = list(sets.items())
    groups: dict[tuple, list] = {}
    for shape, rows in by_shape((k, atoms) for k, (atoms, _) in enumerate(asked)).items():
        for order, own in by_order(known, shape, rows):
            for k, names in own:
                groups.setdefault((shape, tuple(order) if order else None, tuple(sorted(asked[k][1]))), []).append((k, names))
    plans = []
    for (shape, order, keep), rows in groups.items():
        for part in chunks(rows):
            found = bindings(kb, shape, part, keep, order=order, distinct=len(keep) == 1).withColumnRenamed("rid", "k")
            if len(keep) > 1:
                found = found.select("k", F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col(v).alias("x")) for v in keep))).alias("x")).select("k", "x.v", "x.x").distinct()
            else:
                found = found.select("k", F.lit(keep[0]).alias("v"), F.col(keep[0]).alias("x"))
            names = F.broadcast(kb.spark.createDataFrame([(k, v, rid) for k, _ in part for v, rids in asked[k][1].items() for rid in rids], "k long, v string, rid long"))
            plans.append(found.groupBy("k", "v").agg(F.count(F.lit(1)).alias("support")).join(names, ["k", "v"]).select("rid", "support"))
    return reduce(DataFrame.unionByName, plans) if plans else None


def _unordered(rule: Query, v: str) -> tuple[Query, str]:
    """One form, in letters, for all rules of the same atoms in whatever order, and a variable's name in it."""
    def form(atoms):
        own = dict(zip(variables(atoms), letters()))
        return rename(atoms, own), own[v]

    return min(map(form, permutations(rule))) if len(rule) <= 5 else form(rule)


def _existential(shape, functional: int) -> tuple[str, str | None]:
    """The head's functional variable, and its other one."""
    s, _, o = shape[0]
    f, other = (s, o) if functional == 0 else (o, s)
    if not is_var(f) or f.startswith(OWN):
        f, other = other, None
    return f, other if other is not None and is_var(other) else None


def body_sizes(kb: KB, rules: Sequence[tuple[int, Query, int]], pca: bool, single: bool = False, known: Joints | None = None) -> DataFrame | None:
    """(rid, n): distinct head pairs of the bodies; with ``pca``, those whose functional argument the head relation has.

    Of a head ``r exists x``, any relation's x count. rules: (rid, rule, functional position). With ``single``, functional arguments alone are counted. No pair is made where
    degrees count them (``products``).
    """
    plans = []
    groups: dict[tuple, list] = {}
    counted = set() if single else products(kb, [(rid, rule) for rid, rule, _ in rules], known)
    by_degrees: dict[tuple, list] = {}
    for rid, rule, functional in rules:
        ((shape, rows),) = by_shape([(rid, rule)]).items()
        if rid in counted:
            by_degrees.setdefault((shape, functional), []).extend(rows)
            continue
        groups.setdefault((shape, functional if pca or single else 0), []).extend(rows)
    for (shape, functional), rows in groups.items():
        in_body = set(variables(shape[1:]))
        keep = [v for v in asked_variables(shape[0]) if v in in_body]
        if single:
            keep = [v for v in keep if v == _existential(shape, functional)[0]] or keep
        for order, part in ((order, part) for order, own in by_order(known, shape, rows, head=False) for part in chunks(own)):
            pairs = bindings(kb, shape, part, keep, head=False, order=order)
            f, _ = _existential(shape, functional)
            if pca and is_unfolded(shape[0]):  # of an exists head any relation is enough, and mostly one of the body's
                side = 0 if f == shape[0][0] else 2
                if not any(a[side] == f for a in shape[1:]):
                    pairs = pairs.join(kb.df.select(F.col("so"[side // 2]).alias(f)), f, "left_semi")
            elif pca and f in keep:  # an open rule's body may not have it
                side = "s" if f == shape[0][0] else "o"
                relation = int(shape[0][1][1:])
                names = F.broadcast(kb.spark.createDataFrame([(rid, n[relation]) for rid, n in part], "rid long, _r string"))
                heads = kb.df.filter(F.col("p").isin(sorted({n[relation] for _, n in part})))
                there = heads.select(F.col("p").alias("_r"), F.col(side).alias(f)).distinct().join(names, "_r").select("rid", f)
                pairs = pairs.join(there, ["rid", f], "left_semi")
            plans.append(pairs.groupBy("rid").agg(F.count(F.lit(1)).alias("n")))
    for (shape, functional), rows in by_degrees.items():
        plans += [_degrees(kb, shape, part, functional, pca).groupBy("rid").agg(F.sum(F.col("d0") * F.col("d1")).alias("n")) for part in chunks(rows)]
    return reduce(DataFrame.unionByName, plans) if plans else None


def legs(shape) -> list[tuple[str, str, str, str]] | None:
    """For a body of two atoms that meet in one variable which the head lacks, with a head variable each: (relation, end, meeting side, head variable).

    Unfolded ``exists`` atoms on any of the three may stand beside them.
    """
    head, body = variables([shape[0]]), [a for a in shape[1:] if not is_unfolded(a)]
    if len(body) != 2 or len(head) != 2 or any(is_special(a[1]) or is_var(a[1]) or len(variables([a])) != 2 for a in body):
        return None
    shared = set(variables([body[0]])) & set(variables([body[1]]))
    ends = [[t for t in variables([a]) if t in head] for a in body]
    if len(shared) != 1 or shared & set(head) or any(len(x) != 1 for x in ends) or ends[0] == ends[1]:
        return None
    return [(r, "s" if s == end else "o", "o" if s == end else "s", end) for (s, r, o), (end,) in zip(body, ends, strict=True)]


def _degrees(kb: KB, shape, part, functional: int, pca: bool, weighted: bool = False) -> DataFrame:
    """(rid, z, d0, d1): facts on both sides of the value in which a body's atoms meet; with ``pca``, those whose functional argument the head relation has.

    ``weighted`` adds w0 and w1, where each fact counts as its share of the facts that its end has in the atom.
    """
    f, _ = _existential(shape, functional)
    n = len(part[0][1])
    table = F.broadcast(kb.spark.createDataFrame([(rid, *names) for rid, names in part], ", ".join(["rid long", *(f"`@{i}` string" for i in range(n))])))
    named = lambda slot: sorted({names[int(slot[1:])] for _, names in part})
    out = []
    for k, (r, e, z, end) in enumerate(legs(shape)):
        (met,) = {t for a in shape[1:] if a[1] == r for t in (a[0], a[2])} - {end}
        beside = [a for a in shape[1:] if is_unfolded(a) and (end in a or met in a)]
        facts = kb.df.filter(F.col("p").isin(named(r))).join(table.select("rid", F.col(r).alias("_p"), F.col(shape[0][1]).alias("_r"), *(a[1] for a in beside)), F.col("p") == F.col("_p"))
        for a in beside:
            column = e if end in a else z
            have = kb.df.filter(F.col("p").isin(named(a[1]))).select(F.col("p").alias(a[1]), F.col("o" if a[0].startswith(OWN) else "s").alias(column)).distinct()
            facts = facts.join(have, [a[1], column], "left_semi")
        if pca and end == f:
            column = "s" if f == shape[0][0] else "o"
            there = kb.df.filter(F.col("p").isin(named(shape[0][1]))).select(F.col("p").alias("_r"), F.col(column).alias(e)).distinct()
            facts = facts.join(there, ["_r", e], "left_semi")
        counts = [F.count(F.lit(1)).alias(f"d{k}")]
        if weighted:
            facts = facts.select("rid", e, z)
            facts = facts.join(facts.groupBy("rid", e).agg(F.count(F.lit(1)).alias("_n")), ["rid", e])
            counts.append(F.sum(F.lit(1.0) / F.col("_n")).alias(f"w{k}"))
        out.append(facts.groupBy("rid", F.col(z).alias("z")).agg(*counts))
    return out[0].join(out[1], ["rid", "z"])


def least_bodies(kb: KB, rules: Sequence[tuple[int, Query, int]], pca: bool) -> DataFrame | None:
    """(rid, n): a cheap lower bound of ``body_sizes`` for bodies of two atoms that meet in one variable.

    All pairs through one value of the shared variable are distinct, so the largest product of its
    degrees on both sides is a bound. A pair meets in at most as many values as either end has facts, so all products,
    with the facts of one side as shares of their ends', are another. They cost counts by key and no pair.
    """
    groups: dict[tuple, list] = {}
    for rid, rule, functional in rules:
        ((shape, rows),) = by_shape([(rid, rule)]).items()
        if legs(shape):
            groups.setdefault((shape, functional), []).extend(rows)
    shares = [F.floor(F.sum(F.col(x) * F.col(y)) * (1 - 1e-9)) for x, y in (("w0", "d1"), ("d0", "w1"))]
    least = F.greatest(F.max(F.col("d0") * F.col("d1")), *shares).alias("n")
    plans = [_degrees(kb, shape, part, functional, pca, True).groupBy("rid").agg(least) for (shape, functional), rows in groups.items() for part in chunks(rows)]
    return reduce(DataFrame.unionByName, plans) if plans else None


def products(kb: KB, rules: Sequence[tuple[int, Query]], known: Joints | None = None) -> set[int]:
    """Rules with a body as of ``legs`` where each end of one atom has a single fact: a pair of ends meets in one value, so degrees count the pairs."""
    sides: dict[int, list[tuple[str, str]]] = {}
    for rid, rule in rules:
        ((shape, ((_, names),)),) = by_shape([(rid, rule)]).items()
        if own := legs(shape):
            sides[rid] = [(names[int(r[1:])], e) for r, e, _, _ in own]
    single = functional_sides(kb, sorted({x for own in sides.values() for x in own}), known)
    return {rid for rid, own in sides.items() if single & set(own)}


def with_atom(rule: Query, kind: str, u: str, v: str, p: str, c: str | None) -> Query:
    """The rule, in letters, with a candidate's atom."""
    rule = rename(rule, dict(zip(variables(rule), letters())))
    if kind == "closing":
        return (*rule, (u, p, v))
    used = set(variables(rule))
    other = c if kind == "instantiated" else next(x for x in letters() if x not in used)
    return (*rule, (u, p, other) if v == "s" else (other, p, u))
