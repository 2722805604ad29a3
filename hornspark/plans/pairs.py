"""What relations have in common: entities, side by side, and pairs of arguments.

Both tables have a row for each pair of relations and not for each fact, so the driver may hold them. They
answer refinements of single atoms without a join of bindings, say which atoms can follow which, and
how large a join of two atoms is before it is run.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import Query, is_special, is_var
from hornspark.sources.kb import KB


class Joint(NamedTuple):
    """Entities that two sides share, facts of the first with one of them, and pairs of facts that meet in one."""

    shared: int
    left: int
    size: int


Joints = dict[tuple[str, str, str, str], Joint]


def degrees(kb: KB) -> DataFrame:
    """(e, p, side, n): in how many facts of a relation an entity stands on a side."""
    ends = F.array(F.struct(F.lit("s").alias("side"), F.col("s").alias("e")), F.struct(F.lit("o").alias("side"), F.col("o").alias("e")))
    return kb.df.select("p", F.explode(ends).alias("x")).groupBy("x.e", "p", "x.side").agg(F.count(F.lit(1)).alias("n"))


def entity_pairs(kb: KB) -> DataFrame:
    """(p1, side1, p2, side2, shared, left, size) for all sides that share an entity. An entity's list is bounded by the relations."""
    held = degrees(kb).groupBy("e").agg(F.collect_list(F.struct("p", "side", "n")).alias("l"))
    both = held.select(F.explode("l").alias("x"), "l").select("x", F.explode("l").alias("y"))
    by = [F.col(c).alias(n) for c, n in (("x.p", "p1"), ("x.side", "side1"), ("y.p", "p2"), ("y.side", "side2"))]
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("shared"), F.sum("x.n").alias("left"), F.sum(F.col("x.n") * F.col("y.n")).alias("size"))


def fact_pairs(kb: KB, relations: Sequence[str] | None = None) -> DataFrame:
    """(p1, p2, inverse, n): facts (s, o) of p1 for which p2 has (s, o), or with ``inverse`` (o, s); of ``relations`` alone, where given."""
    ends = [F.least("s", "o").alias("lo"), F.greatest("s", "o").alias("hi")]
    held = (kb.df if relations is None else kb.df.filter(F.col("p").isin(list(relations)))).select(*ends, F.struct("p", (F.col("s") <= F.col("o")).alias("up")).alias("f")).groupBy("lo", "hi").agg(F.collect_list("f").alias("l"))
    loop = (F.col("lo") == F.col("hi")).alias("loop")
    both = held.select(loop, F.explode("l").alias("x"), "l").select("loop", "x", F.explode("l").alias("y"))
    inverse = F.when(F.col("loop"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("x.up") != F.col("y.up")))
    return both.select(F.col("x.p").alias("p1"), F.col("y.p").alias("p2"), F.explode(inverse).alias("inverse")).groupBy("p1", "p2", "inverse").agg(F.count(F.lit(1)).alias("n"))


def joints(kb: KB) -> Joints:
    return {(r.p1, r.side1, r.p2, r.side2): Joint(r.shared, r.left, r["size"]) for r in entity_pairs(kb).collect()}


def profiles(known: Joints) -> dict[str, dict]:
    """Per relation what ``stats.profile`` counts (variances left out): a side's entry with itself has its entities and facts."""
    out = {}
    for (p, side, q, other), own in known.items():
        if p == q and side == other == "s":
            no = known[p, "o", p, "o"].shared
            out[p] = {"p": p, "n": own.left, "ns": own.shared, "no": no, "fun": own.shared / own.left, "ifun": no / own.left, "functional_pos": 0 if own.shared >= no else 2}
    return out


def functional_sides(kb: KB, sides: Sequence[tuple[str, str]], known: Joints | None = None) -> set[tuple[str, str]]:
    """Of (relation, side), those whose entities have one fact each."""
    if known is not None:
        return {(p, side) for p, side in sides if (own := known.get((p, side, p, side))) is not None and own.shared == own.left}
    if not sides:
        return set()
    plans = [kb.df.filter(F.col("p").isin(sorted({p for p, c in sides if c == side}))).groupBy("p", F.col(side).alias("e")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side)) for side in sorted({c for _, c in sides})]
    found = plans[0] if len(plans) == 1 else plans[0].unionByName(plans[1])
    return {(r.p, r.side) for r in found.groupBy("p", "side").agg(F.max("n").alias("most")).filter("most = 1").collect()}


def meetable(known: Joints) -> list[tuple[str, str, bool]]:
    """(p1, p2, inverse) of two relations, or one and its inverse, that share entities on both sides: others have no fact in common."""
    names = sorted({p for p, _, _, _ in known})
    ends = {False: "so", True: "os"}
    return [(p, q, inverse) for p in names for q in names for inverse, (x, y) in ends.items() if (p != q or inverse) and (p, "s", q, x) in known and (p, "o", q, y) in known]


def _sides(atom) -> list[tuple[str, str]]:
    return [(v, side) for v, side in ((atom[0], "s"), (atom[2], "o")) if is_var(v)]


def fits(known: Joints, atoms: Query, new) -> bool:
    """Whether an atom shares an entity with each atom that has one of its variables; what always fails is left out."""
    if is_special(new[1]) or is_var(new[1]):
        return True
    return all((a[1], side, new[1], own) in known for v, own in _sides(new) for a in atoms if not is_special(a[1]) for w, side in _sides(a) if w == v)


def meeting(known: Joints, a, b) -> int | None:
    """How many pairs of facts of two atoms meet in the shared variable where fewest do; None without a shared one."""
    found = [known.get((a[1], x, b[1], y), Joint(0, 0, 0)).size for v, x in _sides(a) for w, y in _sides(b) if v == w]
    return min(found) if found else None


def join_order(known: Joints, atoms: Sequence) -> list[int]:
    """An order that starts with the cheapest pair and goes on with atoms whose variables are bound."""
    n = len(atoms)
    pairs = [(size, i, j) for i in range(n) for j in range(i + 1, n) if (size := meeting(known, atoms[i], atoms[j])) is not None]
    if n < 3 or not pairs:
        return list(range(n))
    _, *out = min(pairs)
    while len(out) < n:
        have = {v for i in out for v, _ in _sides(atoms[i])}

        def rank(i: int) -> tuple:
            free = [v for v, _ in _sides(atoms[i]) if v not in have]
            met = [size for j in out if (size := meeting(known, atoms[i], atoms[j])) is not None]
            return len(free), not met, min(met, default=0), i

        out.append(min((i for i in range(n) if i not in out), key=rank))
    return out


def _plain(atoms: Query) -> bool:
    return not any(is_special(a[1]) or is_var(a[1]) or len({v for v, _ in _sides(a)}) != 2 for a in atoms)


def counted_single(known: Joints, atoms: Query, functional: int) -> int | None:
    """The functional arguments of a head with a fact of one further atom in one of its variables, where the counts of pairs tell them; else None."""
    if len(atoms) != 2 or not _plain(atoms):
        return None
    (head, new), f = atoms, "s" if functional == 0 else "o"
    met = [(x, y) for v, x in _sides(head) for w, y in _sides(new) if v == w]
    if len(met) != 1:
        return None
    ((x, y),) = met
    own, joint = known[head[1], f, head[1], f], known.get((head[1], x, new[1], y), Joint(0, 0, 0))
    if x == f:
        return joint.shared
    if joint.left == own.left:  # no fact of the head is without
        return own.shared
    return joint.left if own.shared == own.left or not joint.left else None


def counted_body(known: Joints, atoms: Query, functional: int, pca: bool) -> int | None:
    """The functional arguments of a body of one or two atoms of which one has the functional variable, as ``counted_single``; with ``pca``, those that the head relation has."""
    if len(atoms) not in (2, 3) or not _plain(atoms):
        return None
    f, side = atoms[0][functional], "s" if functional == 0 else "o"
    first, *others = sorted(atoms[1:], key=lambda a: f not in (a[0], a[2]))
    if f not in (first[0], first[2]) or any(f in (a[0], a[2]) for a in others):
        return None
    place = 0 if first[0] == f else 2
    own_side = "so"[place // 2]
    own, there = known[first[1], own_side, first[1], own_side], known.get((first[1], own_side, atoms[0][1], side), Joint(0, 0, 0))
    size = counted_single(known, (first, *others), place) if others else own.shared
    if not pca or there.left == own.left:
        return size
    every = all(met.left == own.left for met in (known.get((first[1], x, a[1], y), Joint(0, 0, 0)) for a in others for v, x in _sides(first) for w, y in _sides(a) if v == w))
    return there.shared if every and (not others or size is not None) else None
