"""Conjunctive queries: satisfiability, distinct bindings, counts, histograms and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import Atom, Query, is_special, is_var, parse_query, variables
from hornspark.plans.compile import bind, scan
from hornspark.plans.pairs import functional_sides
from hornspark.plans.refine import legs
from hornspark.sources.kb import KB


def _atoms(query: str | Sequence[Atom]) -> Query:
    return parse_query(query) if isinstance(query, str) else tuple(query)


def select(kb: KB, out: Sequence[str], query: str | Sequence[Atom]) -> DataFrame:
    """Distinct bindings, a column per variable without its question mark."""
    df = bind(kb, _atoms(query), out)
    return df.select(*(F.col(v).alias(v.lstrip("?")) for v in out))


def satisfiable(kb: KB, query: str | Sequence[Atom]) -> DataFrame:
    """One row: ``found``."""
    return bind(kb, _atoms(query), []).agg((F.count(F.lit(1)) > 0).alias("found"))


def exists(kb: KB, query: str | Sequence[Atom]) -> bool:
    return bool(satisfiable(kb, query).first().found)


def matches(kb: KB, atom: str | Atom) -> DataFrame:
    """All bindings of one atom."""
    (a,) = _atoms(atom) if isinstance(atom, str) else (atom,)
    df = scan(kb, a)
    return df.select(*(F.col(c).alias(c.lstrip("?")) for c in df.columns))


def count_atom(kb: KB, atom: str | Atom) -> DataFrame:
    """One row: ``n``, the matches of an atom (0 or 1 without variables)."""
    return matches(kb, atom).agg(F.count(F.lit(1)).alias("n"))


def count(kb: KB, out: Sequence[str], query: str | Sequence[Atom]) -> DataFrame:
    """One row: ``n``, the distinct bindings of one or more variables."""
    return bind(kb, _atoms(query), out).agg(F.count(F.lit(1)).alias("n"))


def count_up_to(kb: KB, bound: int, out: Sequence[str], query: str | Sequence[Atom]) -> DataFrame:
    """As ``count``, but what is over ``bound`` counts as bound + 1."""
    return bind(kb, _atoms(query), out).limit(bound + 1).agg(F.count(F.lit(1)).alias("n"))


def approximate_count(kb: KB, out: Sequence[str], query: str | Sequence[Atom], error: float = 0.02) -> DataFrame:
    """An estimate of ``count`` without a distinct over the bindings."""
    atoms = _atoms(query)
    now = scan(kb, atoms[0])
    for a in atoms[1:]:
        df = scan(kb, a)
        now = now.join(df, [c for c in df.columns if c in now.columns])
    return now.agg(F.approx_count_distinct(F.struct(*(F.col(v) for v in out)), error).alias("n"))


def count_projection(kb: KB, head: str | Atom, body: str | Sequence[Atom]) -> DataFrame:
    """One row: ``n``, the distinct groundings of ``head`` for which ``body`` holds (the support of a rule)."""
    (h,) = _atoms(head) if isinstance(head, str) else (head,)
    return count(kb, variables([h]), (h, *_atoms(body)))


def projection_bindings(kb: KB, head: str | Atom, body: str | Sequence[Atom], v: str) -> DataFrame:
    """Per value of v in the body, ``n``: the distinct groundings of ``head``."""
    (h,) = _atoms(head) if isinstance(head, str) else (head,)
    out = list(dict.fromkeys([v, *variables([h])]))
    return bind(kb, (h, *_atoms(body)), out).groupBy(F.col(v).alias(v.lstrip("?"))).agg(F.count(F.lit(1)).alias("n"))


def frequent_bindings(kb: KB, v: str, projected: str, query: str | Sequence[Atom]) -> DataFrame:
    """Per value of v, ``n``: the distinct values of another variable."""
    df = bind(kb, _atoms(query), list(dict.fromkeys([v, projected])))
    return df.groupBy(F.col(v).alias(v.lstrip("?"))).agg(F.count(F.lit(1)).alias("n"))


def value_counts(kb: KB, atom: str | Atom, position: str) -> DataFrame:
    """Per value of a variable of one atom, ``n`` matches."""
    return matches(kb, atom).groupBy(position.lstrip("?")).agg(F.count(F.lit(1)).alias("n"))


def difference(kb: KB, out: Sequence[str], body: str | Sequence[Atom], head: str | Sequence[Atom]) -> DataFrame:
    """Bindings of ``out`` in the body for which the head cannot be satisfied."""
    body, head = _atoms(body), _atoms(head)
    if (pairs := _pairs_without(kb, out, body, head)) is not None:
        return pairs
    shared = [v for v in out if v in variables(head)]
    left = bind(kb, body, out)
    if not shared:
        none = bind(kb, head, [])
        left = left.join(none.withColumn("_k", F.lit(1)).select("_k"), F.lit(1) == F.col("_k"), "left_anti")
    else:
        left = left.join(bind(kb, head, shared), shared, "left_anti")
    return left.select(*(F.col(v).alias(v.lstrip("?")) for v in out))


def _pairs_without(kb: KB, out: Sequence[str], body: Sequence[Atom], head: Sequence[Atom]) -> DataFrame | None:
    """``difference`` of the pairs of two atoms that meet in one variable and a single atom over both, where one end has one fact each.

    No pair is there twice then, and each subject takes its own objects to leave out along: pairs are made last, and not shuffled.
    """
    if len(head) != 1 or len(out) != 2 or is_var(head[0][1]) or is_special(head[0][1]) or set(out) != set(variables(head)):
        return None
    both = legs((head[0], *body))
    if both is None or not functional_sides(kb, [(r, e) for r, e, _, _ in both]):
        return None
    sides = {end: kb.facts(r).select(F.col(e).alias("_e"), F.col(z).alias("_z")) for r, e, z, end in both}
    a, b = variables(head)
    mine, theirs = sides[a].withColumnRenamed("_e", "s"), sides[b].withColumnRenamed("_e", "o")
    own = kb.facts(head[0][1]).join(theirs, "o").join(mine, ["s", "_z"], "left_semi").groupBy("s").agg(F.collect_set("o").alias("_own"))
    pairs = mine.join(own, "s", "left").join(theirs, "_z").filter(F.col("_own").isNull() | ~F.array_contains("_own", F.col("o")))
    return pairs.select(*(F.col("s" if v == a else "o").alias(v.lstrip("?")) for v in out))


def run_text(kb: KB, text: str) -> DataFrame:
    """``?x ?y | s r o  s r o``: the distinct bindings."""
    names, atoms = text.split("|", 1)
    out = [v for v in names.split() if is_var(v)]
    return select(kb, out, atoms)
