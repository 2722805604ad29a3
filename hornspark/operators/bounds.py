"""Cheap bounds and estimates of confidence, from statistics alone."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from hornspark.functions.rules import Rule, path_between
from hornspark.functions.terms import hard_pair, is_special, is_var, variables
from hornspark.plans.compile import bind
from hornspark.plans.pairs import Joints
from hornspark.plans.refine import body_sizes, products
from hornspark.sources.kb import KB


def _body_pair(rule: Rule) -> int | None:
    """For ``r(x, z) r(y, z) => head``, the place (0 or 2) in which the body's atoms meet."""
    if len(rule.atoms) != 3 or hard_pair(rule.atoms[1:]) is None:
        return None
    a, b = rule.atoms[1:]
    return 0 if a[0] == b[0] else 2


def upper_bounds(rules: Sequence[Rule], stats: dict[str, dict], known: Joints) -> list[Rule]:
    """Rules with std and PCA upper bounds where their bodies are two atoms of one relation that share an argument.

    Each value on the free side pairs with itself, so the body has at least as many pairs as such values;
    under PCA, as many as also stand in the head's functional place. ``stats`` and ``known`` say both without a job.
    """
    out = []
    for r in rules:
        place = _body_pair(r)
        if place is not None:
            p, free = r.atoms[1][1], "o" if place == 0 else "s"
            std = stats[p]["no" if free == "o" else "ns"]
            pca = known.get((p, free, r.atoms[0][1], "s" if r.functional == 0 else "o"))
            r = replace(r, std_upper_bound=r.support / std if std else None, pca_upper_bound=r.support / pca.shared if pca else None)
        out.append(r)
    return out


def pca_estimates(rules: Sequence[Rule], stats: dict[str, dict], known: Joints) -> list[Rule]:
    """Rules with an estimate of PCA confidence where the body is a path between the head's variables, of any length.

    From the head's functional variable on: the entities that head and first atom share, times the first atom's values
    per entity; then for each further atom the share of values that have it, times its values per entity over their repeats.
    """
    def size_of(r: Rule) -> float | None:
        head = r.atoms[0]
        path = path_between(r.atoms[1:], head[r.functional], head[2 - r.functional]) if len(r.atoms) > 2 and is_var(head[0]) and is_var(head[2]) else None
        if path is None or any(is_special(a[1]) or a[1] not in stats for a in path):
            return None
        at = head[r.functional]
        before, side = head[1], "s" if r.functional == 0 else "o"
        size = 1.0
        for k, (s, p, o) in enumerate(path):
            here, there = ("s", "o") if s == at else ("o", "s")
            met = known.get((before, side, p, here))
            if met is None:
                return None
            fun, inverse = ("fun", "ifun") if here == "s" else ("ifun", "fun")
            if k == 0:
                size *= met.shared / stats[p][fun]
            else:
                size *= met.shared * stats[p][inverse] / (stats[before]["ns" if side == "s" else "no"] * stats[p][fun])
            at, before, side = (o if here == "s" else s), p, there
        return size

    return [replace(r, pca_estimate=r.support / size) if (size := size_of(r)) else r for r in rules]


def rule_metrics(kb: KB, rule, functional: int | None = None):
    """One row for a rule: head size, support, body and PCA body sizes, and the three ratios.

    Bodies, supports and sizes are counted in one plan over the body's distinct head pairs, or without any pair where degrees count bodies.
    """
    head, body = rule[0], tuple(rule[1:])
    if functional is None:
        row = kb.facts(head[1]).agg(F.count_distinct("s").alias("ns"), F.count_distinct("o").alias("no")).first()
        functional = 0 if row.ns >= row.no else 2
    pair = variables([head])
    f = head[functional] if is_var(head[functional]) else pair[0]
    place = "s" if head[0] == f else "o"
    if products(kb, [(0, rule)]):
        n = lambda df, c: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(c))
        whole = bind(kb, rule, pair).agg(F.count(F.lit(1)).alias("support"))
        size = kb.facts(head[1]).agg(F.count(F.lit(1)).alias("head_size"))
        own = [(0, rule, functional)]
        row = size.crossJoin(whole).crossJoin(n(body_sizes(kb, own, False), "body_size")).crossJoin(n(body_sizes(kb, own, True), "pca_body_size"))  # one row each
        return _ratios(row)
    held = bind(kb, [head], pair).withColumn("_h", F.lit(1))
    known = kb.facts(head[1]).select(F.col(place).alias(f)).distinct().withColumn("_f", F.lit(1))
    counts = bind(kb, body, pair).join(held, pair, "left").join(known, f, "left").agg(F.count("_h").alias("support"), F.count(F.lit(1)).alias("body_size"), F.count("_f").alias("pca_body_size"))
    size = kb.facts(head[1]).agg(F.count(F.lit(1)).alias("head_size"))
    return _ratios(size.crossJoin(counts))  # one row each


def _ratios(row):
    return row.select(
        "head_size", "support", "body_size", "pca_body_size",
        F.round(F.try_divide("support", "head_size"), 9).alias("head_coverage"),
        F.round(F.try_divide("support", "body_size"), 9).alias("std_confidence"),
        F.round(F.try_divide("support", "pca_body_size"), 9).alias("pca_confidence"),
    )
