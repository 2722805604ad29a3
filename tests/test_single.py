"""Counts over the functional variable alone, next to brute force."""

import random
from itertools import product

import pytest

from hornspark.functions.terms import variables
from hornspark.plans import mine as module
from hornspark.plans import refine
from hornspark.plans.mine import Miner, MiningConfig
from hornspark.plans.pairs import counted_body, counted_single, joints
from hornspark.sources.kb import KB

#: Of "a" all lead on by "q", of "p" some; "u" has one fact a subject.
SPREAD = {"p": ("a", "z", 40), "q": ("z", "b", 12), "h": ("a", "b", 30), "r": ("y", "b", 9)}


def facts_of(seed: int) -> set[tuple[str, str, str]]:
    rng = random.Random(seed)
    facts = {(f"{s}{rng.randrange(10)}", r, f"{o}{rng.randrange(6)}") for r, (s, o, n) in SPREAD.items() for _ in range(n)}
    return facts | {(f"a{k}", "u", f"z{k % 4}") for k in range(12)} | {(f"z{k}", "w", f"b{k % 2}") for k in range(10)}


def held(facts, atoms, v) -> set[str]:
    """The values of a variable, by trying all bindings atom after atom."""
    found = [{}]
    for s, p, o in atoms:
        found = [b | {s: x, o: y} for b in found for x, r, y in facts if r == p and b.get(s, x) == x and b.get(o, y) == y and (s != o or x == y)]
    return {b[v] for b in found}


def store(spark, facts) -> KB:
    return KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_told_by_pairs_of_relations(spark, seed):
    facts = facts_of(seed)
    known = joints(store(spark, facts))
    names, told, left = sorted({p for _, p, _ in facts}), set(), 0
    for h, q, functional in product(names, names, (0, 2)):
        for new in (("?a", q, "?c"), ("?c", q, "?a"), ("?b", q, "?c"), ("?c", q, "?b")):
            rule = (("?a", h, "?b"), new)
            n = counted_single(known, rule, functional)
            assert n is None or n == len(held(facts, rule, rule[0][functional])), rule
            told.add(n is None)
    assert told == {True, False}
    ends = (("?a", "?c"), ("?c", "?a")), (("?c", "?b"), ("?b", "?c"))
    for h, p, q, functional, pca in product(names, names, names, (0, 2), (False, True)):
        for one, two in product(*ends):
            rule = (("?a", h, "?b"), (one[0], p, one[1]), (two[0], q, two[1]))
            n = counted_body(known, rule, functional, pca)
            want = held(facts, rule[1:], rule[0][functional])
            if pca:
                want &= {f[functional] for f in facts if f[1] == h}
            assert n is None or n == len(want), (rule, functional, pca)
            left += n is not None
        for body in (("?a", p, "?b"), ("?b", p, "?a")):
            n = counted_body(known, (("?a", h, "?b"), body), functional, pca)
            want = held(facts, [body], ("?a", "?b")[functional // 2]) & ({f[functional] for f in facts if f[1] == h} if pca else {x for f in facts for x in (f[0], f[2])})
            assert n == len(want), (h, body, functional, pca)
    assert left


def test_rules_of_the_same_atoms_are_joined_once(spark, monkeypatch):
    facts = facts_of(3)
    small = store(spark, facts)
    triangle = (("?a", "h", "?b"), ("?a", "p", "?c"), ("?c", "q", "?b"))
    turned = (("?x", "p", "?y"), ("?y", "q", "?z"), ("?x", "h", "?z"))
    last = (("?y", "q", "?z"), ("?x", "h", "?z"), ("?x", "p", "?y"))
    rules = [(0, triangle, "?a"), (1, turned, "?x"), (2, last, "?z"), (3, last, "?y"), (4, (("?a", "u", "?b"), ("?a", "p", "?c")), "?b")]
    joined, real = [], refine.bindings
    monkeypatch.setattr(refine, "bindings", lambda kb, shape, rows, *a, **k: joined.append(len(rows)) or real(kb, shape, rows, *a, **k))
    got = {r.rid: r.support for r in refine.single_counts(small, rules, joints(small)).collect()}
    assert got == {k: len(held(facts, rule, v)) for k, rule, v in rules} and len(set(got.values())) > 1
    assert sum(joined) == 2


def test_one_variable_counts_no_pairs(spark, monkeypatch):
    """Supports of the bias are never those of pairs, nor counted twice; each is that of brute force."""
    facts = facts_of(4)
    small, asked = store(spark, facts), []
    monkeypatch.setattr(refine, "support_counts", lambda *a, **k: pytest.fail("pairs were counted"))
    real = refine.single_counts
    monkeypatch.setattr(module, "single_counts", lambda kb, rules, known=None: asked.extend(module.Rule(r).key for _, r, _ in rules) or real(kb, rules, known))
    loose = dict(min_support=1, min_initial_support=1, min_head_coverage=0.0, pruning_metric="support", min_pca_confidence=0.0, min_std_confidence=0.0, skyline="off", perfect_rules=False)
    miner = Miner(small, MiningConfig(bias="one_variable", std=True, **loose))
    assert sum(len(g) for g in miner.generations()) > 10
    for r in miner.output:
        v = r.functional_variable
        assert v in variables(r.atoms[1:])
        assert (r.support, r.body_size) == (len(held(facts, r.atoms, v)), len(held(facts, r.atoms[1:], v))), r
        assert r.pca_body_size == len(held(facts, r.atoms[1:], v) & {f[r.functional] for f in facts if f[1] == r.atoms[0][1]}), r
    longer = [k for k in asked if len(k) == 3]
    assert longer and len(longer) == len(set(longer))


def test_a_rule_alone_binds_as_among_others(spark):
    """One rule's plan has no table of names, and finds what it finds next to a rule of the same shape."""
    from hornspark.functions.terms import DIFFERENT
    from hornspark.plans.batch import bindings, by_shape

    facts = facts_of(5)
    small = store(spark, facts)
    constant = min(o for _, p, o in facts if p == "h")
    rules = [
        ((("?a", "h", "?b"), ("?a", "p", "?c"), ("?c", "q", "?b")), (("?a", "h", "?b"), ("?a", "u", "?c"), ("?c", "w", "?b")), ["?a", "?b"]),
        ((("?a", "h", constant), ("?a", "p", "?b")), (("?a", "h", "b0"), ("?a", "u", "?b")), ["?a"]),
        ((("?a", "h", "?b"), ("?c", "h", "?b"), ("?c", DIFFERENT, "a1")), (("?a", "h", "?b"), ("?c", "q", "?b"), ("?c", DIFFERENT, "z1")), ["?c"]),
        ((("?a", "p", "?a"),), (("?a", "q", "?a"),), ["?a"]),
        ((("?a", "h", "?b"), ("?c", "q", "?d")), (("?a", "h", "?b"), ("?c", "w", "?d")), ["?a"]),
    ]
    for one, other, keep in rules:
        ((shape, rows),) = by_shape([(7, one), (8, other)]).items()
        both = {tuple(r) for r in bindings(small, shape, rows, keep).collect()}
        alone = bindings(small, shape, rows[:1], keep)
        assert {tuple(r) for r in alone.collect()} == {r for r in both if r[0] == 7}
        assert alone.schema["rid"].dataType.simpleString() == "bigint"
    triangle, _, keep = rules[0]
    ((shape, rows),) = by_shape([(7, triangle)]).items()
    assert "@" not in bindings(small, shape, rows, keep)._jdf.queryExecution().optimizedPlan().toString()
