"""Rules with ``exists`` atoms, next to brute force."""

import random

import pytest

from hornspark.functions.rules import without_implied
from hornspark.functions.terms import OWN, asked_variables, parse_rule, unfolded, variables
from hornspark.plans.mine import MiningConfig, mine
from hornspark.plans.pairs import joints
from hornspark.plans.refine import body_sizes, least_bodies, refinements, support_counts
from hornspark.sources.kb import KB
from tests.test_kb import brute

LOOSE = dict(min_support=1, min_initial_support=1, pruning_metric="support", min_head_coverage=0.0, min_pca_confidence=0.0, min_std_confidence=0.0, skyline="off", perfect_rules=False)
HEADS = ("exists", "existsInv")


def facts_of(seed: int) -> set[tuple[str, str, str]]:
    rng = random.Random(seed)
    return {(f"{s}{rng.randrange(5)}", r, f"{o}{rng.randrange(4)}") for r, s, o, n in (("h", "a", "b", 9), ("p", "a", "z", 6), ("q", "z", "b", 5), ("r", "b", "y", 3)) for _ in range(n)}


def store(spark, facts) -> KB:
    return KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))


def wanted(facts, rule, functional):
    """(support, body, PCA body) by brute force."""
    atoms = unfolded(rule)
    head = asked_variables(atoms[0])
    body = brute(facts, atoms[1:], [v for v in head if v in variables(atoms[1:])])
    if rule[0][1] in HEADS:
        there = {f[0 if rule[0][1] == "exists" else 2] for f in facts}
        return len(brute(facts, atoms, head)), len(body), len({x for x in body if x[0] in there})
    known = {f[functional] for f in facts if f[1] == rule[0][1]}
    return len(brute(facts, atoms, head)), len(body), len({x for x in body if x[head.index(rule[0][functional])] in known})


@pytest.mark.parametrize("depth", [3, 4])
def test_exists_atoms_are_counted_and_refined(spark, depth):
    facts = facts_of(depth)
    rules = mine(store(spark, facts), MiningConfig(**LOOSE, bias="existential", std=True, max_depth=depth, head_targets=("h",)))
    special = [r for r in rules if any(a[1] in HEADS for a in r.atoms)]
    assert special and all(any(a[1] in HEADS for a in r.atoms[:1]) or depth > 3 for r in special)
    if depth > 3:  # and lead on to longer ones
        assert {len(r.atoms) for r in special} >= {2, 3, 4} and any(not set(HEADS) & {a[1] for a in r.atoms[:1]} for r in special)
    for r in rules if len(rules) <= 60 else special[:: max(1, len(special) // 60)]:
        assert (r.support, r.body_size, r.pca_body_size) == wanted(facts, r.atoms, r.functional), r
        assert without_implied(r.atoms) == r.atoms and OWN not in str(r.atoms)


def test_exists_atoms_beside_a_path(spark):
    facts = facts_of(7)
    small = store(spark, facts)
    path = "?a p ?z  ?z q ?b"
    rules = [parse_rule(f"{path}  {more} => ?a h ?b") for more in ("p exists ?a", "h exists ?a  r exists ?b", "q existsInv ?b", "p existsInv ?z", "h exists ?a  q exists ?z")]
    want = [wanted(facts, r, 0) for r in rules]
    known = joints(small)
    assert {r.rid: r.support for r in support_counts(small, list(enumerate(rules)), known).collect()} == {k: w[0] for k, w in enumerate(want) if w[0]}
    for pca in (False, True):
        asked = [(k, r, 0) for k, r in enumerate(rules)]
        sizes = {r.rid: r.n for r in body_sizes(small, asked, pca, known=known).collect()}
        assert sizes == {k: w[1 + pca] for k, w in enumerate(want) if w[1 + pca]}
        low = {r.rid: r.n for r in least_bodies(small, asked, pca).collect()}
        assert len(low) == len(sizes) and all(0 < n <= sizes[k] for k, n in low.items())


def test_a_parent_with_exists_atoms_has_candidates(spark):
    facts = facts_of(5)
    small = store(spark, facts)
    parent = parse_rule("p exists ?a => ?a h ?b")
    found = refinements(small, [(0, parent, 1)], lambda _: [("dangling", "?b", "s"), ("dangling", "?a", "s")]).collect()
    assert found and all(r.support == len(brute(facts, (*unfolded(parent), (r.u, r.p, "?x")), ["?a", "?b"])) for r in found)
