"""Candidates that several parents lead to."""

from itertools import product

from hornspark.functions.rules import canonical
from hornspark.plans import refine
from hornspark.sources.kb import KB


def test_a_closed_rule_of_two_parents_is_counted_once(spark, monkeypatch):
    facts = [(f"a{k}", "h", f"b{k % 3}") for k in range(6)] + [(f"a{k}", "p", f"z{k % 2}") for k in range(6)] + [(f"z{k}", "q", f"b{m}") for k, m in product(range(2), range(2))]
    small = KB(spark.createDataFrame(facts, "s string, p string, o string"))
    counted, real = [], refine.support_counts
    monkeypatch.setattr(refine, "support_counts", lambda kb, rules, *more: counted.extend(canonical(r) for _, r in rules) or real(kb, rules, *more))
    parents = [(0, (("?a", "h", "?b"), ("?a", "p", "?c")), 1), (1, (("?a", "h", "?b"), ("?c", "q", "?b")), 1)]
    wants = {parents[0][1]: [("closing", "?c", "?b")], parents[1][1]: [("closing", "?a", "?c")]}
    found = refine.refinements(small, parents, lambda atoms: wants[atoms]).collect()
    held = sum((f"z{k % 2}", "q", f"b{k % 3}") in facts for k in range(6))
    assert {(r.rid, r.p, r.support) for r in found} == {(0, "q", held), (1, "p", held)} and len(found) == 2
    assert len(counted) == len(set(counted))
