"""Lower bounds of body sizes, next to the pairs themselves."""

import math
import random

from hornspark.functions.rules import Rule
from hornspark.plans.mine import Miner, MiningConfig
from hornspark.plans.pairs import joints
from hornspark.plans.refine import least_bodies
from hornspark.sources.kb import KB


def test_bodies_of_many_meeting_values_are_bounded_by_shares(spark):
    rng = random.Random(7)
    p = {(f"o{k}", f"s{x}") for k in range(60) for x in rng.sample(range(10), 1 + k % 3)}
    q = {(f"c{k}", f"s{x}") for k in range(30) for x in rng.sample(range(10), 1 + k % 4)}
    h = {(f"o{k}", f"c{rng.randrange(30)}") for k in range(40)}
    facts = [(s, r, o) for r, pairs in (("p", p), ("q", q), ("h", h)) for s, o in pairs]
    small = KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))
    rules = [(0, (("?a", "h", "?b"), ("?a", "p", "?z"), ("?b", "q", "?z")), 0), (1, (("?a", "h", "?b"), ("?a", "p", "?z"), ("?b", "q", "?z")), 2)]
    body = {(o, c) for o, s in p for c, t in q if s == t}
    has = {0: {o for o, _ in h}, 2: {c for _, c in h}}
    widest = max(sum(s == z for _, s in p) * sum(s == z for _, s in q) for z in {s for _, s in p})
    for pca in (False, True):
        low = {r.rid: r.n for r in least_bodies(small, rules, pca).collect()}
        for rid, _, functional in rules:
            size = len([x for x in body if not pca or x[functional // 2] in has[functional]])
            assert widest < low[rid] <= size
    miner = Miner(small, MiningConfig(min_pca_confidence=0.5), known=joints(small))
    support = math.ceil(0.5 * widest)  # enough by the widest value alone
    rule = Rule(rules[0][1], support=support, head_size=len(h), functional=0, total=len(facts))
    assert miner.denominators([rule], True, 0.5) == {}
    assert miner.denominators([rule], True, 0.01) == {0: len([x for x in body if x[0] in has[0]])}
