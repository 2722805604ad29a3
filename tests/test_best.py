"""Predictions and differences over all pairs of two atoms, without a shuffle of these."""

import random

from hornspark.functions.terms import parse_rule
from hornspark.operators import predict, query
from hornspark.sources.kb import KB


def test_best_predictions_make_few_pairs_of_the_widest_rule(spark, monkeypatch):
    rng, facts = random.Random(2), set()
    for a in range(120):
        facts |= {(f"a{a}", "livesIn", f"z{rng.randrange(4)}") for _ in range(rng.choice([0, 1, 1, 2]))}
        facts |= {(f"a{a}", "buys", f"b{rng.randrange(60)}") for _ in range(rng.choice([0, 3, 25]))}
        facts |= {(f"a{a}", "sees", f"b{rng.randrange(60)}") for _ in range(rng.randrange(4))}
    for b in range(60):
        facts |= {(f"b{b}", "sitsIn", f"z{rng.randrange(4)}") for _ in range(rng.choice([1, 1, 2]))}
    kb = KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))
    rules = [(parse_rule(t), c) for t, c in (("?a livesIn ?z  ?b sitsIn ?z => ?a buys ?b", 0.5), ("?a sees ?b => ?a buys ?b", 0.4), ("?b sitsIn ?z  ?a livesIn ?z => ?a meets ?b", 0.3))]
    order = predict.ranked
    for chosen in (rules[:1], rules[:2], rules, rules[1:]):
        want = {tuple(r) for r in order(predict.predictions(kb, chosen), "o", 4).select("s", "p", "o", "rank", "confidences").rdd.map(lambda r: (*r[:4], tuple(r[4]))).collect()}
        made = []
        monkeypatch.setattr(predict, "ranked", lambda found, *more: (made.append(found.count()), order(found, *more))[1])
        got = {(*r[:4], tuple(r[4])) for r in predict.best(kb, chosen, 4).select("s", "p", "o", "rank", "confidences").collect()}
        monkeypatch.setattr(predict, "ranked", order)
        assert got == want and want
        if len(chosen) == 1:
            assert made[0] < predict.predictions(kb, chosen).count() / 2


def test_difference_makes_pairs_last(spark):
    rng = random.Random(4)
    for most in (1, 2):  # one home each, and several: pairs may come twice then
        facts = {(f"a{a}", "livesIn", f"z{rng.randrange(3)}") for a in range(50) for _ in range(most)}
        facts |= {(f"b{b}", "sitsIn", f"z{rng.randrange(4)}") for b in range(40) for _ in range(2)}
        facts |= {(f"a{rng.randrange(50)}", "buys", f"b{rng.randrange(40)}") for _ in range(400)}
        of = lambda p: [(s, o) for s, q, o in facts if q == p]
        want = {(b, a) for a, z in of("livesIn") for b, y in of("sitsIn") if z == y} - {(b, a) for a, b in of("buys")}
        kb = KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))
        left = query.difference(kb, ["?b", "?a"], "?a livesIn ?z  ?b sitsIn ?z", "?a buys ?b")
        rows = [tuple(r) for r in left.collect()]
        assert left.columns == ["b", "a"] and set(rows) == want and len(rows) == len(want)
        assert ("LeftAnti" in left._jdf.queryExecution().optimizedPlan().toString()) == (most == 2)
