"""Pairs of ends that meet in variables of few values."""

import random

import pytest

from hornspark.operators import query
from hornspark.plans import compile as plans
from hornspark.sources.kb import KB
from tests.test_kb import brute


@pytest.mark.parametrize("tasks", [1, 7])
def test_pairs_are_made_once_and_not_shuffled(spark, monkeypatch, tasks):
    rng = random.Random(tasks)
    facts = {(f"c{k}", "lives", f"n{rng.randrange(4)}") for k in range(40)} | {(f"c{rng.randrange(40)}", "did", f"e{rng.randrange(5)}") for _ in range(60)} | {(f"c{rng.randrange(40)}", "likes", f"e{rng.randrange(5)}") for _ in range(60)}
    small = KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))
    monkeypatch.setattr(plans, "PAIRS_A_TASK", 400 // tasks)
    monkeypatch.setattr(plans, "_greedy", lambda *a: pytest.fail("made by joins of facts"))
    for text in (
        "?a lives ?n  ?b lives ?n  ?a did ?e  ?b did ?e",
        "?b did ?e  ?a lives ?n  ?b lives ?n  ?a did ?e  ?b likes ?e",
        "?a did ?e  ?b likes ?e  ?a likes ?f  ?b did ?f",
    ):
        atoms = tuple(zip(*[iter(text.split())] * 3))
        for out in (["?a", "?b"], ["?b", "?a"]):
            rows = [tuple(r) for r in query.select(small, out, text).collect()]
            assert len(rows) == len(set(rows)) and set(rows) == brute(facts, atoms, out), text


def test_select_cycle_stores_its_relations_alone(spark, monkeypatch):
    from hornspark.operators import catalogue
    from hornspark.sources import star
    from tests.oracle import DATA, same_rows

    monkeypatch.setattr(star, "_STORED", {})
    same_rows(spark, catalogue.QUERIES["select_cycle"], catalogue.SQL["select_cycle"])
    assert [name for _, _, name in star._STORED] == ["star-customerNation-didEvent"]
    catalogue.QUERIES["kb_sizes"](spark, str(DATA))
    catalogue.QUERIES["select_cycle"](spark, str(DATA))
    assert {name for _, _, name in star._STORED} == {"star-customerNation-didEvent", "star"}
