"""Parsing, rule algebra and formats: no Spark."""

import itertools
import random

import pytest

from hornspark.functions.formats import chain_line, datalog, lines, reverse_datalog, rule_text
from hornspark.functions.rules import Rule, canonical, chain, embeds, equivalent, is_closed, join_positions, open_variables, redundant, subsumes, without_stale_inequalities
from hornspark.functions.terms import connected_component, hard_pair, is_openable, is_var, joined_pair, meeting_pair, normalized, parse_atom, parse_query, parse_rule, rename, variables

NAMES = ["plain", "under_score", "c3", "<angle>", "/a/path/of.parts/with.dots", "pre_/mixed/form", "12", "\u00fcml\u00e4ut"]


@pytest.mark.parametrize("seed", range(8))
def test_atoms(seed):
    rng = random.Random(seed)
    term = lambda: rng.choice(["?a", "?x7", "?_k", "?z12", *NAMES])
    text = f"{term()} {rng.choice(NAMES)} {term()}"
    assert " ".join(parse_atom(text)) == text
    s, r, o = parse_atom(text)
    assert parse_query(f"{text}   {text}") == ((s, r, o), (s, r, o))
    assert parse_rule(f"{text} => {text}") == ((s, r, o), (s, r, o)) == parse_rule(f"{text} :- {text}")


def test_other_text():
    assert parse_atom("r(x,?y)") == ("x", "r", "?y") and parse_atom("a b") is None and parse_rule("a b c") is None and parse_query("") == ()
    assert parse_query("r(?x,?y), s(?y,?z)") == (("?x", "r", "?y"), ("?y", "s", "?z"))
    with pytest.raises(ValueError):
        parse_query("a b c d")
    assert is_var("?a86") and is_openable("?a86") and is_var("?_x1") and not is_openable("?_x1") and not is_var("x")


def q(text):
    return parse_query(text)


def random_rule(rng):
    """A head and some atoms over few variables and constants; neighbours share variables."""
    names = [f"?{c}" for c in "abcdef"[: rng.randint(2, 5)]]
    term = lambda: rng.choice([*names, *names, "k1", "k2"])
    return tuple((term(), rng.choice(["p", "q", "r"]), term()) for _ in range(rng.randint(1, 5)))


def shuffled(rng, rule):
    """The rule with other names and its body in another order."""
    used = variables(rule)
    new = rng.sample([f"?{c}{d}" for c in "mnuvw" for d in range(3)], len(used))
    head, *body = rename(rule, dict(zip(used, new, strict=True)))
    rng.shuffle(body)
    return (head, *body)


def same_by_force(x, y):
    """Whether some bijection of variables makes the heads equal and the bodies the same bags of atoms."""
    left, right = variables(x), variables(y)
    if len(left) != len(right) or len(x) != len(y):
        return False
    for image in itertools.permutations(right):
        head, *body = rename(x, dict(zip(left, image, strict=True)))
        if head == y[0] and sorted(body) == sorted(y[1:]):
            return True
    return False


@pytest.mark.parametrize("seed", range(60))
def test_equivalence(seed):
    """Renamed and shuffled rules are equal; rules with a changed atom are so where brute force says it."""
    rng = random.Random(seed)
    for _ in range(5):
        x = random_rule(rng)
        y = shuffled(rng, x)
        assert equivalent(x, y) and equivalent(y, x) and canonical(x) == canonical(y)
        atoms = [list(a) for a in y]
        at, place = rng.randrange(len(atoms)), rng.randrange(3)
        atoms[at][place] = rng.choice(["p", "q", "r"]) if place == 1 else rng.choice([*variables(y), "k1", "k2"])
        z = tuple(map(tuple, atoms))
        same = same_by_force(x, z)
        assert equivalent(x, z) == equivalent(z, x) == (canonical(x) == canonical(z)) == same, (x, z)


def test_subsumption_and_shape():
    rule = parse_rule("?x livesIn ?y  ?x worksAt ?z  ?z isIn ?y => ?x bornIn ?y")
    assert subsumes(parse_rule("?a livesIn ?b => ?a bornIn ?b"), rule) and not subsumes(rule, parse_rule("?a livesIn ?b => ?a bornIn ?b"))
    assert embeds(rule[:2], rule) and not equivalent(rule[:2], rule)
    assert is_closed(rule) and open_variables(rule[:3]) == ["?z"] and not is_closed(rule[:1])
    path = parse_rule("?z isIn ?y  ?x worksAt ?z => ?x bornIn ?y")
    assert [a[1] for a in chain(path)] == ["worksAt", "isIn"] and join_positions(chain(path)) == [("o", "s")] and chain(parse_rule("?x p ?u => ?x q ?y")) is None
    assert redundant(q("?x p ?y"), ("?x", "p", "c")) and not redundant(q("?x p ?y ?y r ?z"), ("?x", "q", "c"))
    assert hard_pair(q("?x r ?z ?y r ?z")) == (0, 1) and hard_pair(q("?x r ?z ?y s ?z")) is None
    assert normalized(path) == (("?a", "bornIn", "?b"), ("?c", "isIn", "?b"), ("?a", "worksAt", "?c"))
    assert without_stale_inequalities((*path, ("?k", "differentFrom", "c"))) == path


def test_pairs_of_atoms():
    assert meeting_pair(q("?x r ?z ?y s ?z")) == (0, 1) and meeting_pair(q("?x r ?y ?x s ?y")) is None and meeting_pair(q("?x r ?y ?z s ?w ?z t ?v")) == (1, 2)
    assert joined_pair(q("?x r ?z ?z s ?y")) == (0, 1, 2, 0) and joined_pair(q("?x r c ?x s ?y")) is None and joined_pair(q("?x r ?y ?y s ?x")) is None


def test_connected_component():
    atoms = q("?x a ?y  ?x b ?z  ?y c E")
    assert [connected_component(atoms, s, r) for s, r in (("?y", "?x"), ("?y", "?z"), ("?x", "?y"), ("?z", "?x"), ("?w", "a"))] == [[atoms[2]], [atoms[0], atoms[2]], [atoms[1]], [], []]


def test_formats():
    r = Rule(parse_rule("?z isIn ?y  ?x worksAt ?z => ?x bornIn ?y"), support=3, head_size=6, pca_body_size=4)
    assert rule_text(r.atoms) == "?z isIn ?y  ?x worksAt ?z => ?x bornIn ?y"
    header, line = lines([r])
    assert header.split("\t")[0] == "Rule" and line.split("\t")[1:5] == ["0.500000000", "", "0.750000000", "3"] and line.endswith("?x")
    assert chain_line(r) == "4\t3\t0.75\tbornIn(X,Y) <= worksAt(X,A), isIn(A,Y)"
    assert datalog(r.atoms).startswith("bornIn(x,y) <= ") and reverse_datalog(r.atoms).endswith(" => bornIn(x,y)")
