"""The store, queries and mining on small knowledge bases, against brute force and known counts."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from hornspark.functions.rules import Rule, canonical, is_closed, subsumes
from hornspark.functions.terms import is_var, parse_rule, variables
from hornspark.operators import bounds, predict, prep, query, stats, taxonomy
from hornspark.plans import pairs, refine
from hornspark.plans.mine import MiningConfig, mine
from hornspark.plans.pairs import joints
from hornspark.sources import files
from hornspark.sources.kb import KB

FACTS = """otter dockedAt north
heron dockedAt north
swift dockedAt south
otter carries grain
heron carries salt
heron carries grain
crane carries salt
north suppliedWith grain
south suppliedWith salt
otter builtIn east
swift builtIn east
grebe builtIn west"""
TRIPLES = {tuple(x.split()) for x in FACTS.splitlines()}


def kb_of(spark, text):
    return KB(spark.createDataFrame([tuple(x.split()) for x in text.splitlines()], "s string, p string, o string"))


def subjects_of(p, facts=TRIPLES):
    return {s for s, q, _ in facts if q == p}


@pytest.fixture(scope="module")
def kb(spark):
    return kb_of(spark, FACTS + "\nheron carries salt").persist()


def values(df, column=None):
    return {r[0] if column is None else r[column] for r in df.collect()}


@pytest.mark.parametrize("relation", ["dockedAt", "carries", "suppliedWith", "builtIn"])
def test_negation(kb, relation):
    subjects, objects = {s for s, _, _ in TRIPLES}, {o for _, _, o in TRIPLES}
    assert values(query.select(kb, ["?x"], f"{relation} ~exists ?x")) == subjects - subjects_of(relation)
    assert values(query.select(kb, ["?x"], f"{relation} ~existsInv ?x")) == objects - {o for _, p, o in TRIPLES if p == relation}
    assert values(query.select(kb, ["?x"], f"{relation} exists ?x")) == subjects_of(relation)
    for e in ("otter", "crane", "north"):
        assert query.exists(kb, f"{relation} ~exists {e}") == (e not in subjects_of(relation))
    assert values(query.select(kb, ["?x"], "?x ~exists heron")) == {p for _, p, _ in TRIPLES} - {p for s, p, _ in TRIPLES if s == "heron"}
    assert query.count_atom(kb, "sails ~exists ?x").first().n == len(subjects)


def test_typed_queries(spark, kb):
    ships = sorted(subjects_of("carries") | subjects_of("dockedAt"))
    typed = kb.union(kb_of(spark, "\n".join(f"{x} rdf:type Ship" for x in ships)))
    assert values(query.select(typed, ["?x"], "dockedAt ~exists ?x  ?x rdf:type Ship")) == set(ships) - subjects_of("dockedAt")
    assert ("dockedAt", "crane") in {tuple(r) for r in query.select(typed, ["?x", "?y"], "?x ~exists ?y  ?y rdf:type Ship").collect()}
    more = TRIPLES | {("crane", "dockedAt", "south"), ("swift", "carries", "tar")}
    path = [("?x", "dockedAt", "?t"), ("?t", "suppliedWith", "?c"), ("?x", "carries", "?c")]
    extra = kb.union(kb_of(spark, "crane dockedAt south\nswift carries tar"))
    assert {tuple(r) for r in query.select(extra, ["?x"], path).collect()} == brute(more, path, ["?x"])


def test_set_semantics_and_cardinality(kb):
    carried = {s: len({o for t, p, o in TRIPLES if p == "carries" and t == s}) for s, _, _ in TRIPLES}
    assert kb.df.count() == len(TRIPLES) and kb.relation_sizes["carries"] == sum(carried.values())
    for n in (0, 1, 2):
        assert query.count(kb, ["?x"], f"?x hasNumberOfValuesEquals{n} carries").first().n == sum(k == n for k in carried.values())
        assert query.count(kb, ["?x"], f"?x hasNumberOfValuesGreaterThan{n} carries").first().n == sum(k > n for k in carried.values())
    assert query.count(kb, ["?x"], "?x hasNumberOfValuesGreaterThanInv1 dockedAt").first().n == 1
    with pytest.raises(ValueError):
        query.select(kb, ["?x"], "?x hasNumberOfValuesEquals1 ?r").collect()
    assert query.count_up_to(kb, 2, ["?x", "?y"], "?x carries ?y").first().n == 3
    subjects, objects = {s for s, _, _ in TRIPLES}, {o for _, _, o in TRIPLES}
    assert stats.sizes(kb).first().asDict() == {"facts": len(TRIPLES), "subjects": len(subjects), "relations": 4, "objects": len(objects), "entities": len(subjects | objects)}
    assert values(query.difference(kb, ["?x"], "?x dockedAt ?y", "?x carries ?z")) == subjects_of("dockedAt") - subjects_of("carries")
    assert query.select(kb, ["?x", "?y"], "?x equals ?y  ?x builtIn west").first().asDict() == {"x": "grebe", "y": "grebe"}


def brute(facts, atoms, out):
    found = [{}]
    for atom in atoms:
        found = [{**b, **{t: v for t, v in zip(atom, f, strict=True) if is_var(t)}} for b in found for f in facts if all(b.get(t, v if is_var(t) else t) == v for t, v in zip(atom, f, strict=True)) and len({(t, v) for t, v in zip(atom, f, strict=True) if is_var(t)}) == len({t for t in atom if is_var(t)})]
    return {tuple(b[v] for v in out) for b in found}


@pytest.mark.parametrize("seed", range(6))
def test_random_queries(spark, seed):
    rng = random.Random(seed)
    facts = {(f"e{rng.randrange(6)}", f"r{rng.randrange(3)}", f"e{rng.randrange(6)}") for _ in range(30)}
    small = KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))
    for _ in range(4):
        names = ["?x", "?y", "?z", "?w"]
        atoms = [(rng.choice(names + ["e1"]), rng.choice(["r0", "r1", "r2", "?p"]), rng.choice(names + ["e2"])) for _ in range(rng.randint(1, 3))]
        out = [v for v in variables(atoms) if rng.random() < 0.7] or variables(atoms)[:1]
        if out:
            assert {tuple(r) for r in query.select(small, out, atoms).collect()} == brute(facts, atoms, out), atoms


def brute_rules(facts, depth, least):
    """Closed rules up to ``depth`` atoms whose every prefix of some order stays over ``least`` head facts, with (support, body, PCA body)."""
    relations = sorted({p for _, p, _ in facts})
    out = {}
    for h in relations:
        pairs = {(s, o) for s, p, o in facts if p == h}
        if len(pairs) < least:
            continue
        on_subject = len({s for s, _ in pairs}) >= len({o for _, o in pairs})
        known = {x[0 if on_subject else 1] for x in pairs}
        names = ["?a", "?b", "?c"]
        bodies = [(u, p, v) for p in relations for u in names for v in names if u != v and (u, p, v) != ("?a", h, "?b")]
        for n in range(1, depth):
            for body in itertools.combinations(bodies, n):
                rule = (("?a", h, "?b"), *body)
                if not is_closed(rule):
                    continue
                found = brute(facts, body, ["?a", "?b"])
                support = len(found & pairs)
                if support >= least:
                    out[canonical(rule)] = (support, len(found), len([x for x in found if x[0 if on_subject else 1] in known]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mining_against_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    facts = {(f"e{rng.randrange(7)}", f"r{rng.randrange(3)}", f"e{rng.randrange(7)}") for _ in range(32)}
    facts = {f for f in facts if f[0] != f[2]}
    small = KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))
    config = MiningConfig(min_support=2, min_initial_support=2, pruning_metric="support", min_pca_confidence=0.0, min_std_confidence=0.0, std=True, skyline="off", perfect_rules=False)
    got = {canonical(r.atoms): (r.support, r.body_size, r.pca_body_size) for r in mine(small, config)}
    assert got == brute_rules(facts, 3, 2)


LOOSE = dict(min_support=2, min_initial_support=2, pruning_metric="support", min_pca_confidence=0.0, min_std_confidence=0.0, skyline="off", perfect_rules=False)


def small_kb(spark, seed, entities=7, relations=3, n=32):
    rng = random.Random(seed)
    facts = {(f"e{rng.randrange(entities)}", f"r{rng.randrange(relations)}", f"e{rng.randrange(entities)}") for _ in range(n)}
    facts = {f for f in facts if f[0] != f[2]}
    return facts, KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))


def test_mining_options(spark, kb):
    base = dict(min_support=1, min_initial_support=1, pruning_metric="support", min_pca_confidence=0.0, skyline="off")
    rules = {canonical(r.atoms) for r in mine(kb, MiningConfig(**base))}
    path = canonical(parse_rule("?a dockedAt ?c  ?c suppliedWith ?b => ?a carries ?b"))
    assert path in rules
    assert all(r[0][1] == "carries" for r in (x.atoms for x in mine(kb, MiningConfig(**base, head_targets=("carries",)))))
    assert path not in {canonical(r.atoms) for r in mine(kb, MiningConfig(**base, body_excluded=("dockedAt",)))}
    assert path in {canonical(r.atoms) for r in mine(kb, MiningConfig(**base, bias="chain"))}
    for bad in (dict(head_targets=("a",), head_excluded=("b",)), dict(bias="lzay"), dict(max_depth=1)):
        with pytest.raises(ValueError):
            MiningConfig(**bad)


def test_constants_against_brute_force(spark):
    facts, small = small_kb(spark, 5, n=40)
    want = {}
    for h in sorted({p for _, p, _ in facts}):
        pairs = {(s, o) for s, p, o in facts if p == h}
        if len(pairs) < 2:
            continue
        place = 0 if len({s for s, _ in pairs}) >= len({o for _, o in pairs}) else 1
        for c in {x[1 - place] for x in pairs}:
            holds = {x[place] for x in pairs if x[1 - place] == c}
            if len(holds) < 2:
                continue
            head = ("?a", h, c) if place == 0 else (c, h, "?a")
            for p, side, k in {(p, i, (o, s)[i]) for s, p, o in facts for i in (0, 1)}:
                body = {(s, o)[side] for s, q, o in facts if q == p and (o, s)[side] == k}
                atom = ("?a", p, k) if side == 0 else (k, p, "?a")
                if atom != head and len(holds & body) >= 2:
                    want[canonical((head, atom))] = (len(holds & body), len(body), len(body & {x[place] for x in pairs}))
    got = {canonical(r.atoms): (r.support, r.body_size, r.pca_body_size) for r in mine(small, MiningConfig(**LOOSE, std=True, only_constants=True, max_depth=2))}
    assert want and got == want


def test_one_variable_and_seeds_against_brute_force(spark):
    facts, small = small_kb(spark, 8)
    seeds = {f"e{k}" for k in range(0, 7, 2)}
    table = spark.createDataFrame([(x,) for x in seeds], "entity string")
    for bias, more in (("one_variable", {}), ("seeds", {"seeds": table})):
        rules = mine(small, MiningConfig(**LOOSE, std=True, bias=bias, max_depth=3), **more)
        assert rules
        for r in rules:
            v = r.functional_variable
            counted = lambda atoms: {x for (x,) in brute(facts, atoms, [v]) if bias != "seeds" or x in seeds}  # noqa: E731, B023
            assert r.support == len(counted(r.atoms)) and r.body_size == len(counted(r.atoms[1:])), r
            place = 0 if r.functional == 0 else 2
            assert r.pca_body_size == len(counted(r.atoms[1:]) & {f[place] for f in facts if f[1] == r.atoms[0][1]}), r
    with pytest.raises(ValueError):
        mine(small, MiningConfig(bias="seeds"))


def test_bounds_skyline_and_perfect_rules(spark):
    facts, small = small_kb(spark, 11, relations=2, n=36)
    every = {canonical(r.atoms): r for r in mine(small, MiningConfig(**LOOSE, std=True))}
    cut = LOOSE | dict(min_pca_confidence=0.4)
    kept = {k for k, r in every.items() if r.pca_confidence >= 0.4}
    with_bounds = {canonical(r.atoms): r for r in mine(small, MiningConfig(**cut, bounds=True))}
    assert set(with_bounds) == kept and any(r.pca_upper_bound is not None for r in with_bounds.values())
    assert all(r.pca_upper_bound is None or r.pca_upper_bound >= r.pca_confidence for r in with_bounds.values())
    sky = {canonical(r.atoms) for r in mine(small, MiningConfig(**cut | dict(skyline="intended"), std=True))}
    assert sky < set(every)
    for k in kept - sky:  # dropped for a rule of fewer atoms that is as good
        assert any(subsumes(q, k) and len(q) < len(k) and every[q].pca_confidence >= every[k].pca_confidence for q in every)
    for k in sky:
        assert not any(len(q) < len(k) and every[q].pca_confidence >= max(0.4, every[k].pca_confidence) and subsumes(q, k) for q in sky)
    perfect = {canonical(r.atoms) for r in mine(small, MiningConfig(**LOOSE | dict(perfect_rules=True)))}
    assert perfect <= set(every)


def test_typed_and_existential_heads(spark):
    facts, small = small_kb(spark, 13)
    typed = small.union(kb_of(spark, "\n".join(f"e{k} rdf:type T{k % 2}" for k in range(7))))
    rules = [r for r in mine(typed, MiningConfig(**LOOSE, std=True, bias="typed", max_depth=2))]
    both = [r for r in rules if any(a[1] == "rdf:type" and a[2].startswith("T") for a in r.atoms[1:]) and len(r.atoms) == 3]
    all_ = facts | {(f"e{k}", "rdf:type", f"T{k % 2}") for k in range(7)}
    assert both
    for r in both:
        head = variables([r.atoms[0]])
        assert r.support == len(brute(all_, r.atoms, head)) and r.body_size == len(brute(all_, r.atoms[1:], [v for v in head if v in variables(r.atoms[1:])]))
    open_ = mine(small, MiningConfig(**LOOSE, bias="existential_head", max_depth=3))
    assert any(not is_closed(r.atoms) for r in open_)


def test_registered_bias_and_operator(spark):
    from hornspark.plans import mine as module

    facts, small = small_kb(spark, 17)
    module.register_bias("short", wants=lambda miner, r: [("closing", "?b", "?a")] if len(r.atoms) == 1 else [])
    try:
        rules = mine(small, MiningConfig(**LOOSE, bias="short"))
        assert rules and all(len(r.atoms) == 2 and (r.atoms[1][0], r.atoms[1][2]) == (r.atoms[0][2], r.atoms[0][0]) for r in rules)
        with pytest.raises(ValueError):
            module.register_bias("odd", counts=print)
        with pytest.raises(ValueError):
            module.register_operator("later", lambda miner, r: [], depends_on="earlier")
    finally:
        del module._BIASES["short"]


def test_estimate_of_long_paths(spark):
    """Where each value leads on to one, the estimate is the PCA confidence, at any length of the path."""
    facts = [(f"a{k}", "h", f"d{k % 4}") for k in range(12)] + [(f"a{k}", "p", f"b{k}") for k in range(12)] + [(f"b{k}", "q", f"c{k % 6}") for k in range(12)] + [(f"c{k}", "r", f"d{k % 3}") for k in range(6)]
    small = KB(spark.createDataFrame(facts, "s string, p string, o string"))
    known, table = joints(small), {r.p: r.asDict() for r in stats.profile(small).collect()}
    for text in ("?a p ?c  ?c q ?e  ?e r ?b => ?a h ?b",):
        rule = Rule(parse_rule(text), support=len(brute(set(facts), parse_rule(text), ["?a", "?b"])), head_size=12, functional=0)
        (r,) = bounds.pca_estimates([rule], table, known)
        size = 12 / 1 * (12 * (6 / 12) / (12 * 1)) * (6 * (3 / 6) / (6 * 1))
        assert r.pca_estimate == pytest.approx(rule.support / size)


def test_taxonomy(spark):
    kb = kb_of(spark, "A rdfs:subClassOf B\nB rdfs:subClassOf D\nA rdfs:subClassOf C\nC rdfs:subClassOf D\nX rdfs:subClassOf Y\nY rdfs:subClassOf X\ne rdf:type A\nf rdf:type D\ng rdf:type X\np rdfs:subPropertyOf q\nq rdfs:domain D")
    up = {tuple(r) for r in taxonomy.super_types(kb).collect()}
    assert up == {("A", "B"), ("A", "C"), ("A", "D"), ("B", "D"), ("C", "D"), ("X", "Y"), ("Y", "X"), ("X", "X"), ("Y", "Y")}
    assert {r.type for r in taxonomy.all_types(kb).filter("entity = 'e'").collect()} == {"A", "B", "C", "D"}
    assert values(query.select(kb, ["?x"], "?x transitiveType D")) == {"e", "f"}
    assert {tuple(r) for r in taxonomy.domains_ranges(kb).collect()} == {("q", "D", None), ("p", "D", None)}
    assert values(taxonomy.leaf_types(kb), "entity") == {"e"}


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\tr\ty .\nf1\tx\tr\tz\nbad\tline\n q \t r \t w. \n")
    kb = files.read_facts(spark, str(tmp_path / "a.tsv"))
    assert {tuple(r) for r in kb.df.collect()} == {("x", "r", "y"), ("x", "r", "z"), ("q", "r", "w.")}
    (tmp_path / "b.ttl").write_text('@prefix e: <http://e/x#> .\n# note\ne:a a e:T ; e:p "l; it."@en , <http://e/y/b> .\n')
    rdf, prefixes = files.read_rdf(spark, str(tmp_path / "b.ttl"))
    short = {r.iri: r.prefix for r in prefixes.collect()}
    e = short["http://e/x#"]
    assert (f"{e}:a", f"{e}:p", '"l; it."@en') in {tuple(r) for r in rdf.df.collect()} and rdf.df.count() == 3
    files.save(kb, str(tmp_path / "kb"))
    assert files.load(spark, str(tmp_path / "kb")).df.count() == 3
    (tmp_path / "rules.tsv").write_text("Rule\tx\n?a p ?b => ?a q ?b\t1\n")
    assert files.read_rules(spark, str(tmp_path / "rules.tsv")) == [(("?a", "q", "?b"), ("?a", "p", "?b"))]


def test_prep(spark, kb):
    hops = {r.entity: r.hop for r in prep.neighbourhood(kb, spark.createDataFrame([("otter",)], "entity string"), 2).collect()}
    assert hops == {"otter": 0, "north": 1, "grain": 1, "east": 1}
    dates = spark.createDataFrame([("3 May 1999",), ("1999",), ("soon",)], "d string").select(prep.date_literal(F.col("d")))
    assert [r[0] for r in dates.collect()] == ['"1999-05-03"^^xsd:date', '"1999-##-##"^^xsd:date', '"soon"']


def test_predictions(spark, kb):
    rules = [(parse_rule("?a dockedAt ?c  ?c suppliedWith ?b => ?a carries ?b"), 0.8), (parse_rule("?a builtIn ?b => ?a carries ?b"), 0.5)]
    mine_ = "s = 'otter' and p = 'carries'"
    train, test = kb.delete(kb.df.filter(mine_)), kb.df.filter(mine_)
    found = predict.predictions(train, rules)
    assert {(r.s, r.o): r.confidences for r in found.collect()}[("otter", "grain")] == [0.8]
    whole = [r for r in predict.rank_metrics(found, test, train.df).collect() if r.p is None and r.side is None][0]
    assert whole.n == 2 and whole.mrr == 1.0 and whole.hits1 == 1.0


def test_streaming(spark, tmp_path):
    from hornspark.streaming import live

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("a", "q", None)], "s string, p string, o string").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("s string, p string, o string").parquet(f"{tmp_path}/in")
    changed = []
    run = live.distinct_facts(stream).writeStream.foreachBatch(live.append_new_facts(f"{tmp_path}/kb", changed.append)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert changed == [["r"]] and spark.read.parquet(f"{tmp_path}/kb").count() == 1


def test_command_line(spark, tmp_path, capsys):
    from hornspark import cli

    (tmp_path / "a.nt").write_text("".join(f"<http://h/x#{s}> <http://h/r#{p}> <http://h/x#{o}> .\n" for s, p, o in sorted(TRIPLES)))
    assert cli.main([str(tmp_path / "a.nt"), "-mins", "2", "-pm", "support", "-minpca", "0.1"]) == 0
    out = capsys.readouterr().out
    assert "=> ?a" in out and "http://h/r#" in out.splitlines()[-2] + out.splitlines()[-1]
    o = cli.parser().parse_args(["f", "-minis", "5", "-bias", "OneVar", "-const", "-itr", "a,b", "-noSkyline", "-maxad", "2", "-d", ";", "-enstd"])
    config = cli.config_of(o)
    assert (config.min_initial_support, config.bias, config.constants, config.instantiation_targets, config.skyline, config.max_depth, config.std) == (5, "one_variable", True, ("a", "b"), "off", 2, True)


def test_instantiated_generation_has_all_heads(spark):
    from hornspark.operators.catalogue import _generation_2

    rng = random.Random(23)
    facts = {(f"x{rng.randrange(40)}", p, f"y{rng.randrange(5)}") for p in ("likes", "owns", "didEvent") for _ in range(400)}
    want = {}
    for head in ("likes", "owns", "didEvent"):
        pairs = {(s, o) for s, p, o in facts if p == head}
        if len(pairs) < 100:
            continue
        for u, own in (("a", 0), ("b", 1)):
            for side in (0, 2):
                found = {}
                for s, p, o in facts:
                    value, constant = (s, o) if side == 0 else (o, s)
                    found.setdefault((p, constant), set()).update(x for x in pairs if x[own] == value)
                for (p, constant), rows in found.items():
                    if len({x[own] for x in rows}) >= 2 and len(rows) >= max(1, -(-len(pairs) // 100)):
                        want[head, f"{u} {'s' if side == 0 else 'o'}", p, constant] = len(rows)
    kb = KB(spark.createDataFrame(sorted(facts), "s string, p string, o string"))
    assert {k[0] for k in want} == {"likes", "owns", "didEvent"}
    assert {(r["head"], r.place, r.p, r.c): r.support for r in _generation_2(kb, "instantiated").collect()} == want


def hub(spark):
    """40 x's and 30 y's that all meet in one value, and a relation with few of the pairs."""
    facts = [(f"x{i}", "p", "h") for i in range(40)] + [(f"y{i}", "q", "h") for i in range(30)] + [(f"x{i}", "r", f"y{i}") for i in range(5)] + [("x0", "t", "h"), ("x0", "t", "g"), ("y0", "u", "h"), ("y0", "u", "g")]
    return KB(spark.createDataFrame(facts, "s string, p string, o string"))


def test_bodies_are_counted_by_degrees(spark):
    kb = hub(spark)
    rules = [(k, parse_rule(t), 0) for k, t in enumerate(("?a p ?z  ?b q ?z => ?a r ?b", "?a t ?z  ?b u ?z => ?a r ?b", "?a p ?z  ?b u ?z => ?a r ?b"))]
    assert refine.products(kb, [r[:2] for r in rules]) == refine.products(kb, [r[:2] for r in rules], joints(kb)) == {0, 2}
    for pca, want in ((False, {0: 1200, 1: 1, 2: 40}), (True, {0: 150, 1: 1, 2: 5})):
        for known in (None, joints(kb)):
            assert {r.rid: r.n for r in refine.body_sizes(kb, rules, pca, known=known).collect()} == want
    plan = refine.body_sizes(kb, rules[:1], False)._jdf.queryExecution().optimizedPlan().toString()
    assert "d0" in plan and "?a" not in plan  # no pair is made


def test_rule_metrics_by_degrees(spark):
    row = bounds.rule_metrics(hub(spark), parse_rule("?a p ?z  ?b q ?z => ?a r ?b"), 0).first()
    assert (row.head_size, row.support, row.body_size, row.pca_body_size) == (5, 5, 1200, 150)


def test_cycles_start_with_the_fewest_rows(spark):
    found = query.select(hub(spark), ["?a", "?b"], "?a p ?n  ?b q ?n  ?a r ?b")
    assert {tuple(r) for r in found.collect()} == {(f"x{i}", f"y{i}") for i in range(5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join \w+, \(\?n#\d+ = \?n#\d+\)", plan)  # p and q alone make all pairs


def test_stores_are_read_again_and_shuffled_once(spark, tmp_path):
    kb = hub(spark)
    files.save(kb, str(tmp_path / "kb"), rebalance=False)
    stored = files.load(spark, str(tmp_path / "kb"))
    assert {tuple(r) for r in stored.df.collect()} == {tuple(r) for r in kb.df.collect()}
    stored.persist()
    assert not stored.df.is_cached


def test_profiles_and_refinements_of_heads_from_shared_counts(spark):
    kb = kb_of(spark, FACTS + "\neast builtIn east\neast ownedBy otter\nnorth dockedAt otter")
    known = joints(kb)
    want = {r.p: {k: r[k] for k in ("p", "n", "ns", "no", "fun", "ifun", "functional_pos")} for r in stats.profile(kb).collect()}
    assert pairs.profiles(known) == want
    found = {(r.p1, r.p2, r.inverse) for r in pairs.fact_pairs(kb).collect()}
    assert {x for x in found if x[0] != x[1] or x[2]} <= set(pairs.meetable(known))
