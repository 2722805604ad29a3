"""The registered queries over the star-schema knowledge base, each with the SQL that other engines run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.functions.formats import rules_frame
from hornspark.functions.terms import parse_query, parse_rule
from hornspark.operators import bounds, predict, prep, query, special, stats, taxonomy
from hornspark.plans.mine import MiningConfig, Miner, mine
from hornspark.plans.pairs import joints
from hornspark.plans.refine import body_sizes, refinements
from hornspark.sources.kb import KB
from hornspark.sources.star import KB_SQL, TAXONOMY_SQL, star_kb, taxonomy_kb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[KB], DataFrame], sql: str | None, typed: bool = False, recursive: bool = False) -> None:
    kb = taxonomy_kb if typed else star_kb
    QUERIES[name] = lambda spark, sf_dir: run(kb(spark, sf_dir))
    if sql is not None:
        SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}kb AS ({TAXONOMY_SQL if typed else KB_SQL})" + (f",\n{sql[1:]}" if sql.startswith(",") else f"\n{sql}")


def _atom_sql(k: int, atom) -> tuple[str, list[tuple[str, str]], list[str]]:
    refs, conds = [], []
    for c, t in zip("spo", atom, strict=True):
        if t.startswith("?"):
            refs.append((t, f"t{k}.{c}"))
        else:
            conds.append(f"t{k}.{c} = '{t}'")
    return f"kb t{k}", refs, conds


def _bgp(text: str, out: list[str], more: list[str] | None = None) -> str:
    """A plain join query with DISTINCT for a list of stored atoms."""
    tables, conds, at = [], list(more or []), {}
    for k, atom in enumerate(parse_query(text)):
        table, refs, own = _atom_sql(k, atom)
        tables.append(table)
        conds += own
        for v, ref in refs:
            if v in at:
                conds.append(f"{at[v]} = {ref}")
            else:
                at[v] = ref
    columns = ", ".join(f"{at['?' + v]} AS {v}" for v in out)
    return f"SELECT DISTINCT {columns} FROM {', '.join(tables)}" + (f" WHERE {' AND '.join(conds)}" if conds else "")


# statistics

_add(
    "kb_profile",
    lambda kb: stats.profile(kb).select("p", "n", "ns", "no", F.round("fun", 9).alias("fun"), F.round("ifun", 9).alias("ifun"), F.col("functional_pos").cast("int").alias("functional_pos")),
    """SELECT p, count(*) AS n, count(DISTINCT s) AS ns, count(DISTINCT o) AS no, round(count(DISTINCT s) / count(*), 9) AS fun,
    round(count(DISTINCT o) / count(*), 9) AS ifun, CASE WHEN count(DISTINCT s) >= count(DISTINCT o) THEN 0 ELSE 2 END AS functional_pos FROM kb GROUP BY p""",
)
_add("kb_sizes", stats.sizes, """SELECT (SELECT count(*) FROM kb) AS facts, (SELECT count(DISTINCT s) FROM kb) AS subjects, (SELECT count(DISTINCT p) FROM kb) AS relations,
    (SELECT count(DISTINCT o) FROM kb) AS objects, (SELECT count(*) FROM (SELECT s FROM kb UNION SELECT o FROM kb)) AS entities""")
_add(
    "kb_variance",
    lambda kb: stats.profile(kb).select("p", F.round("var", 6).alias("var"), F.round("ivar", 6).alias("ivar")),
    """, a AS (SELECT p, var_pop(c) AS var FROM (SELECT p, s, count(*) AS c FROM kb GROUP BY p, s) GROUP BY p),
    b AS (SELECT p, var_pop(c) AS ivar FROM (SELECT p, o, count(*) AS c FROM kb GROUP BY p, o) GROUP BY p)
    SELECT p, round(var, 6) AS var, round(ivar, 6) AS ivar FROM a JOIN b USING (p)""",
)
for _kind in ("ss", "so", "oo"):
    _add(
        f"kb_overlap_{_kind}",
        lambda kb, kind=_kind: stats.overlaps(kb, kind),
        f"""SELECT a.p AS r1, b.p AS r2, count(*) AS n FROM (SELECT DISTINCT p, {_kind[0]} AS e FROM kb) a JOIN (SELECT DISTINCT p, {_kind[1]} AS e FROM kb) b USING (e)
        {'WHERE a.p <> b.p' if _kind[0] == _kind[1] else ''} GROUP BY 1, 2""",
    )
_HIST = "h AS (SELECT p, k, count(*) AS n FROM (SELECT p, s, count(*) AS k FROM kb GROUP BY p, s) GROUP BY p, k)"
_IHIST = _HIST.replace("p, s", "p, o").replace("h AS", "ih AS")
_add("kb_histogram", stats.histogram, f", {_HIST} SELECT p, k, n FROM h")
_add("kb_histogram_inverse", lambda kb: stats.histogram(kb, True), f", {_IHIST} SELECT p, k, n FROM ih")
_add("kb_cumulative_histogram", stats.cumulative_histogram, f", {_HIST} SELECT p, k, CAST(coalesce((SELECT sum(n) FROM h x WHERE x.p = h.p AND x.k > h.k), 0) AS BIGINT) AS n FROM h")
_add("kb_max_cardinality", stats.max_cardinality, f", {_HIST}, {_IHIST} SELECT p, max(h.k) AS max_values, (SELECT max(k) FROM ih WHERE ih.p = h.p) AS max_inverse FROM h GROUP BY p")
_add("kb_max_cardinality_below", lambda kb: stats.max_cardinality(kb, 20), f""", {_HIST}, {_IHIST} SELECT p, coalesce(max(CASE WHEN h.k < 20 THEN h.k END), 20) AS max_values,
    (SELECT coalesce(max(CASE WHEN k < 20 THEN k END), 20) FROM ih WHERE ih.p = h.p) AS max_inverse FROM h GROUP BY p""")
_add(
    "kb_right_cumulative",
    lambda kb: stats.right_cumulative_cardinality(kb, 10, 3),
    f""", {_HIST}, c AS (SELECT p, k, coalesce((SELECT sum(n) FROM h x WHERE x.p = h.p AND x.k > h.k), 0) AS n FROM h),
    l AS (SELECT p, coalesce(sum(CASE WHEN k > 3 THEN n END), 0) AS m FROM h GROUP BY p)
    SELECT p, CAST(coalesce(min(CASE WHEN k > 3 AND n < m AND n >= 10 THEN k END), -1) AS BIGINT) AS k FROM c JOIN l USING (p) GROUP BY p""",
)
_add("kb_cardinality_distributions", stats.cardinality_distributions, f""", {_HIST}, {_IHIST},
    f AS (SELECT p, count(DISTINCT s) >= count(DISTINCT o) AS on_s FROM kb GROUP BY p), x AS (SELECT h.* FROM h JOIN f USING (p) WHERE on_s UNION ALL SELECT ih.* FROM ih JOIN f USING (p) WHERE NOT on_s)
    SELECT p, k, n, CAST(sum(n) OVER (PARTITION BY p ORDER BY k DESC) AS BIGINT) AS at_least FROM x""")
_add("kb_entity_occurrences", stats.entity_occurrences, "SELECT e AS entity, count(*) AS n FROM (SELECT s AS e FROM kb UNION ALL SELECT o FROM kb) GROUP BY e")
_add("kb_relations_at_least", lambda kb: stats.relation_counts(kb, 1000), "SELECT p, count(*) AS n FROM kb GROUP BY p HAVING count(*) >= 1000")
_add("kb_domain_histogram", stats.domain_histogram, """, d AS (SELECT s AS p, o AS t FROM kb WHERE p = 'rdfs:domain' UNION ALL
    SELECT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = 'rdfs:subPropertyOf' AND b.p = 'rdfs:domain' AND a.s NOT IN (SELECT s FROM kb WHERE p = 'rdfs:domain')),
    m AS (SELECT p, min(t) AS t FROM d GROUP BY p), c AS (SELECT f.p, f.s, count(*) AS k FROM kb f JOIN m ON f.p = m.p WHERE EXISTS (SELECT 1 FROM kb y WHERE y.p = 'rdf:type' AND y.s = f.s AND y.o = m.t) GROUP BY 1, 2)
    SELECT p, k, count(*) AS n FROM c GROUP BY p, k""", typed=True)

# atoms

_add("atom_one_var", lambda kb: query.matches(kb, "?x customerNation n3"), "SELECT s AS x FROM kb WHERE p = 'customerNation' AND o = 'n3'")
_add("atom_one_var_relation", lambda kb: query.matches(kb, "c5 ?r n3"), "SELECT p AS r FROM kb WHERE s = 'c5' AND o = 'n3'")
_add("atom_two_var", lambda kb: query.matches(kb, "?x inRegion ?y"), "SELECT s AS x, o AS y FROM kb WHERE p = 'inRegion'")
_add("atom_two_var_subject", lambda kb: query.matches(kb, "c7 ?r ?y"), "SELECT p AS r, o AS y FROM kb WHERE s = 'c7'")
_add("atom_three_var", lambda kb: query.matches(kb, "?x ?r ?y").groupBy("r").agg(F.count(F.lit(1)).alias("n")), "SELECT p AS r, count(*) AS n FROM kb GROUP BY p")
_add("atom_ground", lambda kb: query.count_atom(kb, "n1 inRegion r1"), "SELECT least(count(*), 1) AS n FROM kb WHERE s = 'n1' AND p = 'inRegion' AND o = 'r1'")
_add("atom_same_variable", lambda kb: query.count_atom(kb, "?x inRegion ?x"), "SELECT count(*) AS n FROM kb WHERE p = 'inRegion' AND s = o")
_add("atom_count", lambda kb: query.count_atom(kb, "?x buysFrom ?y"), "SELECT count(*) AS n FROM kb WHERE p = 'buysFrom'")
_add("value_counts", lambda kb: query.value_counts(kb, "?x supplierNation ?y", "?y"), "SELECT o AS y, count(*) AS n FROM kb WHERE p = 'supplierNation' GROUP BY o")

# conjunctive queries

for _name, _out, _text in (
    ("select_1var", ["c"], "?o placedBy ?c  ?o suppliedBy ?s  ?s supplierNation n2"),
    ("select_2var", ["c", "s"], "?c customerNation ?n  ?s supplierNation ?n  ?c buysFrom ?s"),
    ("select_3var", ["c", "n", "r"], "?c customerNation ?n  ?n inRegion ?r  ?c marketSegment seg_BUILDING"),
    ("select_4var", ["c", "n", "r", "g"], "?c customerNation ?n  ?n inRegion ?r  ?c marketSegment ?g"),
    ("select_5var", ["c", "n", "r", "g", "e"], "?c customerNation ?n  ?n inRegion ?r  ?c marketSegment ?g  ?c didEvent ?e"),
    ("select_relation_var", ["r", "y"], "?x customerNation n1  ?x ?r ?y"),
    ("select_cycle", ["a", "b"], "?a customerNation ?n  ?b customerNation ?n  ?a didEvent ?e  ?b didEvent ?e"),
):
    _add(_name, lambda kb, out=_out, text=_text: query.select(kb, [f"?{v}" for v in out], text), _bgp(_text, _out))
QUERIES["select_cycle"] = lambda spark, sf_dir: query.select(star_kb(spark, sf_dir, ("customerNation", "didEvent")), ["?a", "?b"], "?a customerNation ?n  ?b customerNation ?n  ?a didEvent ?e  ?b didEvent ?e")
_add("run_text", lambda kb: query.run_text(kb, "?c ?p | ?c didEvent ?e  ?o placedBy ?c  ?o orderPriority ?p"), _bgp("?c didEvent ?e  ?o placedBy ?c  ?o orderPriority ?p", ["c", "p"]))
_add("exists_query", lambda kb: query.satisfiable(kb, "?o placedBy ?c  ?o suppliedBy ?s  ?c customerNation n4"), f"SELECT count(*) > 0 AS found FROM ({_bgp('?o placedBy ?c  ?o suppliedBy ?s  ?c customerNation n4', ['o'])})")
_add("count_distinct", lambda kb: query.count(kb, ["?s"], "?c buysFrom ?s  ?c customerNation n1"), f"SELECT count(*) AS n FROM ({_bgp('?c buysFrom ?s  ?c customerNation n1', ['s'])})")
_add("count_distinct_pairs", lambda kb: query.count(kb, ["?n", "?s"], "?c buysFrom ?s  ?c customerNation ?n"), f"SELECT count(*) AS n FROM ({_bgp('?c buysFrom ?s  ?c customerNation ?n', ['n', 's'])})")
_add("count_pairs_upto", lambda kb: query.count_up_to(kb, 50, ["?n", "?s"], "?c buysFrom ?s  ?c customerNation ?n"), f"SELECT least(count(*), 51) AS n FROM ({_bgp('?c buysFrom ?s  ?c customerNation ?n', ['n', 's'])})")
_add("count_pairs_approximate", lambda kb: query.approximate_count(kb, ["?n", "?s"], "?c buysFrom ?s  ?c customerNation ?n"), None)
_add("count_projection", lambda kb: query.count_projection(kb, "?a buysFrom ?b", "?o placedBy ?a  ?o suppliedBy ?b"), f"SELECT count(*) AS n FROM ({_bgp('?a buysFrom ?b  ?o placedBy ?a  ?o suppliedBy ?b', ['a', 'b'])})")
_add("projection_bindings_relation", lambda kb: query.projection_bindings(kb, "?a customerNation ?b", "?a ?r ?z", "?r"), f"SELECT r, count(*) AS n FROM ({_bgp('?a customerNation ?b  ?a ?r ?z', ['r', 'a', 'b'])}) GROUP BY r")
_add("projection_bindings_constant", lambda kb: query.projection_bindings(kb, "?a customerNation ?b", "?a marketSegment ?c", "?c"), f"SELECT c, count(*) AS n FROM ({_bgp('?a customerNation ?b  ?a marketSegment ?c', ['c', 'a', 'b'])}) GROUP BY c")
_add("frequent_bindings", lambda kb: query.frequent_bindings(kb, "?n", "?s", "?c customerNation ?n  ?c buysFrom ?s"), f"SELECT n, count(*) AS k FROM ({_bgp('?c customerNation ?n  ?c buysFrom ?s', ['n', 's'])}) GROUP BY n")
QUERIES["frequent_bindings"] = lambda spark, sf_dir: query.frequent_bindings(star_kb(spark, sf_dir), "?n", "?s", "?c customerNation ?n  ?c buysFrom ?s").toDF("n", "k")

# virtual relations

_add("special_exists", lambda kb: query.select(kb, ["?x"], "didEvent exists ?x"), "SELECT DISTINCT s AS x FROM kb WHERE p = 'didEvent'")
_add("special_exists_relations", lambda kb: query.select(kb, ["?r"], "?r exists c3"), "SELECT DISTINCT p AS r FROM kb WHERE s = 'c3'")
_add("special_exists_inv", lambda kb: query.select(kb, ["?x"], "buysFrom existsInv ?x"), "SELECT DISTINCT o AS x FROM kb WHERE p = 'buysFrom'")
_add("special_not_exists", lambda kb: query.select(kb, ["?x"], "didEvent ~exists ?x  ?x customerNation n1"), "SELECT DISTINCT s AS x FROM kb WHERE p = 'customerNation' AND o = 'n1' AND s NOT IN (SELECT s FROM kb WHERE p = 'didEvent')")
_add("special_not_exists_relations", lambda kb: query.select(kb, ["?r"], "?r ~exists c3"), "SELECT DISTINCT p AS r FROM kb WHERE p NOT IN (SELECT p FROM kb WHERE s = 'c3')")
_add("special_not_exists_all", lambda kb: query.value_counts(kb, "?r ~exists ?x", "?r"), """, n AS (SELECT count(DISTINCT s) AS n FROM kb)
    SELECT p AS r, (SELECT n FROM n) - count(DISTINCT s) AS n FROM kb GROUP BY p HAVING count(DISTINCT s) < (SELECT n FROM n)""")
_add("special_not_exists_inv", lambda kb: query.select(kb, ["?x"], "customerNation ~existsInv ?x  ?x inRegion ?r"), "SELECT DISTINCT s AS x FROM kb WHERE p = 'inRegion' AND s IN (SELECT o FROM kb) AND s NOT IN (SELECT o FROM kb WHERE p = 'customerNation')")
_PER = "SELECT s AS x FROM kb WHERE p = 'buysFrom' GROUP BY s HAVING count(*)"
_add("special_card_eq", lambda kb: query.select(kb, ["?x"], "?x hasNumberOfValuesEquals5 didEvent"), "SELECT s AS x FROM kb WHERE p = 'didEvent' GROUP BY s HAVING count(*) = 5")
_add("special_card_eq_zero", lambda kb: query.count(kb, ["?x"], "?x hasNumberOfValuesEquals0 buysFrom"), "SELECT count(DISTINCT s) AS n FROM kb WHERE s NOT IN (SELECT s FROM kb WHERE p = 'buysFrom')")
_add("special_card_gt", lambda kb: query.select(kb, ["?x"], "?x hasNumberOfValuesGreaterThan8 buysFrom"), f"{_PER} > 8")
_add("special_card_gt_inv", lambda kb: query.select(kb, ["?x"], "?x hasNumberOfValuesGreaterThanInv20 customerNation"), "SELECT o AS x FROM kb WHERE p = 'customerNation' GROUP BY o HAVING count(*) > 20")
_add("special_card_lt", lambda kb: query.select(kb, ["?x"], "?x hasNumberOfValuesSmallerThan10 buysFrom  ?x customerNation ?n"), "SELECT DISTINCT s AS x FROM kb k WHERE p = 'customerNation' AND (SELECT count(*) FROM kb b WHERE b.p = 'buysFrom' AND b.s = k.s) < 10")
_add("special_different_from", lambda kb: query.select(kb, ["?a", "?b"], "?a supplierNation ?n  ?b supplierNation ?n  ?a differentFrom ?b"), _bgp("?a supplierNation ?n  ?b supplierNation ?n", ["a", "b"], ["t0.s <> t1.s"]))
_add("special_equals", lambda kb: query.select(kb, ["?a", "?b"], "?a customerNation n2  ?a equals ?b"), "SELECT DISTINCT s AS a, s AS b FROM kb WHERE p = 'customerNation' AND o = 'n2'")

# differences and whole stores

_add("difference_1", lambda kb: query.difference(kb, ["?x"], "?x customerNation ?n", "?x didEvent ?e"), "SELECT DISTINCT s AS x FROM kb WHERE p = 'customerNation' AND s NOT IN (SELECT s FROM kb WHERE p = 'didEvent')")
_add("difference_2", lambda kb: query.difference(kb, ["?a", "?b"], "?a customerNation ?n  ?b supplierNation ?n", "?a buysFrom ?b"), _bgp("?a customerNation ?n  ?b supplierNation ?n", ["a", "b"]) + " EXCEPT SELECT s, o FROM kb WHERE p = 'buysFrom'")
_add("difference_no_common", lambda kb: query.difference(kb, ["?x", "?n"], "?x supplierNation ?n", "?u inRegion r99"), "SELECT DISTINCT s AS x, o AS n FROM kb WHERE p = 'supplierNation' AND NOT EXISTS (SELECT 1 FROM kb WHERE p = 'inRegion' AND o = 'r99')")
_add("difference_3", lambda kb: query.difference(kb, ["?a", "?n", "?r"], "?a customerNation ?n  ?n inRegion ?r", "?s supplierNation ?n  ?a buysFrom ?s"), _bgp("?a customerNation ?n  ?n inRegion ?r", ["a", "n", "r"], ["(t0.s, t0.o) NOT IN (SELECT x.s, y.o FROM kb x JOIN kb y ON x.o = y.s WHERE x.p = 'buysFrom' AND y.p = 'supplierNation')"]))
_add("difference_4", lambda kb: query.difference(kb, ["?a", "?n", "?r", "?g"], "?a customerNation ?n  ?n inRegion ?r  ?a marketSegment ?g", "?a didEvent ev_click"), _bgp("?a customerNation ?n  ?n inRegion ?r  ?a marketSegment ?g", ["a", "n", "r", "g"], ["t0.s NOT IN (SELECT s FROM kb WHERE p = 'didEvent' AND o = 'ev_click')"]))


def _part(kb: KB, *relations: str) -> KB:
    return prep.keep_relations(kb, relations)


_COUNT = "SELECT p, count(*) AS n FROM ({}) GROUP BY p"
_per_relation = lambda kb: stats.relation_counts(kb)
_add("kb_union", lambda kb: _per_relation(_part(kb, "inRegion", "brand").union(_part(kb, "brand", "partType"))), _COUNT.format("SELECT * FROM kb WHERE p IN ('inRegion', 'brand', 'partType')"))
_add("kb_intersect", lambda kb: _per_relation(_part(kb, "inRegion", "brand").intersect(_part(kb, "brand", "partType"))), _COUNT.format("SELECT * FROM kb WHERE p = 'brand'"))
_add("kb_delete", lambda kb: _per_relation(kb.delete(kb.df.filter("o = 'n1'"))), _COUNT.format("SELECT * FROM kb WHERE o <> 'n1'"))
_add("kb_new_facts", lambda kb: _part(kb, "brand").new_facts(_part(kb, "brand", "inRegion")), "SELECT * FROM kb WHERE p = 'inRegion'")
_add("kb_new_entities", lambda kb: _per_relation(kb.with_new_entities(kb.facts("customerNation").select(F.col("s").alias("entity")))), """, e AS (SELECT DISTINCT s FROM kb WHERE p = 'rdf:type' AND s NOT IN (SELECT s FROM kb WHERE p = 'customerNation'))
    SELECT p, count(*) AS n FROM kb WHERE s IN (SELECT s FROM e) OR o IN (SELECT s FROM e) GROUP BY p""", typed=True)

# types

_CLOSURE = """, up AS (SELECT s AS sub, o AS super FROM kb WHERE p = 'rdfs:subClassOf' UNION SELECT up.sub, k.o FROM up JOIN kb k ON k.p = 'rdfs:subClassOf' AND k.s = up.super)"""
_add("types_count", taxonomy.type_counts, "SELECT o AS type, count(*) AS n FROM kb WHERE p = 'rdf:type' GROUP BY o", typed=True)
_add("types_intersection", taxonomy.type_intersections, "SELECT a.o AS t1, b.o AS t2, count(*) AS n FROM kb a JOIN kb b ON a.s = b.s WHERE a.p = 'rdf:type' AND b.p = 'rdf:type' GROUP BY 1, 2", typed=True)
_add("leaf_types", lambda kb: taxonomy.leaf_types(kb).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT o AS type, count(*) AS n FROM kb WHERE p = 'rdf:type' AND o NOT IN (SELECT o FROM kb WHERE p = 'rdfs:subClassOf') GROUP BY o", typed=True)
_add("all_super_types", taxonomy.super_types, f"{_CLOSURE} SELECT sub, super FROM up", typed=True, recursive=True)
_add("all_sub_types", lambda kb: taxonomy.super_types(kb).filter("super = 'Agent'").select("sub"), f"{_CLOSURE} SELECT sub FROM up WHERE super = 'Agent'", typed=True, recursive=True)
_add("all_types", lambda kb: taxonomy.all_types(kb).groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"""{_CLOSURE}, a AS (SELECT s, o FROM kb WHERE p = 'rdf:type' UNION SELECT k.s, up.super FROM kb k JOIN up ON k.o = up.sub WHERE k.p = 'rdf:type')
    SELECT o AS type, count(*) AS n FROM a GROUP BY o""", typed=True, recursive=True)
_add("special_transitive_type", lambda kb: query.count(kb, ["?x"], "?x transitiveType Agent"), f"{_CLOSURE} SELECT count(DISTINCT s) AS n FROM kb WHERE p = 'rdf:type' AND (o = 'Agent' OR o IN (SELECT sub FROM up WHERE super = 'Agent'))", typed=True, recursive=True)
_add("special_transitive_type_proper", lambda kb: taxonomy.transitive_types(kb, reflexive=False).filter("type = 'Agent'").agg(F.count(F.lit(1)).alias("n")), f"{_CLOSURE} SELECT count(DISTINCT s) AS n FROM kb WHERE p = 'rdf:type' AND o IN (SELECT sub FROM up WHERE super = 'Agent')", typed=True, recursive=True)
_add("domain_range", taxonomy.domains_ranges, """, pairs AS (SELECT s AS p, p AS k, o AS t, 0 AS far FROM kb WHERE p IN ('rdfs:domain', 'rdfs:range') UNION ALL
    SELECT a.s, b.p, b.o, 1 FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = 'rdfs:subPropertyOf' AND b.p IN ('rdfs:domain', 'rdfs:range')),
    best AS (SELECT p, k, arg_min(t, far || t) AS t FROM pairs GROUP BY p, k)
    SELECT p, max(CASE WHEN k = 'rdfs:domain' THEN t END) AS domain, max(CASE WHEN k = 'rdfs:range' THEN t END) AS range FROM best GROUP BY p""", typed=True)
_add("domain_instances", lambda kb: taxonomy.domain_instances(kb, "customerNation", "restrict").agg(F.count(F.lit(1)).alias("n")), "SELECT count(DISTINCT k.s) AS n FROM kb k JOIN kb t ON t.s = k.s AND t.p = 'rdf:type' AND t.o = 'Customer' WHERE k.p = 'customerNation'", typed=True)
_add("class_cooccurrence", lambda kb: prep.class_cooccurrence(kb, 5), "SELECT a.o AS t1, b.o AS t2, count(*) AS n FROM kb a JOIN kb b ON a.s = b.s WHERE a.p = 'rdf:type' AND b.p = 'rdf:type' AND a.o <> b.o GROUP BY 1, 2 HAVING count(*) >= 5", typed=True)
_add("seed_hops", lambda kb: prep.neighbourhood(kb, kb.facts("customerNation").filter("o = 'n1'").select(F.col("s").alias("entity")), 2).groupBy("hop").agg(F.count(F.lit(1)).alias("n")), """, z AS (SELECT s AS e FROM kb WHERE p = 'customerNation' AND o = 'n1'),
    a AS (SELECT DISTINCT o AS e FROM kb WHERE s IN (SELECT e FROM z) EXCEPT SELECT e FROM z), b AS (SELECT DISTINCT o AS e FROM kb WHERE s IN (SELECT e FROM a) EXCEPT (SELECT e FROM z UNION SELECT e FROM a))
    SELECT CAST(0 AS INTEGER) AS hop, count(*) AS n FROM z UNION ALL SELECT 1, count(*) FROM a HAVING count(*) > 0 UNION ALL SELECT 2, count(*) FROM b HAVING count(*) > 0""")
_add("sampled_graph", lambda kb: _per_relation(prep.sampled_graph(kb, kb.facts("customerNation").filter("o = 'n1'").select(F.col("s").alias("entity")), 1)), """, z AS (SELECT s AS e FROM kb WHERE p = 'customerNation' AND o = 'n1' UNION SELECT k.o FROM kb k JOIN kb c ON k.s = c.s WHERE c.p = 'customerNation' AND c.o = 'n1')
    SELECT p, count(*) AS n FROM kb WHERE s IN (SELECT e FROM z) GROUP BY p""")
_add("prep_url_decode", lambda kb: prep.url_decoded(KB(kb.df.select("s", "p", F.concat(F.col("o"), F.lit("%20x%2Fy")).alias("o")).filter("p = 'inRegion'"))).df, "SELECT s, p, o || ' x/y' AS o FROM kb WHERE p = 'inRegion'")
_add("prep_substitute", lambda kb: prep.substituted(kb.facts("supplierNation"), "o", kb.facts("inRegion").select(F.col("s").alias("old"), F.col("o").alias("new"))), "SELECT k.s, coalesce(r.o, '<' || k.o || '>') AS o FROM kb k LEFT JOIN kb r ON r.p = 'inRegion' AND r.s = k.o WHERE k.p = 'supplierNation'")
_add("prep_hash_join", lambda kb: prep.hash_join(kb.facts("customerNation"), kb.facts("inRegion").toDF("nation", "region"), ["o"], ["nation"]), "SELECT k.s, k.o, r.o AS region FROM kb k JOIN kb r ON r.p = 'inRegion' AND r.s = k.o WHERE k.p = 'customerNation'")
_add("label_expansion", lambda kb: KB(kb.facts("inRegion").select("s", F.lit("name").alias("p"), F.concat("o", F.lit("@en")).alias("o"))).expanded_labels().df, """, l AS (SELECT DISTINCT s, o FROM kb WHERE p = 'inRegion')
    SELECT s, 'name' AS p, o || '@en' AS o FROM l UNION SELECT o || '@en', '<label>', o FROM l UNION SELECT o || '@en', '<lang>', 'en' FROM l""")

# mining

_RULES = {
    "rule_metrics_path": ("?o placedBy ?a  ?o suppliedBy ?b => ?a buysFrom ?b", 0),
    "rule_metrics_nation": ("?a customerNation ?n  ?b supplierNation ?n => ?a buysFrom ?b", 0),
    "rule_metrics_chain": ("?a placedBy ?c  ?c buysFrom ?b => ?a suppliedBy ?b", 0),
    "rule_metrics_triangle": ("?a buysFrom ?s  ?s supplierNation ?b => ?a customerNation ?b", 0),
    "rule_metrics_const_body": ("?a marketSegment seg_BUILDING  ?a didEvent ev_click  ?a customerNation ?b => ?a customerNation ?b", 0),
}


def _rule_sql(text: str, functional: int) -> str:
    head, *body = parse_rule(text)
    both = "  ".join(" ".join(a) for a in body)
    f = "s" if functional == 0 else "o"
    return f""", b AS ({_bgp(both, ['a', 'b'])}), h AS (SELECT s AS a, o AS b FROM kb WHERE p = '{head[1]}'),
    c AS (SELECT (SELECT count(*) FROM h) AS head_size, (SELECT count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM h)) AS support, (SELECT count(*) FROM b) AS body_size,
      (SELECT count(*) FROM b WHERE {'a IN (SELECT a FROM h)' if f == 's' else 'b IN (SELECT b FROM h)'}) AS pca_body_size)
    SELECT *, round(support / head_size, 9) AS head_coverage, round(support / nullif(body_size, 0), 9) AS std_confidence, round(support / nullif(pca_body_size, 0), 9) AS pca_confidence FROM c"""


for _name, (_text, _f) in _RULES.items():
    _add(_name, lambda kb, text=_text: bounds.rule_metrics(kb, parse_rule(text)), _rule_sql(_text, _f))


def _heads(kb: KB, least: int) -> list[str]:
    return sorted(p for p, n in kb.relation_sizes.items() if n >= least)


_TARGETS = ("customerNation", "didEvent", "marketSegment", "supplierNation")


def _generation_2(kb: KB, kind: str, targets: tuple[str, ...] | None = None) -> DataFrame:
    """Supports of all atoms of one kind next to the heads of at least 100 facts (of ``targets``), at a head coverage of 0.01."""
    heads = [h for h in _heads(kb, 100) if targets is None or h in targets]
    parents = [(k, (("?a", p, "?b"),), max(1, -(-kb.relation_sizes[p] // 100))) for k, p in enumerate(heads)]
    asked = {"dangling": [("dangling", v, side) for v in ("?a", "?b") for side in "so"], "closing": [("closing", "?a", "?b"), ("closing", "?b", "?a")], "instantiated": [("instantiated", v, side) for v in ("?a", "?b") for side in "so"]}[kind]
    names = F.broadcast(kb.spark.createDataFrame(list(enumerate(heads)), "rid long, head string"))
    found = refinements(kb, parents, lambda _: asked).join(names, "rid")
    place = F.concat(F.substring("u", 2, 1), F.lit(" "), F.regexp_replace("v", r"\?", ""))
    columns = ["head", place.alias("place"), "p", *(["c"] if kind == "instantiated" else []), "support"]
    return found.select(*columns)


_H = "h AS (SELECT * FROM kb WHERE p IN (SELECT p FROM kb GROUP BY p HAVING count(*) >= 100)), t AS (SELECT p, greatest(1, ceil(count(*) / 100)) AS t FROM kb GROUP BY p)"


def _refine_sql(kind: str) -> str:
    parts = []
    for u, hc in (("a", "s"), ("b", "o")):
        if kind == "closing":
            other = "o" if hc == "s" else "s"
            parts.append(f"SELECT h.p AS head, '{u} {'b' if u == 'a' else 'a'}' AS place, k.p AS p, count(DISTINCT (h.s, h.o)) AS support FROM h JOIN kb k ON k.s = h.{hc} AND k.o = h.{other} GROUP BY 1, 2, 3")
        else:
            for side in "so":
                extra = f", k.{'o' if side == 's' else 's'} AS c" if kind == "instantiated" else ""
                group = "1, 2, 3, 4" if extra else "1, 2, 3"
                having = f" HAVING count(DISTINCT h.{hc}) >= 2" if extra else ""
                parts.append(f"SELECT h.p AS head, '{u} {side}' AS place, k.p AS p{extra}, count(DISTINCT (h.s, h.o)) AS support FROM h JOIN kb k ON k.{side} = h.{hc} GROUP BY {group}{having}")
    heads = _H.replace("WHERE p IN", f"WHERE p IN {_TARGETS} AND p IN", 1) if kind == "instantiated" else _H
    return f", {heads}, r AS ({' UNION ALL '.join(parts)}) SELECT r.* FROM r JOIN t ON t.p = r.head WHERE support >= t"


for _kind in ("dangling", "closing", "instantiated"):
    _add(f"refine_{_kind}_gen2", lambda kb, kind=_kind: _generation_2(kb, kind, _TARGETS if kind == "instantiated" else None), _refine_sql(_kind))
# its SQL keeps four heads; this one has all
_add("refine_instantiated_gen2_all", lambda kb: _generation_2(kb, "instantiated"), None)


def _pair_rules(kb: KB) -> DataFrame:
    """All rules of one body atom, mined, with their metrics."""
    return rules_frame(kb.spark, mine(kb, MiningConfig(max_depth=2, std=True, min_std_confidence=0.0, min_pca_confidence=0.01, skyline="off"))).select(
        "rule", "support", "body_size", "pca_body_size", F.round("head_coverage", 9).alias("head_coverage"), F.round("pca_confidence", 9).alias("pca_confidence")
    )


_COPIES = [("o", "sellsTo", "s", "p = 'buysFrom'"), ("s", "bigOrderFrom", "o", "p = 'buysFrom' AND o < 's5'"), ("o", "homeOf", "s", "p = 'customerNation' AND s < 'c6'")]


def _with_copies(kb: KB) -> KB:
    """The store with some relations that follow from others, inverted or in part."""
    out = kb
    for s, p, o, where in _COPIES:
        out = out.union(KB(kb.df.filter(where).select(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o")), distinct=False))
    return out


def _on_copies(sql: str) -> str:
    """SQL over ``kb`` that reads the store with its copies."""
    import re

    more = " UNION ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM kb WHERE {where}" for s, p, o, where in _COPIES)
    return f", k2 AS (SELECT s, p, o FROM kb UNION {more}), " + re.sub(r"\bkb\b", "k2", sql)[1:].lstrip()


_add(
    "mine_pairs",
    lambda kb: _pair_rules(_with_copies(kb)),
    _on_copies(f""", {_H}, f AS (SELECT p, count(*) AS n, count(DISTINCT s) >= count(DISTINCT o) AS on_s FROM kb GROUP BY p),
    c AS (SELECT h.p AS head, k.p AS body, 0 AS inv, count(*) AS support FROM h JOIN kb k ON k.s = h.s AND k.o = h.o AND k.p <> h.p GROUP BY 1, 2 UNION ALL
      SELECT h.p, k.p, 1, count(*) FROM h JOIN kb k ON k.s = h.o AND k.o = h.s GROUP BY 1, 2),
    m AS (SELECT c.*, f.n, (SELECT count(*) FROM kb b WHERE b.p = c.body) AS body_size,
      (SELECT count(*) FROM kb b WHERE b.p = c.body AND CASE WHEN f.on_s THEN (CASE WHEN inv = 0 THEN b.s ELSE b.o END) IN (SELECT s FROM kb q WHERE q.p = c.head) ELSE (CASE WHEN inv = 0 THEN b.o ELSE b.s END) IN (SELECT o FROM kb q WHERE q.p = c.head) END) AS pca_body_size
      FROM c JOIN f ON f.p = c.head JOIN t ON t.p = c.head WHERE support >= t)
    SELECT CASE WHEN inv = 0 THEN '?a ' || body || ' ?b' ELSE '?b ' || body || ' ?a' END || ' => ?a ' || head || ' ?b' AS rule, support, body_size, pca_body_size,
      round(support / n, 9) AS head_coverage, round(support / pca_body_size, 9) AS pca_confidence FROM m WHERE support >= 0.01 * pca_body_size"""),
)


def _mined(config: MiningConfig, typed: bool = False):
    make = taxonomy_kb if typed else star_kb
    return lambda spark, sf_dir: rules_frame(spark, mine(make(spark, sf_dir), config))


_PATHS = ("?a customerNation ?z  ?b supplierNation ?z", "?z placedBy ?a  ?z suppliedBy ?b")
#: Options and whether the store has types; all over the whole store.
MINED = {
    "mine_default": (MiningConfig(), False),
    "mine_std_skyline": (MiningConfig(min_initial_support=25, std=True, skyline="intended", bounds=True, heuristics=True), False),
    "mine_onevar": (MiningConfig(bias="one_variable"), False),
    "mine_const": (MiningConfig(only_constants=True, min_head_coverage=0.1), False),
    "mine_chain": (MiningConfig(bias="chain"), False),
    "mine_signatured": (MiningConfig(bias="signatured"), True),
    "mine_existential": (MiningConfig(bias="existential"), False),
}
for _name, (_config, _typed) in MINED.items():
    QUERIES[_name] = _mined(_config, _typed)


def _initial(kb: KB, **more) -> DataFrame:
    miner = Miner(kb, MiningConfig(**more))
    miner.stats = {r.p: r.asDict() for r in stats.profile(kb).collect()}
    miner.sizes = {p: r["n"] for p, r in miner.stats.items()}
    miner.functional = {p: r["functional_pos"] for p, r in miner.stats.items()}
    return kb.spark.createDataFrame([(r.atoms[0][1], r.support, r.functional) for r in miner.initial()], "p string, support long, functional int")


_add("initial_atoms", _initial, "SELECT p, count(*) AS support, CASE WHEN count(DISTINCT s) >= count(DISTINCT o) THEN 0 ELSE 2 END AS functional FROM kb GROUP BY p HAVING count(*) >= 100")
_add("initial_atoms_onevar", lambda kb: _initial(kb, bias="one_variable"), "SELECT p, greatest(count(DISTINCT s), count(DISTINCT o)) AS support, CASE WHEN count(DISTINCT s) >= count(DISTINCT o) THEN 0 ELSE 2 END AS functional FROM kb GROUP BY p HAVING greatest(count(DISTINCT s), count(DISTINCT o)) >= 100")


def _batched_sizes(kb: KB, pca: bool) -> DataFrame:
    rules = [(k, parse_rule(t), f) for k, (t, f) in enumerate(_RULES.values()) if k < 4]
    return body_sizes(kb, rules, pca).select("rid", "n")


for _pca in (False, True):
    _add(
        "batched_pca_bodies" if _pca else "batched_bodies",
        lambda kb, pca=_pca: _batched_sizes(kb, pca),
        " UNION ALL ".join(
            f"SELECT CAST({k} AS BIGINT) AS rid, count(*) AS n FROM ({_bgp('  '.join(' '.join(a) for a in parse_rule(t)[1:]), ['a', 'b'])})" + (f" WHERE a IN (SELECT s FROM kb WHERE p = '{parse_rule(t)[0][1]}')" if _pca else "")
            for k, (t, _) in enumerate(list(_RULES.values())[:4])
        ),
    )


def _bound(kb: KB) -> DataFrame:
    from hornspark.functions.rules import Rule

    rule = Rule(parse_rule("?a customerNation ?z  ?b customerNation ?z => ?a buysFrom ?b"), support=1000, head_size=1, functional=0)
    (r,) = bounds.upper_bounds([rule], {x.p: x.asDict() for x in stats.profile(kb).collect()}, joints(kb))
    return kb.spark.createDataFrame([(round(r.std_upper_bound, 9), round(r.pca_upper_bound, 9))], "std double, pca double")


_add("rule_bounds", _bound, "SELECT round(1000 / count(DISTINCT s), 9) AS std, round(1000 / count(DISTINCT CASE WHEN s IN (SELECT s FROM kb WHERE p = 'buysFrom') THEN s END), 9) AS pca FROM kb WHERE p = 'customerNation'")


def _estimate(kb: KB) -> DataFrame:
    from hornspark.functions.rules import Rule

    rule = Rule(parse_rule(_RULES["rule_metrics_nation"][0]), support=1000, head_size=1, functional=0)
    (r,) = bounds.pca_estimates([rule], {x.p: x.asDict() for x in stats.profile(kb).collect()}, joints(kb))
    return kb.spark.createDataFrame([(round(r.pca_estimate, 9),)], "estimate double")


_add(
    "rule_pca_estimate",
    _estimate,
    """, f AS (SELECT p, count(DISTINCT s) / count(*) AS fun, count(DISTINCT o) / count(*) AS ifun, count(DISTINCT o) AS no FROM kb GROUP BY p),
    x AS (SELECT (SELECT count(*) FROM (SELECT s FROM kb WHERE p = 'customerNation' INTERSECT SELECT s FROM kb WHERE p = 'buysFrom')) AS head,
      (SELECT count(*) FROM (SELECT o FROM kb WHERE p = 'customerNation' INTERSECT SELECT o FROM kb WHERE p = 'supplierNation')) AS meet)
    SELECT round(1000 / (head * (1 / i.fun) * (meet / i.no) * (o.fun / o.ifun)), 9) AS estimate FROM x, f i, f o WHERE i.p = 'customerNation' AND o.p = 'supplierNation'""",
)

_PREDICT = [("?a customerNation ?z  ?b supplierNation ?z => ?a buysFrom ?b", 0.33), ("?z placedBy ?a  ?z suppliedBy ?b => ?a buysFrom ?b", 1.0)]


def _predictions(kb: KB) -> DataFrame:
    return predict.best(kb, [(parse_rule(t), c) for t, c in _PREDICT], 5).select("s", "p", "o", F.col("rank").cast("long").alias("rank"))


_add(
    "rank_predictions",
    _predictions,
    f""", x AS ({_bgp(_PATHS[0], ['a', 'b'])} EXCEPT SELECT s, o FROM kb WHERE p = 'buysFrom'),
    y AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS rank FROM x) SELECT a AS s, 'buysFrom' AS p, b AS o, rank FROM y WHERE rank <= 5""",
)
