"""Schema facts: types, subclasses, domains and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.sources.kb import KB
from hornspark.sources.shared import shared_folder

#: Names of the schema relations; ``configure`` replaces them.
NAMES = {"type": "rdf:type", "subclass": "rdfs:subClassOf", "subproperty": "rdfs:subPropertyOf", "domain": "rdfs:domain", "range": "rdfs:range", "top": "owl:Thing"}


def configure(**names: str) -> None:
    NAMES.update(names)


def is_schema_relation(relation: str) -> bool:
    return relation in {v for k, v in NAMES.items() if k != "top"}


def _facts(kb: KB, name: str, s: str, o: str) -> DataFrame:
    return kb.facts(NAMES[name]).select(F.col("s").alias(s), F.col("o").alias(o))


def types(kb: KB) -> DataFrame:
    return _facts(kb, "type", "entity", "type")


def subclasses(kb: KB) -> DataFrame:
    return _facts(kb, "subclass", "sub", "super")


def closure(edges: DataFrame) -> DataFrame:
    """All (sub, super) pairs that one or more steps reach; cycles end, as each round goes on from new pairs alone.

    A pair of a type with itself is there only where it is on a cycle. Class hierarchies are small next to
    facts; each round is checkpointed so that plans do not grow.
    """
    shared_folder(edges.sparkSession)
    steps = edges.select("sub", "super").distinct().checkpoint()
    reach = new = steps
    while True:
        further = new.withColumnRenamed("super", "mid").join(steps.withColumnRenamed("sub", "mid"), "mid").select("sub", "super").distinct()
        new = further.join(reach, ["sub", "super"], "left_anti").checkpoint()
        if not new.limit(1).count():
            return reach
        reach = reach.unionByName(new)


def super_types(kb: KB, reflexive: bool = False) -> DataFrame:
    """(sub, super): the transitive superclasses of every class."""
    out = closure(subclasses(kb))
    if not reflexive:
        return out
    own = out.select("sub").union(out.select("super")).union(types(kb).select("type")).distinct()
    return out.unionByName(own.select(F.col("sub"), F.col("sub").alias("super"))).distinct()


def all_types(kb: KB) -> DataFrame:
    """(entity, type): declared types and all their superclasses."""
    own = types(kb)
    up = own.join(super_types(kb).withColumnRenamed("sub", "type"), "type").select("entity", F.col("super").alias("type"))
    return own.unionByName(up).distinct()


def leaf_types(kb: KB) -> DataFrame:
    """(entity, type): declared types that have no subclass."""
    return types(kb).join(subclasses(kb).select(F.col("super").alias("type")), "type", "left_anti").select("entity", "type")


def instances(kb: KB, type_: str) -> DataFrame:
    return types(kb).filter(F.col("type") == type_).select("entity")


def transitive_types(kb: KB, reflexive: bool = True) -> DataFrame:
    """(entity, type) of ``transitiveType``: superclasses of declared types, and with ``reflexive`` those themselves."""
    up = types(kb).join(super_types(kb).withColumnRenamed("sub", "type"), "type").select("entity", F.col("super").alias("type"))
    return (up.unionByName(types(kb)) if reflexive else up).distinct()


def type_counts(kb: KB) -> DataFrame:
    return types(kb).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def type_intersections(kb: KB, different: bool = False, least: int = 1) -> DataFrame:
    """(t1, t2, n): instances that two types share, a type with itself too unless ``different``."""
    a, b = types(kb).withColumnRenamed("type", "t1"), types(kb).withColumnRenamed("type", "t2")
    out = a.join(b, "entity").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return out.filter("t1 <> t2") if different else out


def domains_ranges(kb: KB) -> DataFrame:
    """(p, domain, range): declared for the relation, else for its superproperty; the least name where there are several."""
    def of(name: str) -> DataFrame:
        own = _facts(kb, name, "p", "t")
        up = _facts(kb, "subproperty", "p", "q").join(own.withColumnRenamed("p", "q"), "q").select("p", "t")
        best = own.withColumn("k", F.lit(0)).unionByName(up.withColumn("k", F.lit(1))).groupBy("p").agg(F.min(F.struct("k", "t")).alias("b"))
        return best.select("p", F.col("b.t").alias(name))

    return of("domain").join(of("range"), "p", "full_outer")


def domain_instances(kb: KB, relation: str, observed: str = "union", side: str = "domain") -> DataFrame:
    """Entities of a relation's domain or range: instances of the declared type, united with observed arguments or (``restrict``) observed arguments of that type."""
    column = "s" if side == "domain" else "o"
    seen = kb.facts(relation).select(F.col(column).alias("entity")).distinct()
    declared = domains_ranges(kb).filter(F.col("p") == relation).select(F.col(side).alias("type")).filter("type is not null")
    typed = types(kb).join(declared, "type").select("entity").distinct()
    return seen.join(typed, "entity", "left_semi") if observed == "restrict" else seen.union(typed).distinct()
