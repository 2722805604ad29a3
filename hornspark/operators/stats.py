"""Statistics of relations and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornspark.operators.taxonomy import domains_ranges, types
from hornspark.sources.kb import KB

def _n():
    return F.count(F.lit(1))



def profile(kb: KB) -> DataFrame:
    """Per relation: facts, subjects, objects, functionalities, variances, and the position that is counted on.

    Facts per (relation, subject) and per (relation, object) are counted first, so a distinct count is
    a plain count, and both variances come from the same rows.
    """
    def side(column: str, n: str, var: str) -> DataFrame:
        per = kb.df.groupBy("p", column).agg(_n().alias("c"))
        return per.groupBy("p").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias(n), (F.sum(F.col("c") * F.col("c")) / F.count(F.lit(1)) - F.pow(F.sum("c") / F.count(F.lit(1)), 2)).alias(var))

    both = side("s", "ns", "var").join(side("o", "no", "ivar").drop("n"), "p")
    fun, ifun = F.col("ns") / F.col("n"), F.col("no") / F.col("n")
    return both.select("p", "n", "ns", "no", fun.alias("fun"), ifun.alias("ifun"), "var", "ivar", F.when(F.col("ns") >= F.col("no"), 0).otherwise(2).alias("functional_pos"))


def sizes(kb: KB) -> DataFrame:
    """One row: facts, and distinct subjects, relations, objects and entities."""
    ends = kb.df.select(F.col("s").alias("e"), F.lit(1).alias("is_s"), F.lit(0).alias("is_o")).unionByName(kb.df.select(F.col("o").alias("e"), F.lit(0).alias("is_s"), F.lit(1).alias("is_o")))
    entity = ends.groupBy("e").agg(F.max("is_s").alias("is_s"), F.max("is_o").alias("is_o"), F.sum("is_s").alias("facts"))
    whole = entity.agg(F.sum("facts").alias("facts"), F.sum("is_s").alias("subjects"), F.sum("is_o").alias("objects"), _n().alias("entities"))
    relations = kb.df.groupBy("p").agg(_n().alias("n")).agg(_n().alias("relations"))
    return whole.crossJoin(relations).select("facts", "subjects", "relations", "objects", "entities")  # one row each


def relation_counts(kb: KB, at_least: int = 0) -> DataFrame:
    return kb.df.groupBy("p").agg(_n().alias("n")).filter(F.col("n") >= at_least)


def overlaps(kb: KB, kind: str, different: bool = True) -> DataFrame:
    """(r1, r2, n): entities that are arguments of both; ``kind`` names the sides: ss, so or oo."""
    a = kb.df.select(F.col("p").alias("r1"), F.col(kind[0]).alias("e")).distinct()
    b = kb.df.select(F.col("p").alias("r2"), F.col(kind[1]).alias("e")).distinct()
    out = a.join(b, "e").groupBy("r1", "r2").agg(_n().alias("n"))
    return out.filter("r1 <> r2") if different and kind[0] == kind[1] else out


def entity_occurrences(kb: KB) -> DataFrame:
    """(entity, n): in how many facts an entity is subject, plus in how many it is object."""
    return kb.df.select(F.explode(F.array("s", "o")).alias("entity")).groupBy("entity").agg(_n().alias("n"))


def histogram(kb: KB, inverse: bool = False) -> DataFrame:
    """(p, k, n): n entities have k values of the relation."""
    per = kb.df.groupBy("p", "o" if inverse else "s").agg(_n().alias("k"))
    return per.groupBy("p", "k").agg(_n().alias("n"))


def cumulative_histogram(kb: KB, inverse: bool = False) -> DataFrame:
    """(p, k, n): n entities have more than k values. Histograms are small: a window per relation."""
    above = Window.partitionBy("p").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    return histogram(kb, inverse).select("p", "k", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"))


def max_cardinality(kb: KB, limit: int | None = None) -> DataFrame:
    """(p, max_values, max_inverse): the largest number of values per entity, below ``limit`` where one is given (and that limit where there is none)."""
    def side(inverse: bool, name: str) -> DataFrame:
        h = histogram(kb, inverse)
        top = F.max("k") if limit is None else F.coalesce(F.max(F.when(F.col("k") < limit, F.col("k"))), F.lit(limit).cast("long"))
        return h.groupBy("p").agg(top.alias(name))

    return side(False, "max_values").join(side(True, "max_inverse"), "p")


def right_cumulative_cardinality(kb: KB, threshold: int, limit: int, inverse: bool = False) -> DataFrame:
    """(p, k): the smallest k over ``limit`` that fewer entities exceed than exceed ``limit``, yet at least ``threshold``; else -1."""
    c = cumulative_histogram(kb, inverse)
    at = histogram(kb, inverse).groupBy("p").agg(F.sum(F.when(F.col("k") > limit, F.col("n")).otherwise(0)).alias("at_limit"))
    fits = (F.col("k") > limit) & (F.col("n") < F.col("at_limit")) & (F.col("n") >= threshold)
    return c.join(at, "p").groupBy("p").agg(F.coalesce(F.min(F.when(fits, F.col("k"))), F.lit(-1).cast("long")).alias("k"))


def domain_histogram(kb: KB) -> DataFrame:
    """(p, k, n): the histogram over instances of the declared domain of each relation."""
    typed = types(kb).withColumnRenamed("type", "domain").join(domains_ranges(kb).filter("domain is not null").select("p", "domain"), "domain").select("p", F.col("entity").alias("s")).distinct()
    per = kb.df.join(typed, ["p", "s"], "left_semi").groupBy("p", "s").agg(_n().alias("k"))
    return per.groupBy("p", "k").agg(_n().alias("n"))


def cardinality_distributions(kb: KB) -> DataFrame:
    """(p, k, n, at_least): on the functional side of each relation, n entities have k values and at_least have k or more."""
    side = profile(kb).select("p", "functional_pos")
    h = histogram(kb).withColumn("functional_pos", F.lit(0)).unionByName(histogram(kb, True).withColumn("functional_pos", F.lit(2)))
    down = Window.partitionBy("p").orderBy(F.desc("k"))
    return h.join(side, ["p", "functional_pos"]).select("p", "k", "n", F.sum("n").over(down).alias("at_least"))


def missing_facts_sample(kb: KB, fraction: float = 0.1, seed: int = 7) -> DataFrame:
    """A sample of (entity, p): instances of a relation's domain without a value of it."""
    typed = types(kb).withColumnRenamed("type", "domain").join(domains_ranges(kb).filter("domain is not null").select("p", "domain"), "domain").select("entity", "p").distinct()
    have = kb.df.select(F.col("s").alias("entity"), "p").distinct()
    return typed.join(have, ["entity", "p"], "left_anti").sample(fraction, seed)
