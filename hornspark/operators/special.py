"""Virtual relations as DataFrames (a, b): what an atom ``a relation b`` holds for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.terms import EQUALS, EXISTS, EXISTS_INV, NOT_EXISTS, NOT_EXISTS_INV, TRANSITIVE_TYPE, cardinality, is_var
from hornspark.operators.taxonomy import transitive_types
from hornspark.sources.kb import KB


def _side(inverse: bool) -> tuple[str, str]:
    return ("o", "s") if inverse else ("s", "o")


def having(kb: KB, inverse: bool = False) -> DataFrame:
    """(p, e): entities that a relation has as subject, or as object with ``inverse``."""
    return kb.df.select("p", F.col(_side(inverse)[0]).alias("e")).distinct()


def universe(kb: KB, inverse: bool = False) -> DataFrame:
    return kb.df.select(F.col(_side(inverse)[0]).alias("e")).distinct()


def lacking(kb: KB, relation: str | None, entity: str | None, inverse: bool) -> DataFrame:
    """(p, e): entities of the universe that a relation lacks; the relations times the entities where neither is given."""
    known = having(kb, inverse)
    if relation is not None:
        known = known.filter(F.col("p") == relation)
        pairs = universe(kb, inverse).withColumn("p", F.lit(relation))
        if entity is not None:
            pairs = pairs.filter(F.col("e") == entity)
    else:
        names = F.array(*[F.lit(r) for r in sorted(kb.relation_sizes)])  # relation names are few
        one = kb.spark.createDataFrame([(entity,)], "e string") if entity is not None else universe(kb, inverse)
        pairs = one.withColumn("p", F.explode(names))
    return pairs.select("p", "e").join(known, ["p", "e"], "left_anti")


def cardinalities(kb: KB, relation: str, inverse: bool) -> DataFrame:
    """(e, n): how many values of a relation each entity has; those without are left out."""
    mine, _ = _side(inverse)
    return kb.facts(relation).groupBy(F.col(mine).alias("e")).agg(F.count(F.lit(1)).alias("n"))


def with_cardinality(kb: KB, kind: str, inverse: bool, n: int, relation: str) -> DataFrame:
    """(e): entities whose number of values is equal to, greater than or smaller than n."""
    counts = cardinalities(kb, relation, inverse)
    if kind == "GreaterThan":
        return counts.filter(F.col("n") > n).select("e")
    if kind == "Equals" and n > 0:
        return counts.filter(F.col("n") == n).select("e")
    none = universe(kb, inverse).join(counts, "e", "left_anti")
    if kind == "Equals":
        return none
    return none.unionByName(counts.filter(F.col("n") < n).select("e")) if n > 0 else none.limit(0)


def relation_pairs(kb: KB, s: str, relation: str, o: str, reflexive: bool = True) -> DataFrame:
    """(a, b) of the atom ``s relation o``, restricted to its constants."""
    a, b = (None if is_var(t) else t for t in (s, o))
    if relation in (EXISTS, EXISTS_INV):
        out = having(kb, relation == EXISTS_INV).select(F.col("p").alias("a"), F.col("e").alias("b"))
    elif relation in (NOT_EXISTS, NOT_EXISTS_INV):
        out = lacking(kb, a, b, relation == NOT_EXISTS_INV).select(F.col("p").alias("a"), F.col("e").alias("b"))
    elif relation == TRANSITIVE_TYPE:
        out = transitive_types(kb, reflexive).select(F.col("entity").alias("a"), F.col("type").alias("b"))
    elif relation == EQUALS:
        out = universe(kb).select(F.col("e").alias("a"), F.col("e").alias("b"))
    elif (c := cardinality(relation)) is not None:
        if b is None:
            raise ValueError("a cardinality atom needs a relation as its object")
        out = with_cardinality(kb, *c, b).select(F.col("e").alias("a"), F.lit(b).alias("b"))
    else:
        raise ValueError(f"{relation} cannot be enumerated")
    for column, constant in (("a", a), ("b", b)):
        if constant is not None:
            out = out.filter(F.col(column) == constant)
    return out
