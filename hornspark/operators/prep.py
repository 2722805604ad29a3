"""Row-wise and join preparation of raw fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.operators.taxonomy import type_intersections
from hornspark.sources.kb import KB


def drop_fact_ids(rows: DataFrame) -> DataFrame:
    return rows.select(*rows.columns[1:])


def swap_columns(rows: DataFrame, i: int = 0, j: int = 1) -> DataFrame:
    names = list(rows.columns)
    names[i], names[j] = names[j], names[i]
    return rows.select(*(F.col(n).alias(m) for n, m in zip(names, rows.columns, strict=True)))


def subjects(kb: KB) -> DataFrame:
    return kb.df.select("s").distinct()


def keep_relations(kb: KB, relations: Sequence[str]) -> KB:
    return KB(kb.df.filter(F.col("p").isin(list(relations))), distinct=False)


def url_decoded(kb: KB) -> KB:
    return KB(kb.df.select(*(F.try_url_decode(F.col(c)).alias(c) for c in ("s", "p", "o"))))


def quoted_literal(value: Column) -> Column:
    """``text@eng`` as ``"text"@eng``; other values as they are."""
    return F.when(value.rlike(r"^[^\"].*@eng$"), F.concat(F.lit('"'), F.regexp_replace(value, "@eng$", ""), F.lit('"@eng'))).otherwise(value)


def wrapped(value: Column) -> Column:
    return F.when(value.rlike("^<.*>$"), value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def hash_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """An inner equi-join by column lists; unmatched rows go."""
    renamed = right.select(*(F.col(c).alias(f"_{c}" if c in right_on else c) for c in right.columns))
    on = [F.col(a) == F.col(f"_{b}") for a, b in zip(left_on, right_on, strict=True)]
    return left.join(renamed, on).drop(*(f"_{b}" for b in right_on))


def substituted(rows: DataFrame, column: str, mapping: DataFrame, mode: str = "uri") -> DataFrame:
    """Values of a column replaced by ``mapping`` (old, new); those without stay, wrapped in ``<>`` as uris, quoted as literals, or read as dates."""
    old = F.col(column)
    kept = {"uri": wrapped(old), "literal": F.concat(F.lit('"'), old, F.lit('"')), "date": date_literal(old)}[mode]
    return rows.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", kept)).drop("_new").select(rows.columns)


def date_literal(value: Column) -> Column:
    """An English date as an xsd:date literal, a year with unknown month and day, other text quoted."""
    day = F.coalesce(F.try_to_date(value, "d MMMM yyyy"), F.try_to_date(value, "MMMM d, yyyy"))
    return (
        F.when(day.isNotNull(), F.concat(F.lit('"'), F.date_format(day, "yyyy-MM-dd"), F.lit('"^^xsd:date')))
        .when(value.rlike(r"^\d{4}$"), F.concat(F.lit('"'), value, F.lit('-##-##"^^xsd:date')))
        .otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    )


def class_cooccurrence(kb: KB, least: int = 50) -> DataFrame:
    """(t1, t2, n): ordered pairs of different types with at least so many entities in common."""
    return type_intersections(kb, different=True, least=least)


def seed_sample(kb: KB, fraction: float, seed: int = 1) -> DataFrame:
    return subjects(kb).sample(fraction, seed)


def neighbourhood(kb: KB, seeds: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """(entity, hop): what is reached from ``seeds`` (entity) in so many steps along facts, with the least step."""
    edges = kb.df.select(F.col("s").alias("entity"), F.col("o").alias("next"))
    if not directed:
        edges = edges.unionByName(kb.df.select(F.col("o").alias("entity"), F.col("s").alias("next")))
    reached = seeds.select("entity").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for k in range(1, hops + 1):
        near = frontier.join(edges, "entity").select(F.col("next").alias("entity")).distinct()
        frontier = near.join(reached, "entity", "left_anti").withColumn("hop", F.lit(k))
        reached = reached.unionByName(frontier)
    return reached


def sampled_graph(kb: KB, seeds: DataFrame, hops: int, directed: bool = True) -> KB:
    """Facts whose subject is in the neighbourhood of the seeds."""
    inside = neighbourhood(kb, seeds, hops, directed).select(F.col("entity").alias("s"))
    return KB(kb.df.join(inside, "s", "left_semi"), distinct=False)
