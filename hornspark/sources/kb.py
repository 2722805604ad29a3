"""The fact store: a DataFrame (s, p, o) with set semantics, and operations on whole stores."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPO = ["s", "p", "o"]


class KB:
    """Facts without nulls and duplicates. ``distinct=False`` states that ``facts`` has none already, ``stored`` that they are files by relation."""

    def __init__(self, facts: DataFrame, distinct: bool = True, stored: bool = False):
        self.stored = stored
        facts = facts.select(*(F.col(c).cast("string").alias(c) for c in SPO))
        self.df = facts.dropna().dropDuplicates(SPO) if distinct else facts
        self.spark = facts.sparkSession

    @cached_property
    def relation_sizes(self) -> dict[str, int]:
        """Facts per relation; a knowledge base's vocabulary is small next to its facts."""
        return {r.p: r.n for r in self.df.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}

    def persist(self) -> "KB":
        """Files by relation are read again instead: a copy of all facts would go to disk once more."""
        from pyspark import StorageLevel

        if self.stored:
            return self
        self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.df.unpersist()

    def facts(self, relation: str) -> DataFrame:
        return self.df.filter(F.col("p") == relation).select("s", "o")

    def union(self, other: "KB") -> "KB":
        return KB(self.df.unionByName(other.df))

    def new_facts(self, other: "KB") -> DataFrame:
        """Facts of ``other`` that this store lacks."""
        return other.df.join(self.df, SPO, "left_anti")

    def intersect(self, other: "KB") -> "KB":
        return KB(self.df.join(other.df, SPO, "left_semi"), distinct=False)

    def delete(self, facts: DataFrame) -> "KB":
        return KB(self.df.join(facts.select(SPO), SPO, "left_anti"), distinct=False)

    def with_new_entities(self, old: DataFrame) -> "KB":
        """Facts with a typed entity, as subject or object, that is not in ``old`` (entity)."""
        typed = self.df.filter("p = 'rdf:type'").select(F.col("s").alias("entity")).distinct()
        new = typed.join(old.select("entity"), "entity", "left_anti")
        return KB(
            self.df.join(new, self.df.s == new.entity, "left_semi").unionByName(self.df.join(new, self.df.o == new.entity, "left_semi"))
        )

    def expanded_labels(self) -> "KB":
        """Objects ``x@lang`` also give (object, <label>, x) and (object, <lang>, lang)."""
        parts = F.split("o", "@")
        tagged = self.df.filter(F.size(parts) == 2).select("o", parts[0].alias("x"), parts[1].alias("lang")).distinct()
        label = tagged.select(F.col("o").alias("s"), F.lit("<label>").alias("p"), F.col("x").alias("o"))
        lang = tagged.select(F.col("o").alias("s"), F.lit("<lang>").alias("p"), F.col("lang").alias("o"))
        return KB(self.df.unionByName(label).unionByName(lang))
