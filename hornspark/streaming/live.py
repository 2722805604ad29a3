"""Facts that arrive as a stream: a store kept up to date, and rules reported as they are found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.formats import lines, rules_frame
from hornspark.plans.mine import MiningConfig, mine
from hornspark.sources.kb import KB, SPO


def distinct_facts(stream: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """A stream of (s, p, o) without nulls and repeats; with a watermark, repeats are remembered as long as it says."""
    facts = stream.dropna(subset=SPO)
    if watermark is None:
        return facts.dropDuplicates(SPO)
    return facts.withWatermark(time, watermark).dropDuplicatesWithinWatermark(SPO)


def relation_counts(stream: DataFrame, window: str | None = None, watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Facts per relation, or per relation and window of event time."""
    if window is None:
        return distinct_facts(stream).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    late = distinct_facts(stream, watermark, time)
    return late.groupBy(F.window(time, window).alias("window"), "p").agg(F.count(F.lit(1)).alias("n"))


def append_new_facts(path: str, on_change: Callable[[list[str]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: facts that the store at ``path`` lacks are added; ``on_change`` gets the relations that changed."""
    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = KB(batch).df
        try:
            old = spark.read.parquet(path)
            fresh = fresh.join(old.select(SPO), SPO, "left_anti")
        except Exception as e:  # the first batch makes the store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh = fresh.persist()
        changed = [r.p for r in fresh.select("p").distinct().collect()]
        if changed:
            fresh.write.mode("append").partitionBy("p").parquet(path)
        fresh.unpersist()
        if changed and on_change:
            on_change(sorted(changed))

    return add


def mine_to(kb: KB, config: MiningConfig, path: str) -> int:
    """Mine, appending the rules of each generation to a Parquet table as they are found; how many there are."""
    def write(rules) -> None:
        if rules:
            rules_frame(kb.spark, rules).coalesce(1).write.mode("append").parquet(path)

    return len(mine(kb, config, write))


def print_generation(rules) -> None:
    for line in lines(rules)[1:]:
        print(line, flush=True)
