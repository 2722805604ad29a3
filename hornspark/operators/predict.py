"""Rules applied to a training graph: ranked predictions, and filtered ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornspark.functions.terms import Query, variables
from hornspark.plans.batch import bindings, by_shape, chunks
from hornspark.plans.refine import legs
from hornspark.sources.kb import KB
from hornspark.sources.shared import shared_folder


def predictions(kb: KB, rules: Sequence[tuple[Query, float]], known: bool = False) -> DataFrame:
    """(s, p, o, confidences): what the rules' bodies imply, with the confidences of all rules that do, highest first.

    Facts of the store are left out unless ``known``. Rules whose head has a constant give it.
    """
    plans = []
    numbered = [(k, rule) for k, (rule, _) in enumerate(rules)]
    for shape, rows in by_shape(numbered).items():
        in_body = set(variables(shape[1:]))
        if not set(variables([shape[0]])) <= in_body:
            continue
        for part in chunks(rows):
            pairs = bindings(kb, shape, part, variables([shape[0]]), head=False)
            heads = F.broadcast(kb.spark.createDataFrame([(rid, rules[rid][0][0][1], rules[rid][0][0][0], rules[rid][0][0][2], float(rules[rid][1])) for rid, _ in part], "rid long, p string, _s string, _o string, conf double"))
            ends = {c: F.col(t) if t in in_body else F.col(f"_{c}") for c, t in (("s", shape[0][0]), ("o", shape[0][2]))}
            plans.append(pairs.join(heads, "rid").select(ends["s"].alias("s"), "p", ends["o"].alias("o"), "conf"))
    if not plans:
        return kb.spark.createDataFrame([], "s string, p string, o string, confidences array<double>")
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    if not known:
        out = out.join(kb.df.filter(F.col("p").isin(sorted({rule[0][1] for rule, _ in rules}))), ["s", "p", "o"], "left_anti")
    return out.groupBy("s", "p", "o").agg(F.sort_array(F.collect_list("conf"), False).alias("confidences"))


def ranked(found: DataFrame, side: str = "o", k: int = 100) -> DataFrame:
    """The k best candidates for each query, by their list of confidences (the higher first entry, then the next; ties by name)."""
    fixed = ["s", "p"] if side == "o" else ["p", "o"]
    order = Window.partitionBy(*fixed).orderBy(F.desc("confidences"), side)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _widest(kb: KB, rules: Sequence[tuple[Query, float]]) -> int | None:
    """The rule with the most expected pairs, of those whose bodies are two atoms that meet in one variable which the head lacks; no fact is shuffled for it."""
    shapes = {k: next(iter(by_shape([(k, rule)]).items())) for k, (rule, _) in enumerate(rules)}
    own = {k: [(names[int(r[1:])], z) for r, _, z, _ in legs(shape)] for k, (shape, ((_, names),)) in shapes.items() if legs(shape)}
    if not own:
        return None
    counts = kb.df.filter(F.col("p").isin(sorted({r for x in own.values() for r, _ in x}))).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o"))
    known = {r.p: r for r in counts.collect()}
    size = {k: known[a].n * known[b].n / max(known[a][x], known[b][y]) if a in known and b in known else 0 for k, ((a, x), (b, y)) in own.items()}
    return max(size, key=lambda k: (size[k], -k))


def best(kb: KB, rules: Sequence[tuple[Query, float]], k: int = 100) -> DataFrame:
    """``ranked(predictions(kb, rules), "o", k)``, without all pairs of the rule that implies the most.

    What that rule alone implies has one list of confidences and is ranked by name. Of a subject's objects under it the
    first k and as many more as the store or other rules have of them hold its k best ones, so no others are made.
    """
    wide = _widest(kb, rules)
    if wide is None:
        return ranked(predictions(kb, rules), "o", k)
    rule, conf = rules[wide]
    p = rule[0][1]
    ((shape, ((_, names),)),) = by_shape([(0, rule)]).items()
    sides = {end: kb.facts(names[int(r[1:])]).select(F.col(e).alias("e"), F.col(z).alias("z")) for r, e, z, end in legs(shape)}
    mine, theirs = (sides[v].withColumnRenamed("e", c) for v, c in zip(variables([shape[0]]), "so", strict=True))
    shared_folder(kb.spark)

    def under(pairs: DataFrame) -> DataFrame:
        """The distinct (s, o) that the rule implies, too."""
        return pairs.select("s", "o").join(theirs, "o").join(mine, ["s", "z"], "left_semi").select("s", "o").distinct()

    rest = [r for i, r in enumerate(rules) if i != wide]
    new = predictions(kb, rest).checkpoint()
    both = under(new.filter(F.col("p") == p)).withColumn("too", F.lit(True))
    taken = under(kb.facts(p)).unionByName(both.select("s", "o")).checkpoint()
    more = taken.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    asked = mine.join(more, "s", "left").select("s", "z", F.explode(F.sequence(F.lit(1), (F.coalesce("n", F.lit(0)) + k).cast("int"))).alias("at"))
    placed = theirs.withColumn("at", F.row_number().over(Window.partitionBy("z").orderBy("o")))
    first = asked.join(placed, ["z", "at"]).select("s", "o").distinct().join(taken, ["s", "o"], "left_anti")
    alone = first.select("s", F.lit(p).alias("p"), "o", F.array(F.lit(float(conf))).alias("confidences"))
    several = new.join(both.withColumn("p", F.lit(p)), ["s", "p", "o"], "left")
    several = several.select("s", "p", "o", F.when(F.col("too"), F.sort_array(F.concat("confidences", F.array(F.lit(float(conf)))), False)).otherwise(F.col("confidences")).alias("confidences"))
    return ranked(several.unionByName(alone), "o", k)


def rank_metrics(found: DataFrame, test: DataFrame, known: DataFrame, k: int = 100) -> DataFrame:
    """(p, side, n, mrr, hits1, hits3, hits10) of test facts, and over all (p is null), with other known facts left out of the ranking."""
    parts = []
    for side, fixed in (("o", ["s", "p"]), ("s", ["p", "o"])):
        other = known.join(test, ["s", "p", "o"], "left_anti")
        clean = found.join(other, ["s", "p", "o"], "left_anti")
        mine = test.join(found, ["s", "p", "o"], "left").select("s", "p", "o", F.col("confidences").alias("mine"))
        rivals = clean.join(test.withColumnRenamed(side, "_answer").distinct(), fixed).filter(F.col(side) != F.col("_answer")).select(*fixed, F.col("_answer").alias(side), "confidences", F.col(side).alias("_rival"))
        ahead = rivals.join(mine.filter("mine is not null"), [*fixed, side]).filter((F.col("confidences") > F.col("mine")) | ((F.col("confidences") == F.col("mine")) & (F.col("_rival") < F.col(side))))
        above = ahead.groupBy("s", "p", "o").agg(F.count_distinct("_rival").alias("above"))
        rank = F.when(F.col("mine").isNotNull(), F.coalesce("above", F.lit(0)) + 1)
        parts.append(mine.join(above, ["s", "p", "o"], "left").select("p", F.lit("tail" if side == "o" else "head").alias("side"), F.when(rank <= k, rank).alias("rank")))
    rows = parts[0].unionByName(parts[1])
    hit = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))
    return rows.rollup("side", "p").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), hit(1).alias("hits1"), hit(3).alias("hits3"), hit(10).alias("hits10"))
