"""Files of facts, rules and types, in and out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.functions.terms import Query, parse_rule
from hornspark.sources.kb import KB


def read_facts(spark: SparkSession, paths: str | Sequence[str], delimiter: str = "\t", strip_dots: bool = False) -> KB:
    """Lines ``s DELIM p DELIM o`` or ``id DELIM s DELIM p DELIM o``; the delimiter is a Java regular expression.

    A blank and a dot that end a line go (with ``strip_dots`` a dot alone, too). Fields are trimmed, lines
    with other numbers of fields are skipped. Directories are read with all below them.
    """
    text = spark.read.option("recursiveFileLookup", "true").text([paths] if isinstance(paths, str) else list(paths))
    line = F.regexp_replace("value", r"\s*\.\s*$" if strip_dots else r"\s+\.\s*$", "")
    parts = F.split(F.trim(line) if strip_dots else line, delimiter)
    split = text.select(parts.alias("f")).filter(F.size("f").isin(3, 4))
    return KB(split.select(*(F.trim(F.element_at("f", k)).alias(c) for c, k in (("s", -3), ("p", -2), ("o", -1)))))


_NT = re.compile(r'\s*(<[^>]*>|_:\S+|[A-Za-z][\w.-]*:[^\s;,]*|:[^\s;,]+|a(?=\s)|@prefix|@base|PREFIX|BASE|"""(?:[^"\\]|\\.|"(?!""))*"""(?:@[\w-]+|\^\^\S+)?|"(?:[^"\\\n]|\\.)*"(?:@[\w-]+|\^\^(?:<[^>]*>|[^\s;,.]+))?|[+-]?\d+(?:\.\d+)?|true|false|#[^\n]*|[.;,])', re.S)


def turtle_triples(text: str) -> Iterator[tuple[str, str, str]]:
    """Triples of N-Triples and of Turtle without collections and blank node lists; other syntax raises."""
    prefixes: dict[str, str] = {}
    base, at, n = "", 0, len(text)
    tokens: list[str] = []
    while at < n:
        m = _NT.match(text, at)
        if m is None:
            if not text[at:].strip():
                break
            raise ValueError(f"Turtle that is not supported: {text[at:at + 40]!r}")
        at = m.end()
        if not m[1].startswith("#"):
            tokens.append(m[1])

    def term(t: str) -> str:
        if t == "a":
            return "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
        if t.startswith("<"):
            return t if re.match(r"<[A-Za-z][\w+.-]*:", t) else f"<{base}{t[1:-1]}>"
        if t[0] in '"_' or t[0].isdigit() or t[0] in "+-" or t in ("true", "false"):
            return t
        name, local = t.split(":", 1)
        return f"<{prefixes[name]}{local}>"

    k, subject, relation = 0, None, None
    while k < len(tokens):
        t = tokens[k]
        if t in ("@prefix", "PREFIX"):
            prefixes[tokens[k + 1].rstrip(":")] = tokens[k + 2][1:-1]
            k += 4 if t == "@prefix" else 3
        elif t in ("@base", "BASE"):
            base = tokens[k + 1][1:-1]
            k += 3 if t == "@base" else 2
        elif t in (".", ";", ","):
            if t == ".":
                subject = relation = None
            elif t == ";":
                relation = None
            k += 1
        elif subject is None:
            subject, k = term(t), k + 1
        elif relation is None:
            relation, k = term(t), k + 1
        else:
            yield subject, relation, term(t)
            k += 1


def read_rdf(spark: SparkSession, paths: str | Sequence[str], whole_files: bool = True, shorten: bool = True) -> tuple[KB, DataFrame | None]:
    """Turtle files (each parsed whole, as prefixes hold for a file) or, line by line, N-Triples; with short IRIs and their prefixes."""
    text = spark.read.text([paths] if isinstance(paths, str) else list(paths), wholetext=whole_files)

    def parse(batches):
        for batch in batches:
            rows = [t for x in batch.column(0).to_pylist() for t in turtle_triples(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["s", "p", "o"])

    from pyspark import cloudpickle
    import hornspark.sources.files as here

    cloudpickle.register_pickle_by_value(here)
    facts = text.mapInArrow(parse, "s string, p string, o string")
    return shortened(facts) if shorten else (KB(facts), None)


_IRI = r"^<(.*[/#])([^/#>]*)>$"


def shortened(facts: DataFrame) -> tuple[KB, DataFrame]:
    """IRIs as ``pN:local``, cut at the last ``#`` or ``/``, and the table (prefix, iri). Prefixes are few next to facts."""
    space = lambda c: F.regexp_extract(c, _IRI, 1)
    spaces = facts.select(F.explode(F.array(*(space(c) for c in ("s", "p", "o")))).alias("iri")).filter("iri <> ''").distinct()
    rows = [r.iri for r in spaces.orderBy("iri").collect()]
    table = facts.sparkSession.createDataFrame([(f"p{k}", iri) for k, iri in enumerate(rows)], "prefix string, iri string")
    for c in ("s", "p", "o"):
        short = F.concat("prefix", F.lit(":"), F.regexp_extract(c, _IRI, 2))
        facts = facts.join(table.withColumnRenamed("iri", "_iri"), F.col("_iri") == space(c), "left").withColumn(c, F.coalesce(short, c)).drop("prefix", "_iri")
    return KB(facts), table


def write_facts(kb: KB, path: str, delimiter: str = "\t") -> None:
    kb.df.write.option("sep", delimiter).option("quote", "").csv(path)


def save(kb: KB, path: str, mode: str = "errorifexists", rebalance: bool = True) -> None:
    """Parquet by relation, so that an atom's scan reads its relation alone. Adaptive execution splits large relations and joins small ones.

    Without ``rebalance`` each task writes its own facts: no shuffle, and few files where tasks have few relations.
    """
    (kb.df.hint("rebalance", F.col("p")) if rebalance else kb.df).write.mode(mode).partitionBy("p").parquet(path)


def load(spark: SparkSession, path: str) -> KB:
    return KB(spark.read.schema("s string, o string, p string").parquet(path).select("s", "p", "o"), distinct=False, stored=True)


def read_rules(spark: SparkSession, path: str) -> list[Query]:
    """The rules in the first column of a tab-separated file; other lines are skipped."""
    rows = spark.read.text(path).select(F.split("value", "\t")[0].alias("rule")).collect()
    return [r for r in (parse_rule(x.rule) for x in rows) if r]


def write_rules(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def read_type_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="type string, n long")


def read_type_intersections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="t1 string, t2 string, n long")
