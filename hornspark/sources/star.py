"""A knowledge base made of the star-schema tables, and one with a taxonomy on top; each as SQL that also other engines run.

Each is stored once a session and folder of tables, by relation, in the shared folder; queries read the relations they name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from hornspark.sources.files import load, save
from hornspark.sources.kb import KB
from hornspark.sources.shared import shared_folder

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

_FACTS = [
    ("customerNation", "concat('c', c_custkey)", "concat('n', c_nationkey)", "customer"),
    ("marketSegment", "concat('c', c_custkey)", "concat('seg_', c_mktsegment)", "customer"),
    ("supplierNation", "concat('s', s_suppkey)", "concat('n', s_nationkey)", "supplier"),
    ("inRegion", "concat('n', n_nationkey)", "concat('r', n_regionkey)", "nation"),
    ("placedBy", "concat('o', o_orderkey)", "concat('c', o_custkey)", "orders"),
    ("orderPriority", "concat('o', o_orderkey)", "concat('pri_', o_orderpriority)", "orders"),
    ("orderStatus", "concat('o', o_orderkey)", "concat('st_', o_orderstatus)", "orders"),
    ("suppliedBy", "concat('o', l_orderkey)", "concat('s', l_suppkey)", "lineitem"),
    ("buysFrom", "concat('c', o_custkey)", "concat('s', l_suppkey)", "orders JOIN lineitem ON o_orderkey = l_orderkey"),
    ("brand", "concat('p', p_partkey)", "concat('b_', p_brand)", "part"),
    ("partType", "concat('p', p_partkey)", "concat('t_', p_type)", "part"),
    ("didEvent", "concat('c', user_id)", "concat('ev_', event_type)", "events"),
]
_TYPES = [
    ("concat('c', c_custkey)", "concat('seg_', c_mktsegment)", "customer"),
    ("concat('s', s_suppkey)", "'Supplier'", "supplier"),
    ("concat('c', c_custkey)", "'Supplier'", "customer WHERE c_custkey % 10 = 0"),
    ("concat('n', n_nationkey)", "'Nation'", "nation"),
    ("concat('r', r_regionkey)", "'Region'", "region"),
    ("concat('o', o_orderkey)", "concat('st_', o_orderstatus)", "orders"),
]
#: The taxonomy above the types, with a diamond.
_SCHEMA = [
    ("Customer", "rdfs:subClassOf", "Agent"),
    ("Customer", "rdfs:subClassOf", "Party"),
    ("Supplier", "rdfs:subClassOf", "Agent"),
    ("Agent", "rdfs:subClassOf", "owl:Thing"),
    ("Party", "rdfs:subClassOf", "owl:Thing"),
    ("Nation", "rdfs:subClassOf", "Place"),
    ("Region", "rdfs:subClassOf", "Place"),
    ("Place", "rdfs:subClassOf", "owl:Thing"),
    ("Order", "rdfs:subClassOf", "owl:Thing"),
    ("customerNation", "rdfs:domain", "Customer"),
    ("customerNation", "rdfs:range", "Nation"),
    ("supplierNation", "rdfs:domain", "Supplier"),
    ("placedBy", "rdfs:range", "Customer"),
    ("inRegion", "rdfs:range", "Region"),
    ("buysFrom", "rdfs:subPropertyOf", "dealsWith"),
    ("dealsWith", "rdfs:domain", "Agent"),
    ("dealsWith", "rdfs:range", "Supplier"),
]


def _select(s: str, p: str, o: str, source: str) -> str:
    return f"SELECT {s} AS s, {p} AS p, {o} AS o FROM {source}"


KB_SQL = "SELECT DISTINCT s, p, o FROM (\n" + "\nUNION ALL ".join(_select(s, f"'{p}'", o, t) for p, s, o, t in _FACTS) + "\n) t WHERE s IS NOT NULL AND o IS NOT NULL"
_SCHEMA_SQL = "\nUNION ALL ".join(
    [_select("concat('seg_', c_mktsegment)", "'rdfs:subClassOf'", "'Customer'", "customer"), _select("concat('st_', o_orderstatus)", "'rdfs:subClassOf'", "'Order'", "orders")]
    + [f"SELECT '{s}' AS s, '{p}' AS p, '{o}' AS o" for s, p, o in _SCHEMA]
)
_TAXONOMY = "\nUNION ALL ".join([*(_select(s, "'rdf:type'", o, t) for s, o, t in _TYPES), _SCHEMA_SQL])
TAXONOMY_SQL = f"SELECT DISTINCT s, p, o FROM (\n{KB_SQL}\nUNION ALL {_TAXONOMY}\n) u WHERE s IS NOT NULL AND o IS NOT NULL"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(text, **{t: f for t, f in frames.items() if f"{{{t}}}" in text})


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> KB:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        save(build(), where, rebalance=False)  # a task has one relation, as each is a branch of its own
        _STORED[key] = where
    return load(spark, _STORED[key])


def _once(source: str, *values: str) -> str:
    """The distinct rows of the columns that ``values`` are made of; these are numbers for the most part, and names are not."""
    return f"(SELECT DISTINCT {', '.join(re.search(r", (\w+)\)$", v)[1] for v in values)} FROM {source})"


def star_kb(spark: SparkSession, sf_dir: str, relations: Collection[str] | None = None) -> KB:
    """Only relations whose tables may repeat a fact are made distinct; the others have a key.

    A query that names its ``relations`` needs a store of these alone, unless the whole one is there.
    """
    repeated = {"suppliedBy", "buysFrom", "didEvent"}
    whole = relations is None or (spark.sparkContext.applicationId, sf_dir, "star") in _STORED

    def build() -> KB:
        parts = [_select(s, f"'{p}'", o, _once(t, s, o) if p in repeated else t) for p, s, o, t in _FACTS if whole or p in relations]
        return KB(_run(spark, sf_dir, "\nUNION ALL ".join(parts)).dropna(), distinct=False)

    return _stored(spark, sf_dir, "star" if whole else "-".join(["star", *sorted(relations)]), build)


def taxonomy_kb(spark: SparkSession, sf_dir: str) -> KB:
    """The star-schema store and, in a store of their own, types and schema; no relation is in both."""

    def build() -> KB:
        parts = [_select(s, "'rdf:type'", o, t) for s, o, t in _TYPES]
        return KB(_run(spark, sf_dir, "\nUNION ALL ".join(parts)).dropna().unionByName(KB(_run(spark, sf_dir, _SCHEMA_SQL)).df), distinct=False)

    types = _stored(spark, sf_dir, "types", build)
    return KB(star_kb(spark, sf_dir).df.unionByName(types.df), distinct=False, stored=True)
