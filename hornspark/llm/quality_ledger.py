"""Operator 3: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule, so a policy (a version, the rules that reject on their own, and how many of the softer rules
reject together) is applied later without reading texts again, and ablations are counts over the
few distinct bit patterns.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. Measurements: n_words; word_chars, code points
in words; n_symbols, characters of ``[#*$%&|<>]``; n_dup_lines, lines with a word that equal an
earlier one; n_repeat_words, words in 5-word windows that occur twice or more; n_lines, lines with a
word; n_letters, A-Z, a-z and all characters beyond ASCII; n_upper, A-Z;
n_stutter, words equal to the word before.

Cases: null and empty texts have no words, fail ``few_words`` and are not kept. Rows are independent:
repeated rows and ties give equal rows, null ids stay, and other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hornspark.llm.common import SHINGLE, Hasher, fresh, int64, named, shingle_hashes, small_batches, texts

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_stutter"]

#: Rules in bit order: name, and when a document fails, over its measurements.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    ("dup_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("letters", "100 * n_letters < 40 * word_chars"),
    ("upper_case", "100 * n_upper > 40 * n_letters"),
    ("stutter", "100 * n_stutter > 30 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """Rejects on any bit of ``hard``, or on ``limit`` bits of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    limit: int = 1

    def rejects(self, bits: str = "fail_bits") -> str:
        return f"(({bits} & {self.hard}) <> 0 OR bit_count({bits} & {self.soft}) >= {self.limit})"


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", BASE | BIT["symbols"] | BIT["dup_lines"]),
        Policy("v2", BASE | BIT["symbols"] | BIT["dup_lines"], BIT["word_length"] | BIT["letters"] | BIT["upper_case"] | BIT["stutter"], 1),
    )
}
CURRENT = "v2"

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_BLANK = " \t\n\x0b\x0c\r"


def measure(text: str | None, hasher: Hasher) -> tuple[int, ...]:
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(count[0x80:0xC0].sum())
    words = hasher.words(text)
    n, repeats = len(words), 0
    if n > SHINGLE:
        s = shingle_hashes(words)
        order = np.argsort(s, kind="stable")
        same = np.r_[False, s[order][1:] == s[order][:-1], False]
        twice = order[same[1:] | same[:-1]]
        if len(twice):
            inside = np.zeros(n, bool)
            for k in range(SHINGLE):
                inside[twice + k] = True
            repeats = int(inside.sum())
    stutter = int((words[1:] == words[:-1]).sum())
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    upper = int(count[65:91].sum())
    letters = upper + int(count[97:123].sum()) + int(count[0xC0:].sum())
    return (n, points - int(count[_SPACES].sum()), int(count[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeats, len(lines), letters, upper, stutter)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(fold=False)
    for batch in batches:
        rows = np.array([measure(t, hasher) for t in texts(batch)], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(int64(rows[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])


def fail_bits(names: dict[str, str] | None = None) -> str:
    """The failure bits as SQL over the measurements, which may go by other ``names``."""
    called = names or {m: m for m in MEASURES}
    rules = [(BIT[name], " ".join(called.get(w, w) for w in rule.split(" "))) for name, rule in RULES]
    return "CAST(" + " + ".join(f"CASE WHEN {rule} THEN {bit} ELSE 0 END" for bit, rule in rules) + " AS BIGINT)"


def ledger(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits: bit i is set where rule i fails."""
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_measures, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("fail_bits", F.expr(fail_bits()))


def with_verdict(rows: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """base_failed and kept, from the bits alone."""
    return rows.withColumn("base_failed", F.expr(f"(fail_bits & {BASE}) <> 0")).withColumn("kept", F.expr(f"(fail_bits & {BASE}) = 0 AND NOT {policy.rejects()}"))


def ablations(rows: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only this rule rejects."""
    policies = list(POLICIES.values()) if policies is None else policies
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("docs"))
    cases = [
        F.struct(
            F.lit(p.version).alias("policy"),
            F.lit(name).alias("rule"),
            F.expr(f"(fail_bits & {BIT[name]}) <> 0").alias("fails"),
            F.expr(f"{p.rejects()} AND NOT {p.rejects(f'(fail_bits & {~BIT[name]})')}").alias("only"),
            F.expr(p.rejects()).alias("rejected"),
        )
        for p in policies
        for name, _ in RULES
    ]
    return (
        patterns.select("docs", F.explode(F.array(*cases)).alias("c"))
        .groupBy("c.policy", "c.rule")
        .agg(*(F.sum(F.when(F.col(f"c.{c}"), F.col("docs")).otherwise(0)).alias(n) for c, n in (("fails", "n_failed"), ("only", "n_only_rule"), ("rejected", "n_rejected"))))
    )


def kept_documents(spark: SparkSession, docs: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps; decided row by row, without a join.

    The measurements travel beside the columns of ``docs`` under names that these do not have.
    """
    small_batches(spark)
    names = docs.columns
    own = fresh(names, *(f"_{m}" for m in MEASURES), "_bits")
    *measures, bits = own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=False)
        for batch in batches:
            rows = np.array([measure(t, hasher) for t in texts(batch)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(int64(rows[:, i]) for i in range(len(MEASURES)))], [*names, *measures])

    rows = docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(m, LongType()) for m in measures)]))
    kept = f"({bits} & {BASE}) = 0 AND NOT {policy.rejects(bits)}"
    return rows.withColumn(bits, F.expr(fail_bits(dict(zip(MEASURES, measures, strict=True))))).filter(kept).select(*named(names))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    row_number() OVER () AS rid
  FROM documents),
g AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM d) GROUP BY 1),
m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    len(list_filter(ws[2:], lambda x, i: x = ws[i])) AS n_stutter
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, @BITS@ AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(fail_bits AS BIGINT) AS fail_bits,
  @KEPT@ AS kept
FROM b
""".replace("@BITS@", " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)).replace("@KEPT@", "NOT (" + " OR ".join(f"({rule})" for _, rule in RULES) + ")")


def result(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = with_verdict(ledger(spark, docs))
    return rows.select("doc_id", *MEASURES[:5], "base_failed", "fail_bits", "kept")
