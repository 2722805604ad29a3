"""Text forms of rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from hornspark.functions.rules import Rule, chain
from hornspark.functions.terms import DIFFERENT, Atom, is_var, rename, variables

#: Column titles of the tab-separated form.
COLUMNS = ["Rule", "Head Coverage", "Standard Confidence", "Pca Confidence", "Support", "Body Size", "Pca Body Size", "Functional Variable"]
VERBOSE = ["Std Conf Upper Bound", "Pca Conf Upper Bound", "Pca Conf Estimation"]

SCHEMA = (
    "rule string, head_relation string, length int, support long, head_coverage double, std_confidence double, pca_confidence double, "
    "body_size long, pca_body_size long, functional_variable string, generation int, std_upper_bound double, pca_upper_bound double, pca_estimate double"
)


def atom_text(a: Atom) -> str:
    return f"{a[0]}!={a[2]}" if a[1] == DIFFERENT else f"{a[0]} {a[1]} {a[2]}"


def rule_text(atoms: Sequence[Atom]) -> str:
    """``body => head``, body atoms in order of relation, object and subject."""
    body = sorted(atoms[1:], key=lambda a: (a[1], a[2], a[0]))
    return f"{'  '.join(map(atom_text, body))} => {atom_text(atoms[0])}".strip()


def _datalog_atom(a: Atom) -> str:
    return f"{a[1]}({a[0].lstrip('?')},{a[2].lstrip('?')})"


def datalog(atoms: Sequence[Atom]) -> str:
    return f"{_datalog_atom(atoms[0])} <= {', '.join(map(_datalog_atom, atoms[1:]))}"


def reverse_datalog(atoms: Sequence[Atom]) -> str:
    return f"{', '.join(map(_datalog_atom, atoms[1:]))} => {_datalog_atom(atoms[0])}"


def chain_line(rule: Rule) -> str:
    """PCA body size, support, PCA confidence and the rule with head variables X and Y and a path-ordered body."""
    s, _, o = rule.atoms[0]
    names = {t: n for t, n in ((s, "X"), (o, "Y")) if is_var(t)}
    body = chain(rule.atoms) or list(rule.atoms[1:])
    free = iter("ABCDEFGHIJKLMNOPQRSTUVW")
    for v in variables(body):
        if v not in names:
            names[v] = next(free)
    head, *rest = rename((rule.atoms[0], *body), names)
    return f"{rule.pca_body_size}\t{rule.support}\t{rule.pca_confidence}\t{_datalog_atom(head)} <= {', '.join(map(_datalog_atom, rest))}"


def _number(x: float | int | None) -> str:
    return "" if x is None else f"{x:.9f}" if isinstance(x, float) else str(x)


def tsv_line(rule: Rule, verbose: bool = False, columns: Sequence[str] = COLUMNS) -> str:
    values = dict(
        zip(
            COLUMNS,
            [rule_text(rule.atoms), _number(rule.head_coverage), _number(rule.std_confidence), _number(rule.pca_confidence), _number(rule.support), _number(rule.body_size), _number(rule.pca_body_size), rule.functional_variable],
            strict=True,
        )
    )
    out = [values[c] for c in columns]
    if verbose:
        out += [_number(rule.std_upper_bound), _number(rule.pca_upper_bound), _number(rule.pca_estimate)]
    return "\t".join(out)


_FORMATS: dict[str, Callable[[Rule, bool], str]] = {
    "default": tsv_line,
    "chain": lambda r, v: chain_line(r),
    "datalog": lambda r, v: datalog(r.atoms),
    "reverse_datalog": lambda r, v: reverse_datalog(r.atoms),
}


def register_formatter(name: str, line: Callable[[Rule, bool], str]) -> None:
    _FORMATS[name] = line


def lines(rules: Sequence[Rule], form: str = "default", verbose: bool = False, with_pca: bool = True) -> list[str]:
    """The rules as text, under a header in the tab-separated form."""
    if form != "default":
        return [_FORMATS[form](r, verbose) for r in rules]
    columns = [c for c in COLUMNS if with_pca or "pca" not in c.lower()]
    header = "\t".join([*columns, *(VERBOSE if verbose else [])])
    return [header, *(tsv_line(r, verbose, columns) for r in rules)]


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (
            rule_text(r.named().atoms), r.atoms[0][1], len(r.atoms), r.support, r.head_coverage, r.std_confidence, r.pca_confidence,
            r.body_size, r.pca_body_size, r.named().functional_variable, r.generation, r.std_upper_bound, r.pca_upper_bound, r.pca_estimate,
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, SCHEMA)
