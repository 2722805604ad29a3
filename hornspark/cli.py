"""Mining from the command line: ``python -m hornspark.cli facts.tsv [options]``."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from hornspark.plans.mine import MiningConfig

#: Short names of pruning metrics and biases.
METRICS = {"support": "support", "headcoverage": "head_coverage"}
BIASES = {"onevar": "one_variable", "default": "default", "signatured": "signatured", "lazy": "lazy", "lazit": "lazy", "chain": "chain", "instantiatedhead": "instantiated_head", "existential": "existential", "typed": "typed"}


def _names(text: str) -> tuple[str, ...]:
    return tuple(x for x in text.split(",") if x)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hornspark", prefix_chars="-")
    a = p.add_argument
    a("files", nargs="+", help="fact files; :sFILE names a file of schema facts")
    a("-mins", type=int, help="minimum support of rules")
    a("-minis", type=int, help="minimum size of head relations")
    a("-minhc", type=float, help="minimum head coverage")
    a("-pm", choices=METRICS, help="pruning metric")
    a("-oute", action="store_true", help="print rules at the end only")
    a("-ofmt", default="default", help="output format: default, chain, datalog, reverse_datalog")
    for name, what in (("bexr", "relations left out of bodies"), ("hexr", "relations left out of heads"), ("iexr", "relations that get no constants"), ("htr", "head relations"), ("btr", "body relations"), ("itr", "relations that may get constants")):
        a(f"-{name}", type=_names, default=(), help=what)
    a("-maxad", type=int, default=3, help="atoms of a rule")
    a("-maxadc", type=int, default=3, help="atoms of a rule with constants (chains)")
    a("-minpca", type=float, default=0.1, help="minimum PCA confidence")
    a("-minc", type=float, default=0.1, help="minimum standard confidence, with -enstd")
    a("-const", action="store_true", help="atoms with constants")
    a("-fconst", action="store_true", help="only atoms with constants")
    a("-bias", default="lazy", type=str.lower, choices=BIASES)
    a("-caos", action="store_true", help="count on subjects always")
    a("-nc", type=int, help="accepted; Spark sets the parallelism")
    a("-optimcb", action="store_true", help="confidence bounds")
    a("-optimfh", action="store_true", help="functionality heuristic")
    a("-verbose", action="store_true")
    a("-rl", type=int, default=3, help="how often a relation may occur")
    a("-auta", action="store_true", help="accepted, without effect")
    a("-deml", action="store_true", help="do not exploit the maximum length")
    a("-dqrw", action="store_true", help="accepted; counts do not change")
    a("-dpr", action="store_true", help="refine perfect rules, too")
    a("-oout", action="store_true", help="bounds and heuristics, no lossless prunings")
    a("-full", action="store_true", help="all prunings")
    a("-noHeuristics", action="store_true")
    a("-noKbRewrite", action="store_true", help="accepted; counts do not change")
    a("-noKbExistsDetection", action="store_true", help="accepted; counts do not change")
    a("-noSkyline", action="store_true")
    a("-vo", choices=["app", "fun", "ifun"], help="accepted; counts do not change")
    a("-ofile", help="write rules to this path")
    a("-enstd", action="store_true", help="standard confidence")
    a("-ompca", action="store_true", help="no PCA confidence")
    a("-optimai", action="store_true", help="adaptive instantiation")
    a("-mlg", action="store_true", help="expand multilingual labels")
    a("-d", default="\t", help="delimiter, a regular expression")
    return p


def config_of(o: argparse.Namespace) -> MiningConfig:
    if o.oout and o.full:
        raise ValueError("options do not go together: -oout and -full")
    metric = METRICS[o.pm] if o.pm else "support" if o.mins is not None and o.minhc is None else "head_coverage"
    initial = o.minis if o.minis is not None else o.mins if o.mins is not None and metric == "support" else 100
    strong = o.full or o.oout
    return MiningConfig(
        min_support=100 if o.mins is None else o.mins, min_initial_support=initial, min_head_coverage=0.01 if o.minhc is None else o.minhc,
        pruning_metric=metric, min_std_confidence=o.minc, min_pca_confidence=o.minpca, max_depth=o.maxad, max_depth_constants=o.maxadc,
        recursivity_limit=o.rl, bias=BIASES[o.bias], constants=o.const, only_constants=o.fconst, count_on_subject=o.caos,
        body_excluded=o.bexr, body_targets=o.btr, head_excluded=o.hexr, head_targets=o.htr, instantiation_excluded=o.iexr, instantiation_targets=o.itr,
        std=o.enstd, pca=not o.ompca, skyline="off" if o.noSkyline else "reference", perfect_rules=not (o.dpr or o.oout),
        exploit_max_length=not (o.deml or o.oout), bounds=o.optimcb or strong, heuristics=(o.optimfh or strong) and not o.noHeuristics, adaptive_instantiation=o.optimai,
    )


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    config = config_of(o)
    from pyspark.sql import SparkSession

    from hornspark.functions.formats import lines
    from hornspark.plans.mine import mine
    from hornspark.sources.files import read_facts, read_rdf, shortened, write_rules

    spark = SparkSession.builder.appName("hornspark").getOrCreate()
    prefixes: list = []

    def read(paths):
        whole = [p for p in paths if p.endswith((".ttl", ".n3"))]
        by_line = [p for p in paths if p.endswith(".nt")]  # N-Triples have no prefixes, so a line stands alone
        plain = [p for p in paths if p not in whole and p not in by_line]
        facts = [read_rdf(spark, p, f, shorten=False)[0].df for p, f in ((whole, True), (by_line, False)) if p]
        kbs = [read_facts(spark, plain, o.d)] if plain else []
        if facts:
            rdf, table = shortened(reduce(lambda a, b: a.unionByName(b), facts))
            prefixes.append(table)
            kbs.append(rdf)
        return kbs[0] if len(kbs) == 1 else kbs[0].union(kbs[1])

    kb = read([f for f in o.files if not f.startswith(":")])
    schema = [f[2:] for f in o.files if f.startswith(":s")]
    if o.mlg:
        kb = kb.expanded_labels()
    live = not (o.oute or o.ofile)
    header = lines([], o.ofmt, o.verbose, config.pca)

    def show(rules) -> None:
        for line in lines(rules, o.ofmt, o.verbose, config.pca)[len(header):]:
            print(line, flush=True)

    if live and header:
        print(header[0])
    rules = mine(kb, config, show if live else None, **({"schema": read(schema)} if schema else {}))
    if o.ofile:
        write_rules(spark, lines(rules, o.ofmt, o.verbose, config.pca), o.ofile)
    elif o.oute:
        print("\n".join(lines(rules, o.ofmt, o.verbose, config.pca)))
    for table in prefixes:
        for row in table.orderBy("prefix").collect():
            print(f"{row.prefix}\t{row.iri}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
