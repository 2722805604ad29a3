"""Breadth-first mining of Horn rules.

The driver holds the rules and the search; facts are only ever joined and counted on the executors,
with a constant number of plans per generation and shape.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.functions.rules import Rule, canonical, head_key, is_closed, open_variables, openable_variables, real_length, redundant, subsumes, without_implied
from hornspark.functions.terms import DIFFERENT, EXISTS, EXISTS_INV, OWN, Query, is_unfolded, is_var, occurrences, unfolded, variables
from hornspark.operators.bounds import pca_estimates, upper_bounds
from hornspark.operators.taxonomy import NAMES, domains_ranges, subclasses
from hornspark.plans.pairs import Joint, Joints, counted_body, counted_single, joints, profiles
from hornspark.plans.refine import body_sizes, least_bodies, products, refinements, single_counts, support_counts, with_atom
from hornspark.sources.kb import KB


BIASES = ("default", "lazy", "one_variable", "signatured", "chain", "seeds", "instantiated_head", "existential", "existential_head", "typed")
#: The relation of the facts that mark seeds, in the store of a run with seeds alone.
SEED = "<seed>"


@dataclass(frozen=True)
class MiningConfig:
    """All options of a run. ``BIASES`` names the biases; ``register_bias`` adds more."""

    min_support: int = 100
    min_initial_support: int = 100
    min_head_coverage: float = 0.01
    pruning_metric: str = "head_coverage"
    min_std_confidence: float = 0.1
    min_pca_confidence: float = 0.1
    max_depth: int = 3
    max_depth_constants: int = 3
    recursivity_limit: int = 3
    bias: str = "lazy"
    constants: bool = False
    only_constants: bool = False
    count_on_subject: bool = False
    body_excluded: tuple[str, ...] = ()
    body_targets: tuple[str, ...] = ()
    head_excluded: tuple[str, ...] = ()
    head_targets: tuple[str, ...] = ()
    instantiation_excluded: tuple[str, ...] = ()
    instantiation_targets: tuple[str, ...] = ()
    std: bool = False
    pca: bool = True
    skyline: str = "reference"
    perfect_rules: bool = True
    exploit_max_length: bool = True
    bounds: bool = False
    heuristics: bool = False
    adaptive_instantiation: bool = False
    strict_constants: bool = True
    count_special: bool = False

    def __post_init__(self) -> None:
        clashes = [
            (self.head_targets and self.head_excluded, "head targets and excluded heads"),
            (self.body_targets and self.body_excluded, "body targets and excluded bodies"),
            (self.instantiation_targets and self.instantiation_excluded, "instantiation targets and exclusions"),
            ((self.instantiation_targets or self.instantiation_excluded) and not (self.constants or self.only_constants), "instantiation lists without constants"),
            (self.max_depth < 2, "a depth under 2"),
            (self.pruning_metric not in ("support", "head_coverage"), f"the pruning metric {self.pruning_metric}"),
            (self.bias not in BIASES and self.bias not in _BIASES, f"the unknown bias {self.bias}"),
        ]
        for bad, what in clashes:
            if bad:
                raise ValueError(f"options do not go together: {what}")

    @property
    def with_constants(self) -> bool:
        return self.constants or self.only_constants


_OPERATORS: dict[str, tuple[Callable, str | None]] = {}
_BIASES: dict[str, dict[str, Callable]] = {}


def register_operator(name: str, wants: Callable[["Miner", Rule], list[tuple[str, str, str]]], depends_on: str | None = None) -> None:
    """A further source of atoms: ``wants`` gives (kind, u, v) for a rule, as the built-in ones do; after those of the operator that it depends on."""
    if depends_on is not None and depends_on not in _OPERATORS:
        raise ValueError(f"{name} depends on {depends_on}, which is not registered")
    _OPERATORS[name] = (wants, depends_on)


def register_bias(name: str, **methods: Callable) -> None:
    """A bias by name: ``methods`` (wants, allowed, reportable, passes) take the place of the miner's own, which they get as their first argument."""
    unknown = set(methods) - {"wants", "allowed", "reportable", "passes"}
    if unknown:
        raise ValueError(f"a bias has no {', '.join(sorted(unknown))}")
    _BIASES[name] = methods


@dataclass
class Miner:
    kb: KB
    config: MiningConfig
    seeds: DataFrame | None = None  # (entity): subjects that the seeds bias counts
    schema: KB | None = None
    sizes: dict[str, int] = field(default_factory=dict)
    functional: dict[str, int] = field(default_factory=dict)
    stats: dict[str, dict] = field(default_factory=dict)
    output: list[Rule] = field(default_factory=list)
    known: Joints = field(default_factory=dict)

    def __post_init__(self) -> None:
        for method, own in _BIASES.get(self.config.bias, {}).items():
            setattr(self, method, partial(own, self))

    # the search

    def generations(self) -> Iterator[list[Rule]]:
        """The rules that each generation emits."""
        c, kb = self.config, self.kb
        self.known = joints(kb)
        self.stats = profiles(self.known)
        self.sizes = {p: r["n"] for p, r in self.stats.items()}
        self.functional = {p: 0 if c.bias == "seeds" or c.count_on_subject and c.bias == "one_variable" else r["functional_pos"] for p, r in self.stats.items()}
        now, number, seen = self.initial(), 1, set()
        while now:
            now = [r for r in now if not (r.key in seen or seen.add(r.key))]
            closed = [r for r in now if self.reportable(r)]
            measured = {r.key: r for r in self.measured(closed)}
            emitted = [r for r in measured.values() if self.passes(r)]
            self.output += emitted
            yield emitted
            now = [measured.get(r.key, r) for r in now]
            parents = [r for r in now if not (c.perfect_rules and r.pca_confidence == 1.0)]
            number += 1
            now = [replace(r, generation=number) for r in self.refined(parents)]

    def initial(self) -> list[Rule]:
        c = self.config
        names = [p for p in (c.head_targets or self.sizes) if p in self.sizes]
        if not c.head_targets:
            names = [p for p in names if self.size_for_heads(p) >= c.min_initial_support and p not in c.head_excluded]
        total = sum(self.sizes.values())
        heads = [Rule((("?a", p, "?b"),), support=self.size_for_heads(p), head_size=self.size_for_heads(p), functional=self.functional[p], total=total) for p in sorted(names)]
        if c.bias == "seeds":
            if self.seeds is None:
                raise ValueError("the seeds bias needs seeds")
            counts = {r.p: r.n for r in self.kb.df.join(self.seeds.select(F.col("entity").alias("s")), "s", "left_semi").groupBy("p").agg(F.count_distinct("s").alias("n")).collect()}
            heads = [replace(h, support=counts[h.atoms[0][1]], head_size=counts[h.atoms[0][1]]) for h in heads if counts.get(h.atoms[0][1], 0) >= c.min_initial_support]
        if not c.with_constants and c.bias != "instantiated_head":
            return heads
        bound = self.bound_heads(heads)
        return bound if c.only_constants or c.bias == "instantiated_head" else heads + bound

    def size_for_heads(self, p: str) -> int:
        if self.config.bias == "one_variable":
            return self.stats[p]["ns" if self.functional[p] == 0 else "no"]
        return self.sizes[p]

    def bound_heads(self, heads: Sequence[Rule]) -> list[Rule]:
        """Heads with a constant on the side that is not counted on."""
        c, out = self.config, []
        for position in (0, 2):
            own = {h.atoms[0][1]: h for h in heads if h.functional == position and self.may_instantiate(h.atoms[0][1])}
            if not own:
                continue
            column = "o" if position == 0 else "s"
            least = F.broadcast(self.kb.spark.createDataFrame([(p, self.threshold(h)) for p, h in own.items()], "p string, t long"))
            counts = self.kb.df.join(least, "p").groupBy("p", "t", F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n")).filter("n >= t")
            for r in counts.collect():
                h = own[r.p]
                atom = ("?a", r.p, r.c) if position == 0 else (r.c, r.p, "?a")
                out.append(Rule((atom,), support=r.n, head_size=h.head_size, functional=position, total=h.total, parents=(h,)))
        return sorted(out, key=lambda r: r.atoms)

    def threshold(self, r: Rule) -> int:
        c = self.config
        return c.min_support if c.pruning_metric == "support" else max(1, math.ceil(c.min_head_coverage * r.head_size))

    def may_instantiate(self, p: str) -> bool:
        c = self.config
        return p not in c.instantiation_excluded and (not c.instantiation_targets or p in c.instantiation_targets)

    def length(self, atoms: Query) -> int:
        own = [a for a in atoms if a[1] != NAMES["type"]] if self.config.bias == "typed" else atoms
        return real_length(unfolded(own), self.config.count_special)  # an exists atom counts as the one it is made of

    # refinement

    def wants(self, r: Rule) -> list[tuple[str, str, str]]:
        """(kind, u, v) of the atoms to try: closing on subject u and object v, others on u in the place v."""
        c, atoms = self.config, r.atoms
        n = self.length(atoms)
        if n >= c.max_depth:
            return []
        out: list[tuple[str, str, str]] = []
        openable, open_ = openable_variables(atoms), [v for v in open_variables(atoms) if not v.startswith("?_")]
        closed = not open_ and len(atoms) > 1
        if c.bias == "chain":
            return self.chain_wants(r, n)
        if len(openable) >= 2 and not (len(open_) > 2 and n == c.max_depth - 1 and c.exploit_max_length):
            sources = openable if closed else open_
            targets = openable if closed or len(open_) < 2 else open_
            pairs = {(u, v) for u in sources for v in targets if u != v} | {(v, u) for u in sources for v in targets if u != v}
            out += [("closing", u, v) for u, v in sorted(pairs)]
        joins = openable if closed else open_
        keeps_dangling = n < c.max_depth - 1 and not (c.only_constants and c.strict_constants)
        if keeps_dangling:
            out += [("dangling", v, side) for v in joins for side in "so"]
        if c.with_constants and (c.exploit_max_length or n < c.max_depth - 1 or len(open_) < 2):
            if not (n == c.max_depth - 1 and len(open_) > 1):
                out += [("instantiated", v, side) for v in joins for side in "so"]
        if c.bias == "typed" and len(atoms) == 1:
            out += [("instantiated", v, "s") for v in openable]
        for extra, _ in _OPERATORS.values():
            out += extra(self, r)
        return list(dict.fromkeys(out))

    def chain_wants(self, r: Rule, n: int) -> list[tuple[str, str, str]]:
        """Chains only: on from the last atom's free end, or closed to the head's other variable."""
        c, atoms = self.config, r.atoms
        head = variables([atoms[0]])
        if len(head) == 1:
            end = [v for v in open_variables(atoms)] or head
            out = [("dangling", end[-1], side) for side in "so"] if n < c.max_depth_constants - 1 else []
            if c.with_constants and n < c.max_depth_constants:
                out += [("instantiated", end[-1], side) for side in "so"]
            return out
        if is_closed(atoms):
            return []
        ends = [v for v in open_variables(atoms) if len(atoms) == 1 or v not in head]
        start, goal = (head[0], head[1]) if len(atoms) == 1 else (ends[-1], head[1])
        out = [("closing", start, goal), ("closing", goal, start)]
        if n < c.max_depth - 1:
            out += [("dangling", start, side) for side in "so"]
        return out

    def left_out(self) -> tuple[str, ...]:
        """Relations that no body may have; their atoms are not even counted."""
        c = self.config
        if c.bias == "one_variable":
            return ()
        out = set(c.body_excluded)
        if c.body_targets:
            out |= set(self.sizes) - set(c.body_targets)
        if c.bias == "signatured":
            out |= {NAMES["type"], NAMES["domain"], NAMES["range"]}
        return tuple(sorted(out))

    def allowed(self, r: Rule, atoms: Query, kind: str) -> bool:
        c, new = self.config, atoms[-1]
        p = new[1]
        if new in atoms[:-1]:
            return False
        if c.bias != "one_variable":
            if sum(a[1] == p for a in atoms[:-1]) >= c.recursivity_limit:
                return False
            if p in c.body_excluded or (c.body_targets and p not in c.body_targets):
                return False
        if c.bias == "signatured" and p in (NAMES["type"], NAMES["domain"], NAMES["range"]):
            return False
        if kind == "instantiated" and c.bias == "typed" and len(atoms) == 2 and p == NAMES["type"]:
            return True
        return kind != "instantiated" or (c.with_constants and self.may_instantiate(p) and not redundant(atoms[:-1], new))

    def refined(self, parents: Sequence[Rule]) -> list[Rule]:
        c, counted = self.config, set()
        rules = [(k, r.atoms, self.threshold(r)) for k, r in enumerate(parents) if self.wants(r)]
        if not rules:
            return self.specialised(parents)
        asked = {r.atoms: self.wants(r) for r in parents}
        found = refinements(self.kb, rules, lambda atoms: asked[atoms], self.known, self.left_out(), self.single_supports if c.bias == "one_variable" else None)
        if found is None:
            return self.specialised(parents)
        out = []
        for row in found.collect():
            parent = parents[row.rid]
            atoms = with_atom(parent.atoms, row.kind, row.u, row.v, row.p, row.c)
            if not self.allowed(parent, atoms, row.kind):
                continue
            if c.bias in ("existential", "existential_head"):
                atoms = without_implied(atoms)
            if self.config.adaptive_instantiation and row.kind == "instantiated" and row.support < parent.support / 5:
                continue
            out.append(Rule(atoms, support=row.support, head_size=parent.head_size, functional=parent.functional, total=parent.total, parents=(parent,)))
            if c.bias == "one_variable" and row.kind == "closing" and len(parent.atoms) > 1:
                counted.add(atoms)
        out = sorted(out, key=lambda r: r.atoms)
        out = self.with_inequalities(out) if self.config.with_constants else out
        if self.config.bias in ("existential", "existential_head"):
            out += self.existential(out)
        if self.config.bias == "signatured":
            out = self.signed(out)
        out += self.specialised(parents)
        if self.single:
            out = self.recounted(out, counted)
        return out

    @property
    def single(self) -> bool:
        """Whether supports and bodies count the functional variable alone."""
        return self.config.bias in ("one_variable", "seeds")

    def marked(self, atoms: Query) -> Query:
        """The atoms of a rule as they are counted: under the seeds bias, the head's subject has to be a seed."""
        return (*atoms, (atoms[0][0], SEED, SEED)) if self.config.bias == "seeds" else atoms

    @cached_property
    def counted_kb(self) -> KB:
        if self.config.bias != "seeds":
            return self.kb
        marks = self.seeds.select(F.col("entity").cast("string").alias("s")).distinct().select("s", F.lit(SEED).alias("p"), F.lit(SEED).alias("o"))
        return KB(self.kb.df.unionByName(marks), distinct=False)

    def counted_variable(self, atoms: Query, functional: int) -> str:
        v = atoms[0][functional]
        return v if is_var(v) else variables([atoms[0]])[0]

    def single_supports(self, kb: KB, rules: Sequence[tuple[int, Query]], known: Joints | None = None) -> DataFrame | None:
        """As ``support_counts``, over the counted head variable alone."""
        return single_counts(kb, [(k, atoms, self.counted_variable(atoms, self.functional[atoms[0][1]])) for k, atoms in rules], known)

    def recounted(self, rules: list[Rule], counted: Collection[Query] = ()) -> list[Rule]:
        """Supports over the counted head variable alone: read off what relations have in common where that tells them, all others in one plan.

        Those of the atoms ``counted`` are such supports already.
        """
        counts = {k: r.support for k, r in enumerate(rules) if r.atoms in counted}
        if self.config.bias == "one_variable":
            counts |= {k: n for k, r in enumerate(rules) if (n := counted_single(self.known, r.atoms, r.functional)) is not None}
        todo = [(k, self.marked(r.atoms), self.counted_variable(r.atoms, r.functional)) for k, r in enumerate(rules) if k not in counts]
        if (found := single_counts(self.counted_kb, todo, self.known)) is not None:
            counts |= {row.rid: row.support for row in found.collect()}
        out = [replace(r, support=counts.get(k, 0)) for k, r in enumerate(rules)]
        return [r for r in out if r.support >= self.threshold(r)]

    def with_inequalities(self, rules: list[Rule]) -> list[Rule]:
        """A dangling atom beside one of its relation with a constant: its variable must differ from that constant, and is counted anew."""
        changed = {}
        for k, r in enumerate(rules):
            s, p, o = r.atoms[-1]
            count = occurrences(r.atoms)
            for place, fresh in ((0, s), (2, o)):
                if is_var(fresh) and count[fresh] == 1:
                    same = [a for a in r.atoms[1:-1] if a[1] == p and not is_var(a[place]) and a[2 - place] == r.atoms[-1][2 - place]]
                    if same:
                        changed[k] = (*r.atoms, *((fresh, DIFFERENT, a[place]) for a in same))
        if not changed:
            return rules
        counts = {row.rid: row.support for row in support_counts(self.kb, list(changed.items()), self.known).collect()}
        out = [replace(r, atoms=changed.get(k, r.atoms), support=counts.get(k, 0) if k in changed else r.support) for k, r in enumerate(rules)]
        return [r for r in out if r.support >= self.threshold(r)]

    def existential(self, rules: Sequence[Rule]) -> list[Rule]:
        """Rules whose open atoms are written as ``exists`` atoms, which close them; they are refined further.

        Under ``existential``, an open head is written so, too, and its other variable alone is counted; a rule with an
        atom of which all is open has no such form. ``existential_head`` keeps heads.
        """
        made: dict[Query, Rule] = {}
        for r in rules:
            whole = self.config.bias == "existential"
            open_ = set(open_variables(r.atoms)) - (set() if whole else set(variables([r.atoms[0]])))
            if not open_ or any({s, o} <= open_ for s, _, o in r.atoms):
                continue
            atoms = tuple((p, EXISTS, s) if o in open_ else (p, EXISTS_INV, o) if s in open_ else (s, p, o) for s, p, o in r.atoms)
            if len(set(atoms)) == len(atoms) == len(without_implied(atoms)):  # else it is a shorter rule, which is there already
                made.setdefault(canonical(atoms), replace(r, atoms=atoms, functional=2 if atoms[0] != r.atoms[0] else r.functional))
        out = list(made.values())
        counts = {k: n for k, r in enumerate(out) if (n := self.supported(r.atoms)) is not None}
        todo = [(k, r.atoms) for k, r in enumerate(out) if r.atoms[0][1] in (EXISTS, EXISTS_INV) and k not in counts]
        if (found := support_counts(self.kb, todo, self.known)) is not None:
            counts |= {row.rid: row.support for row in found.collect()}
        return [replace(r, support=counts.get(k, r.support)) for k, r in enumerate(out)]

    def supported(self, atoms: Query) -> int | None:
        """The support of a head ``r exists x`` with one body atom of that kind, which counts of pairs tell; None for others."""
        atoms = unfolded(atoms)
        if len(atoms) != 2 or not all(is_unfolded(a) for a in atoms):
            return None
        (h, x), (p, y) = ((p, "o" if s.startswith(OWN) else "s") for s, p, _ in atoms)
        return self.known.get((h, x, p, y), Joint(0, 0, 0)).shared

    def signed(self, rules: list[Rule]) -> list[Rule]:
        """Closed rules with the declared types of the head's arguments added, counted anew; others as they are."""
        declared = {r.p: (r.domain, r.range) for r in domains_ranges(self.schema or self.kb).collect()}
        out, changed = [], {}
        for r in rules:
            s, p, o = r.atoms[0]
            more = tuple((t, NAMES["type"], k) for t, k in zip((s, o), declared.get(p, (None, None)), strict=True) if k and is_var(t)) if is_closed(r.atoms) else ()
            more = tuple(a for a in more if a not in r.atoms)
            if more:
                changed[len(out)] = (*r.atoms, *more)
            out.append(r)
        if changed:
            counts = {row.rid: row.support for row in support_counts(self.kb, list(changed.items()), self.known).collect()}
            out = [replace(r, atoms=changed.get(k, r.atoms), support=counts.get(k, 0) if k in changed else r.support) for k, r in enumerate(out)]
        return [r for r in out if r.support >= self.threshold(r)]

    def specialised(self, parents: Sequence[Rule]) -> list[Rule]:
        """A last atom ``x rdf:type C`` with C replaced by a direct subclass."""
        if self.schema is None and self.config.bias != "typed":
            return []
        typed = [(k, r) for k, r in enumerate(parents) if len(r.atoms) > 1 and r.atoms[-1][1] == NAMES["type"] and not is_var(r.atoms[-1][2])]
        if not typed:
            return []
        below: dict[str, list[str]] = {}
        for row in subclasses(self.schema or self.kb).collect():
            below.setdefault(row["super"], []).append(row["sub"])
        made = [(r, (*r.atoms[:-1], (r.atoms[-1][0], NAMES["type"], t))) for _, r in typed for t in sorted(below.get(r.atoms[-1][2], []))]
        if not made:
            return []
        counts = {row.rid: row.support for row in support_counts(self.kb, [(k, a) for k, (_, a) in enumerate(made)], self.known).collect()}
        out = [replace(r, atoms=a, support=counts.get(k, 0), parents=(r,), body_size=None, pca_body_size=None) for k, (r, a) in enumerate(made)]
        return [r for r in out if r.support >= self.threshold(r)]

    # what is reported

    def reportable(self, r: Rule) -> bool:
        if len(r.atoms) < 2:
            return False
        if self.config.bias in ("existential", "existential_head"):
            open_ = set(open_variables(r.atoms))
            return not open_ or (self.config.bias == "existential_head" and len(r.atoms) == 2 and open_ <= set(variables([r.atoms[0]])))
        if self.config.only_constants and self.config.strict_constants and not all(any(not is_var(t) for t in (s, o)) for s, _, o in r.atoms):
            return False
        return is_closed(r.atoms) or (self.config.bias == "instantiated_head" and len(r.atoms) == 2)

    def measured(self, rules: Sequence[Rule]) -> list[Rule]:
        """Rules with their confidences, as far as these can pass; what certainly fails goes before its body is counted."""
        c = self.config
        rules = [replace(r, parents=(*r.parents, *self.more_parents(r))) for r in rules]
        if c.bounds:
            rules = upper_bounds(rules, self.stats, self.known)
            rules = [r for r in rules if (r.pca_upper_bound is None or r.pca_upper_bound >= c.min_pca_confidence) and (not c.std or r.std_upper_bound is None or r.std_upper_bound >= c.min_std_confidence)]
        if c.heuristics:
            rules = pca_estimates(rules, self.stats, self.known)
            rules = [r for r in rules if r.pca_estimate is None or r.pca_estimate >= c.min_pca_confidence]
        if c.std:
            sizes = self.denominators(rules, False, c.min_std_confidence)
            rules = [replace(r, body_size=sizes[k]) for k, r in enumerate(rules) if k in sizes]
            rules = [r for r in rules if r.std_confidence >= c.min_std_confidence]
        if c.pca:
            sizes = self.denominators(rules, True, c.min_pca_confidence)
            rules = [replace(r, pca_body_size=sizes[k]) for k, r in enumerate(rules) if k in sizes]
        return rules

    def denominators(self, rules: Sequence[Rule], pca: bool, least: float) -> dict[int, int]:
        """Body sizes by index, without rules whose confidence is certainly under ``least``."""
        told = {k: n for k, r in enumerate(rules) if (n := counted_body(self.known, r.atoms, r.functional, pca)) is not None} if self.config.bias == "one_variable" else {}
        todo = [(k, self.marked(r.atoms), r.functional) for k, r in enumerate(rules) if k not in told]
        if least > 0 and not self.single:
            counted = products(self.kb, [t[:2] for t in todo], self.known)  # as cheap as their bounds
            if (bounds := least_bodies(self.kb, [t for t in todo if t[0] not in counted], pca)) is not None:
                low = {row.rid: row.n for row in bounds.collect()}
                todo = [t for t in todo if rules[t[0]].support >= least * low.get(t[0], 0)]
        found = body_sizes(self.counted_kb, todo, pca, self.single, self.known)
        return told | ({row.rid: row.n for row in found.collect()} if found is not None else {})

    def more_parents(self, r: Rule) -> list[Rule]:
        return [q for q in self.output if 1 < q.generation < r.generation and head_key(q.atoms) == head_key(r.atoms) and q.key not in {p.key for p in r.parents} and subsumes(q.atoms, r.atoms)]

    def passes(self, r: Rule) -> bool:
        c = self.config
        if c.bias == "existential_head":
            best = [a for a in r.ancestors() if a.pca_body_size is not None]
            strictly = all(r.pca_confidence > a.pca_confidence and (not c.std or r.std_confidence > a.std_confidence) for a in best) if r.pca_confidence is not None else True
            if not strictly:
                return False
        if c.std and (r.std_confidence is None or r.std_confidence < c.min_std_confidence):
            return False
        if c.pca and (r.pca_confidence is None or r.pca_confidence < c.min_pca_confidence):
            return False
        return c.skyline == "off" or not any(self.dominated(r, a) for a in r.ancestors())

    def dominated(self, r: Rule, a: Rule) -> bool:
        """Whether a closed ancestor is at least as confident. ``reference`` compares PCA confidences only where std ones were computed, too."""
        if not is_closed(a.atoms):
            return False
        if self.config.pca:
            known = a.pca_confidence is not None and (self.config.skyline == "intended" or a.std_confidence is not None)
            return known and r.pca_confidence <= a.pca_confidence
        return a.std_confidence is not None and r.std_confidence is not None and r.std_confidence <= a.std_confidence


def mine(kb: KB, config: MiningConfig | None = None, on_generation: Callable[[list[Rule]], None] | None = None, **more) -> list[Rule]:
    """All rules that a run emits, generation by generation; ``on_generation`` gets each as it ends."""
    kb.persist()
    try:
        miner = Miner(kb, config or MiningConfig(), **more)
        for rules in miner.generations():
            if on_generation:
                on_generation(rules)
        return [r.named() for r in miner.output]
    finally:
        kb.unpersist()
