"""Rule algebra: equivalence, subsumption, canonical forms, and the properties that mining asks for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations, permutations

from hornspark.functions.terms import DIFFERENT, EXISTS, EXISTS_INV, Atom, Query, is_openable, is_special, is_var, letters, occurrences, rename, variables

TYPE = "rdf:type"


def _match(a: Atom, b: Atom, names: dict[str, str]) -> dict[str, str] | None:
    """``names`` extended so that it turns a into b, one variable to one variable; None where that fails."""
    new = dict(names)
    for s, t in zip(a, b, strict=True):
        if is_var(s) != is_var(t):
            return None
        if not is_var(s):
            if s != t:
                return None
        elif s in new:
            if new[s] != t:
                return None
        elif t in new.values():
            return None
        else:
            new[s] = t
    return new


def embeds(a: Sequence[Atom], b: Sequence[Atom]) -> bool:
    """Whether a renaming takes a's head to b's and each body atom of a to another one of b."""
    names = _match(a[0], b[0], {})
    if names is None:
        return False

    def rest(k: int, free: tuple[int, ...], names: dict[str, str]) -> bool:
        if k == len(a):
            return True
        return any((new := _match(a[k], b[j], names)) is not None and rest(k + 1, tuple(f for f in free if f != j), new) for j in free)

    return rest(1, tuple(range(1, len(b))), names)


def equivalent(a: Sequence[Atom], b: Sequence[Atom]) -> bool:
    """Isomorphic rules: the same head and body but for the names of variables and the order of the body."""
    return len(a) == len(b) and embeds(a, b)


def subsumes(general: Sequence[Atom], special: Sequence[Atom]) -> bool:
    """Whether ``general`` is equivalent to the head and a part of the body of ``special``."""
    if len(general) > len(special):
        return False
    return any(equivalent(general, (special[0], *part)) for part in combinations(special[1:], len(general) - 1))


def canonical(rule: Sequence[Atom]) -> Query:
    """One form for all isomorphic rules: head variables first, and the least order of the body."""
    best: Query | None = None
    for body in permutations(rule[1:]):
        form = rename((rule[0], *body), dict(zip(variables((rule[0], *body)), letters())))
        if best is None or form < best:
            best = form
    return best


def open_variables(rule: Sequence[Atom]) -> list[str]:
    count = occurrences(rule)
    return [v for v in variables(rule) if count[v] == 1]


def openable_variables(rule: Sequence[Atom]) -> list[str]:
    return [v for v in variables(rule) if is_openable(v)]


def is_closed(rule: Sequence[Atom]) -> bool:
    return len(rule) > 1 and not open_variables(rule)


def real_length(rule: Sequence[Atom], count_special: bool = False) -> int:
    """Atoms, without virtual ones unless ``count_special``."""
    return sum(1 for a in rule if count_special or not is_special(a[1]))


def length_without_types(rule: Sequence[Atom]) -> int:
    return sum(1 for a in rule if a[1] != TYPE)


def redundant(rule: Sequence[Atom], atom: Atom) -> bool:
    """Whether ``atom`` is, or is a special case of, another atom of the rule: its free variables may stand for anything."""
    count = occurrences((*rule, atom))

    def covers(a: Atom, b: Atom) -> bool:
        return a[1] == b[1] and all(x == y or (is_var(x) and count[x] == 1) for x, y in ((a[0], b[0]), (a[2], b[2])))

    return any(covers(atom, a) or covers(a, atom) for a in rule if a != atom)


def fresh(rule: Sequence[Atom]) -> str:
    used = set(variables(rule))
    return next(v for v in letters() if v not in used)


def head_key(rule: Sequence[Atom]) -> str:
    s, r, o = rule[0]
    return " ".join([r, *(t for t in (s, o) if not is_var(t))])


def path_between(body: Sequence[Atom], start: str, end: str) -> list[Atom] | None:
    """The atoms as a path from one variable to another that uses each once; None where they are no such path."""
    at, left, path = start, list(body), []
    while left:
        steps = [a for a in left if at in (a[0], a[2]) and a[0] != a[2]]
        if len(steps) != 1:
            return None
        left.remove(steps[0])
        path.append(steps[0])
        at = steps[0][2] if steps[0][0] == at else steps[0][0]
        if not is_var(at):
            return None
    return path if at == end else None


def chain(rule: Sequence[Atom]) -> list[Atom] | None:
    """Body atoms as a path from the head's subject to its object; None where they are no path."""
    return path_between(rule[1:], rule[0][0], rule[0][2])


def join_positions(path: Sequence[Atom]) -> list[tuple[str, str]]:
    """For neighbours of a path, whether they meet in subject (s) or object (o)."""
    out = []
    for a, b in zip(path, path[1:]):
        shared = next(iter({a[0], a[2]} & {b[0], b[2]}), None)
        out.append(("s" if a[0] == shared else "o", "s" if b[0] == shared else "o"))
    return out


@dataclass(frozen=True)
class Rule:
    """A rule with what mining knows of it; metrics that were not computed are None."""

    atoms: Query
    support: int = 0
    head_size: int = 0
    functional: int = 0  # 0: the head's subject is counted on, 2: its object
    generation: int = 1
    body_size: int | None = None
    pca_body_size: int | None = None
    std_upper_bound: float | None = None
    pca_upper_bound: float | None = None
    pca_estimate: float | None = None
    total: int = 0  # what supports are a share of: facts, or the subjects or objects of a run that counts one variable
    parents: tuple["Rule", ...] = field(default=(), compare=False, repr=False)

    @property
    def head_coverage(self) -> float:
        return self.support / self.head_size if self.head_size else 0.0

    @property
    def support_ratio(self) -> float:
        return self.support / self.total if self.total else 0.0

    @property
    def std_confidence(self) -> float | None:
        return None if self.body_size is None else self.support / self.body_size if self.body_size else 0.0

    @property
    def pca_confidence(self) -> float | None:
        return None if self.pca_body_size is None else self.support / self.pca_body_size if self.pca_body_size else 0.0

    @property
    def functional_variable(self) -> str:
        return self.atoms[0][self.functional]

    @property
    def key(self) -> Query:
        return canonical(self.atoms)

    def named(self) -> "Rule":
        return replace(self, atoms=canonical(self.atoms))

    def ancestors(self) -> list["Rule"]:
        out: dict[Query, Rule] = {}
        todo = list(self.parents)
        while todo:
            r = todo.pop()
            if r.key not in out:
                out[r.key] = r
                todo += r.parents
        return list(out.values())


def without_stale_inequalities(rule: Sequence[Atom]) -> Query:
    """Inequalities whose variable occurs nowhere else go."""
    used = set(variables(a for a in rule if a[1] != DIFFERENT))
    return tuple(a for a in rule if a[1] != DIFFERENT or all(not is_var(t) or t in used for t in (a[0], a[2])))


def without_implied(rule: Sequence[Atom]) -> Query:
    """Body atoms ``r exists x`` and ``r existsInv x`` that a body atom of r with x on that side implies go: the rule means the same."""
    held = {(EXISTS, r, s) for s, r, _ in rule[1:]} | {(EXISTS_INV, r, o) for _, r, o in rule[1:]}
    return (rule[0], *(a for a in rule[1:] if (a[1], a[0], a[2]) not in held))
