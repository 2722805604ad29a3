"""Terms, atoms and queries, and their text forms.

A term is a string; variables start with ``?``. An atom is (subject, relation, object) and a query a
tuple of atoms. Variables whose name starts with ``?_`` are closed to extension.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

Atom = tuple[str, str, str]
Query = tuple[Atom, ...]

#: Names of the virtual relations.
DIFFERENT, EQUALS = "differentFrom", "equals"
EXISTS, EXISTS_INV, NOT_EXISTS, NOT_EXISTS_INV = "exists", "existsInv", "~exists", "~existsInv"
TRANSITIVE_TYPE = "transitiveType"
#: How the variables of ``unfolded`` begin; no parsed variable does.
OWN = "?~"
_CARDINALITY = re.compile(r"hasNumberOfValues(Equals|GreaterThan|SmallerThan)(Inv)?(\d+)$")
_VARIABLE = re.compile(r"\?_?[A-Za-z]\w*$")
_DATALOG = re.compile(r"\s*([^\s(),]+)\(\s*([^\s(),]+)\s*,\s*([^\s(),]+)\s*\)")


def is_var(term: str) -> bool:
    return term.startswith("?")


def is_openable(term: str) -> bool:
    return is_var(term) and not term.startswith("?_")


def variables(atoms: Iterable[Atom]) -> list[str]:
    """Variables in order of first use."""
    return list(dict.fromkeys(t for a in atoms for t in a if is_var(t)))


def cardinality(relation: str) -> tuple[str, bool, int] | None:
    """(kind, inverse, n) of a cardinality relation such as ``hasNumberOfValuesEqualsInv3``."""
    m = _CARDINALITY.match(relation)
    return (m[1], bool(m[2]), int(m[3])) if m else None


def is_special(relation: str) -> bool:
    return relation in (DIFFERENT, EQUALS, EXISTS, EXISTS_INV, NOT_EXISTS, NOT_EXISTS_INV, TRANSITIVE_TYPE) or cardinality(relation) is not None


def parse_atom(text: str) -> Atom | None:
    """``s r o`` or ``r(s,o)``; None where it is neither."""
    m = _DATALOG.fullmatch(text.rstrip())
    if m:
        return m[2], m[1], m[3]
    parts = text.split()
    if len(parts) == 3:
        return parts[0], parts[1], parts[2]
    return None


def parse_query(text: str) -> Query:
    """Atoms one after another, with or without commas between them."""
    text = text.strip()
    if not text:
        return ()
    if _DATALOG.match(text):
        return tuple((m[2], m[1], m[3]) for m in _DATALOG.finditer(text))
    parts = [w.strip(",") for w in text.split() if w != ","]
    if len(parts) % 3:
        raise ValueError(f"not a list of atoms: {text!r}")
    return tuple((parts[i], parts[i + 1], parts[i + 2]) for i in range(0, len(parts), 3))


def parse_rule(text: str) -> Query | None:
    """Head and body atoms of ``body => head`` or ``head :- body`` (also ``head <= body``); None for other text."""
    for mark, head_first in (("=>", False), (":-", True), ("<=", True)):
        if mark in text:
            left, right = text.split(mark, 1)
            head, body = (left, right) if head_first else (right, left)
            atoms = parse_query(head)
            return (*atoms, *parse_query(body)) if len(atoms) == 1 else None
    return None


def rename(atoms: Sequence[Atom], names: dict[str, str]) -> Query:
    return tuple((names.get(s, s), names.get(r, r), names.get(o, o)) for s, r, o in atoms)


def letters() -> Iterable[str]:
    n = 0
    while True:
        yield "?" + chr(97 + n % 26) + (str(n // 26) if n >= 26 else "")
        n += 1


def unfolded(atoms: Iterable[Atom]) -> Query:
    """``exists`` and ``existsInv`` atoms of a given relation as facts of it, with a variable that no other atom has."""
    out = []
    for k, (s, r, o) in enumerate(atoms):
        if r in (EXISTS, EXISTS_INV) and not is_var(s):
            out.append((o, s, f"{OWN}{k}") if r == EXISTS else (f"{OWN}{k}", s, o))
        else:
            out.append((s, r, o))
    return tuple(out)


def asked_variables(atom: Atom) -> list[str]:
    """The atom's variables without one that ``unfolded`` made."""
    return [v for v in variables([atom]) if not v.startswith(OWN)]


def is_unfolded(atom: Atom) -> bool:
    return atom[0].startswith(OWN) or atom[2].startswith(OWN)


def normalized(rule: Sequence[Atom]) -> Query:
    """Variables renamed a, b, c ... in order of first use."""
    return rename(rule, dict(zip(variables(rule), letters())))


def occurrences(atoms: Iterable[Atom]) -> Counter[str]:
    """Atoms in which each variable occurs; ``differentFrom`` does not count."""
    return Counter(v for a in atoms if a[1] != DIFFERENT for v in {t for t in a if is_var(t)})


def connected_component(atoms: Sequence[Atom], start: str, removed: str | None = None) -> list[Atom]:
    """Atoms that are reached from a variable without passing through another."""
    todo, seen, kept = [start], {start}, set()
    while todo:
        v = todo.pop()
        for k, a in enumerate(atoms):
            if v in a and removed not in a and k not in kept:
                kept.add(k)
                for t in a:
                    if is_var(t) and t not in seen:
                        seen.add(t)
                        todo.append(t)
    return [atoms[k] for k in sorted(kept)]


def hard_pair(atoms: Sequence[Atom]) -> tuple[int, int] | None:
    """The first two atoms ``r(x, z) r(y, z)`` of one relation that share exactly one argument."""
    for i, a in enumerate(atoms):
        for j in range(i + 1, len(atoms)):
            b = atoms[j]
            if a[1] == b[1] and (a[0] == b[0]) != (a[2] == b[2]):
                return i, j
    return None


def meeting_pair(atoms: Sequence[Atom]) -> tuple[int, int] | None:
    """The first two atoms, of any relations, that share exactly one argument in the same place."""
    for i, a in enumerate(atoms):
        for j in range(i + 1, len(atoms)):
            if (a[0] == atoms[j][0]) != (a[2] == atoms[j][2]):
                return i, j
    return None


def joined_pair(atoms: Sequence[Atom]) -> tuple[int, int, int, int] | None:
    """The first two atoms of two variables each that share exactly one: their places, and where (0 or 2) it stands in each."""
    for i, a in enumerate(atoms):
        for j in range(i + 1, len(atoms)):
            b = atoms[j]
            own = [{t for t in (x[0], x[2]) if is_var(t)} for x in (a, b)]
            shared = own[0] & own[1]
            if len(own[0]) == len(own[1]) == 2 and len(shared) == 1:
                (v,) = shared
                return i, j, 0 if a[0] == v else 2, 0 if b[0] == v else 2
    return None
