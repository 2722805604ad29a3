"""Operator 1: repeated passages across documents, by compact windows.

Tokens are the hashes of 5-word shingles. For each of three hash functions, the Cartesian tree over
the hashed tokens is built only above subtrees of T = 46 tokens (50 words): its nodes are the
minima of all length-T subsequences, and a node's interval groups the subsequences that share it as
their min-hash (a compact window). Interval joins of the windows of two functions inside a
document give runs of starts whose subsequences share both minima. The pair of minima is the signature
that is looked up across documents; all three pairs of functions are joined, so two subsequences meet
where any two of their three minima agree.

Equal subsequences: the runs of the first pair carry a hash of every subsequence (the exact key, 32
bits on top of the signature's 64 and its place in the run). A start whose key a smaller document has
repeats that document's passage; no text is read again for it. A chunk of text matches its own
documents so, and ships only runs with a key that no smaller document of the chunk has, all places of a document with
it; the reducer matches these with the smallest document of all. A chunk's matches are carried on to that document by joining both
(member to chunk's first, chunk's first to smallest), so every exact repeat of 50 words is found and its source is the
smallest doc_id that has it, however the rows are laid out.

Near passages: among the runs with keys that no smaller document has (for the other pairs: with such a hash
of the run's whole extent), each is matched with the first document of its signature and with the
PREVIOUS ones before it. Where exact repeats do not cover a match already, it is verified on the shingles of both texts: a
window of 50 words repeats when it lines up with a window of the other document at a Jaccard
similarity of 0.8 or more; runs of such windows make a span, which begins and ends with words that
both have (so a near repeat may give slightly under 50). Starts that still repeat nothing, in runs with further ones
of smaller documents in their signature, are then tried with all of these (``rest_spans``): the runs' shingles meet by
signature, lined up at their common minimum, and a start is done with the first document that it repeats. So no partner of a
signature is left out. All this depends on documents and ids alone, not on partitions.

Result: one row per repeated span: doc_id, start_word, n_words, source_doc_id (a smaller doc_id that
has the passage, or of merged spans one of theirs). The first document of a passage has no row for it.

Cases: a null doc_id or a null, empty or short text (under 50 words) has no passage. Repeats inside
one document do not count. Repeated rows count once. Of several texts under one doc_id the greatest
counts, and ``remove_spans`` leaves the others as they are. Long texts are processed whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornspark.llm.common import (
    CHUNK_BYTES,
    SHINGLE,
    Hasher,
    Scratch,
    fragments,
    fresh,
    int64,
    matching,
    mixed,
    named,
    planed,
    record_slices,
    small_batches,
    split_by,
    texts,
    trim,
    unplaned,
)

#: Words of the shortest passage, and its shingles.
PASSAGE = 50
#: Pairs of hash functions whose minima make a signature; the first pair's runs have exact keys.
PAIRS = [(0, 1), (1, 2), (0, 2)]
#: Documents before a run's own, in its signature, that a near passage is tried with, besides the first one.
PREVIOUS = 1
#: Similarity as a fraction.
NUM, DEN = 4, 5
#: Starts whose windows are compared as sets at once.
_STARTS = 64

_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
#: A run of starts [i0, i0 + more] of document ``doc`` whose subsequences have signature ``sig``, the place of its first
#: minimum after i0, and how many keys go with it: one a start, or one of the extent. All starts have that minimum, so there are at most T.
_RUN = np.dtype([("sig", "<u8"), ("doc", "<i8"), ("i0", "<u4"), ("more", "u1"), ("c", "u1"), ("keys", "u1"), ("exact", "u1")])
#: Starts [i0, i1] of document ``doc`` that repeat those of ``source``, ``shift`` places on.
_MATCH = np.dtype([("doc", "<i8"), ("source", "<i8"), ("i0", "<i8"), ("i1", "<i8"), ("shift", "<i8")])
#: Kinds of matches: exact, with the smallest document; exact, with the first of a chunk; near. REST: a run of a signature
#: where runs have partners that NEAR does not try; its source is the signature, its shift the place of the minimum, and
#: from bit 8 and 16 on the first and last start to try, from i0 on (none: the last is before the first).
SMALLEST, CHUNK, NEAR, REST = 0, 1, 2, 3
#: Runs that one run is compared with at once: at first, and at most.
_BLOCK, _BLOCKS = 32, 2048
MATCH = "doc_id long, source long, i0 long, i1 long, shift long, kind int"


def window_minima(h: np.ndarray, t: int) -> np.ndarray:
    """For each start i, the least of h[i : i + t]."""
    n = len(h) - t + 1
    blocks = -(-len(h) // t)
    pad = np.full(blocks * t, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(h)] = h
    grid = pad.reshape(blocks, t)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[t - 1 : t - 1 + n])


def compact_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r): the nodes of the Cartesian tree with intervals [l, r] of at least t tokens.

    The low bits of a hash give way to its place, so that the least value says where it is and equal
    tokens count from the left.
    """
    bits = np.uint64(max(1, (len(h) - 1).bit_length()))
    placed = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    least = window_minima(placed, t)
    least = least[np.r_[True, least[1:] != least[:-1]]]  # places only go up
    c = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    left, right, stack = [0] * len(c), [len(h) - 1] * len(c), []
    value, spots = least.tolist(), c.tolist()
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = spots[k] - 1
        if stack:
            left[k] = spots[stack[-1]] + 1
        stack.append(k)
    return np.array(left, np.int64), c, np.array(right, np.int64)


def runs(tokens: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By pair of functions: signatures, first and last starts, and first minima of their joined windows."""
    n, tables = len(tokens) - t + 1, []
    for seed in _SEEDS:
        left, c, _ = compact_windows(mixed(tokens ^ seed), t)
        tables.append((np.maximum(left, c - t + 1), c))  # starts whose subsequence of t tokens lies in the window
    for k, pair in enumerate(PAIRS):
        i0 = np.unique(np.concatenate([tables[f][0] for f in pair]))
        i0 = i0[i0 < n]
        i1 = np.r_[i0[1:] - 1, n - 1]
        ca, cb = (c[np.searchsorted(first, i0, "right") - 1] for first, c in (tables[f] for f in pair))
        with np.errstate(over="ignore"):
            sig = mixed(tokens[ca] + tokens[cb] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        yield sig, i0, i1, ca


class Stretches:
    """32-bit hashes of tokens[start : stop], for arrays of starts and stops."""

    def __init__(self, tokens: np.ndarray, hasher: Hasher):
        n = len(tokens)
        if n > hasher.n:
            hasher.grow(1 << (n - 1).bit_length())
        self.down = hasher.down
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * hasher.up[:n], dtype=np.uint64, out=self.total[1:])

    def keys(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed((self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(np.uint64)) >> np.uint64(32)).astype("<u4")


def keyed(e: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, run, start) of each key: told apart by signature and by place next to the first minimum, its run, and the start it is of."""
    n = e["keys"].astype(np.int64)
    run = np.repeat(np.arange(len(e)), n)
    at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        value = mixed(e["sig"][run] + (keys.astype(np.uint64) << np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) + (at - e["c"][run] + 128).astype(np.uint64))
    return value, run, e["i0"][run].astype(np.int64) + at


def _chosen(e: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` (places) with their keys."""
    n = e["keys"].astype(np.int64)
    own = n[at]
    return e[at], keys[np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(own) - own), own) + np.arange(own.sum())]


def _by_place(e: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _chosen(e, keys, np.lexsort((e["i0"], e["doc"], e["sig"])))


def exact(e: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs by (sig, doc, i0): which have a key that no smaller document has, and matches of starts whose key a smaller document has (as _MATCH rows of one start, and their runs)."""
    value, run, start = keyed(e, keys)
    order = np.argsort(value, kind="stable")
    opens = np.r_[True, value[order][1:] != value[order][:-1]][: len(order)]
    head = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    new = np.zeros(len(e), bool)
    doc = e["doc"][run]
    own = doc[order] == doc[head]  # a document's further places of a key may repeat what others have, as its first one
    new[run[order[own]]] = True
    again = np.flatnonzero(~own & (e["exact"][run[order]] > 0))
    y, x = order[again], head[again]
    m = np.empty(len(y), _MATCH)
    m["doc"], m["source"], m["i0"], m["i1"], m["shift"] = doc[y], doc[x], start[y], start[y], start[x] - start[y]
    return new, m, run[y]


def near(e: np.ndarray) -> np.ndarray:
    """Of runs by (sig, doc, i0): matches with the first document of the signature and with PREVIOUS ones."""
    if not len(e):
        return np.empty(0, _MATCH)
    opens = np.r_[True, e["sig"][1:] != e["sig"][:-1]]
    head = np.maximum.accumulate(np.where(opens, np.arange(len(e)), 0))
    fresh_ = opens | np.r_[True, e["doc"][1:] != e["doc"][:-1]]
    own = np.maximum.accumulate(np.where(fresh_, np.arange(len(e)), 0))
    member = np.flatnonzero(own != head)
    pairs, before = [np.c_[member, head[member]]], member
    for _ in range(PREVIOUS):
        before = own[before] - 1  # the last run of the document before
        far = before >= head[member]
        member, before = member[far], before[far]
        pairs.append(np.c_[member, before])
        on = own[before] != head[before]
        member, before = member[on], before[on]
    at = np.unique(np.concatenate(pairs), axis=0)
    y, x = e[at[:, 0]], e[at[:, 1]]
    m = np.empty(len(y), _MATCH)
    m["doc"], m["source"], m["i0"], m["i1"] = y["doc"], x["doc"], y["i0"], y["i0"].astype(np.int64) + y["more"]
    m["shift"] = (x["i0"].astype(np.int64) + x["c"]) - (y["i0"].astype(np.int64) + y["c"])
    return m


def rest(e: np.ndarray) -> np.ndarray:
    """Of runs by (sig, doc, i0): those of signatures where ``near`` leaves a run of a smaller document out, as REST rows."""
    if not len(e):
        return np.empty(0, _MATCH)
    at = np.arange(len(e))
    opens = np.r_[True, e["sig"][1:] != e["sig"][:-1]]
    own = np.maximum.accumulate(np.where(opens | np.r_[True, e["doc"][1:] != e["doc"][:-1]], at, 0))
    asks = own - np.maximum.accumulate(np.where(opens, at, 0)) > 1 + PREVIOUS
    group = np.cumsum(opens) - 1
    some = np.flatnonzero((np.bincount(group, asks) > 0)[group])
    e, asks = e[some], asks[some]
    m = np.empty(len(e), _MATCH)
    m["doc"], m["source"], m["i0"], m["i1"] = e["doc"], e["sig"].view(np.int64), e["i0"], e["i0"].astype(np.int64) + e["more"]
    more = e["more"].astype(np.int64)
    m["shift"] = e["c"] | np.where(asks, more << 16, 1 << 8)
    return m


def joined(m: np.ndarray) -> np.ndarray:
    """_MATCH rows, where runs of one document, source and shift that touch or overlap are one."""
    if not len(m):
        return m
    m = m[np.lexsort((m["i1"], m["i0"], m["shift"], m["source"], m["doc"]))]
    group = np.cumsum(np.r_[True, (m["doc"][1:] != m["doc"][:-1]) | (m["source"][1:] != m["source"][:-1]) | (m["shift"][1:] != m["shift"][:-1])])
    base = group * (1 << 33)  # ends grow from group to group
    end = np.maximum.accumulate(m["i1"] + base)
    first = np.flatnonzero(np.r_[True, (m["i0"] + base)[1:] > end[:-1] + 1])
    out = m[first]
    out["i1"] = (end - base)[np.r_[first[1:], len(m)] - 1]
    return out


def _parcels(key: np.ndarray, rows: np.ndarray, sub: int, keys: dict[int, np.ndarray] | None = None) -> list[tuple[int, int, bytes, bytes]]:
    return [(k, sub, planed(s), keys[k].tobytes() if keys else b"") for k, s in record_slices(key, rows)]


def _windows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, held_bytes, t = Hasher(), [], 0, PASSAGE - SHINGLE + 1

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            e, keys = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            e, keys = _by_place(e, keys)
            new, found, of = exact(e, keys)
            sub = 1 + (int(e["doc"][0]) & 1023)
            e, keys = _chosen(e, keys, np.flatnonzero(new))
            part = (e["sig"] >> np.uint64(40)).astype(np.int64) & (parts - 1)
            out = _parcels(part, e, 0, dict(record_slices(np.repeat(part, e["keys"]), keys)))
            found = joined(found[~new[of]])  # what the chunk alone knows
            out += _parcels(found["doc"] & (parts - 1), found, sub)
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(types)], ["part", "sub", "runs", "keys"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, texts(batch), strict=True):
                if doc is None or not text:
                    continue
                tokens = hasher.shingles(text)
                if len(tokens) < t:
                    continue
                start, stretches = np.arange(len(tokens) - t + 1), Stretches(tokens, hasher)
                for k, (sig, i0, i1, c) in enumerate(runs(tokens, t)):
                    e = np.empty(len(sig), _RUN)
                    e["sig"], e["doc"], e["i0"], e["more"], e["c"], e["exact"] = sig, doc, i0, i1 - i0, c - i0, k == 0
                    e["keys"] = 1 if k else i1 - i0 + 1
                    keys = stretches.keys(i0, i1 + t) if k else stretches.keys(start, start + t)
                    held.append((e, keys))
                    held_bytes += e.nbytes + 2 * keys.nbytes
            if held_bytes > CHUNK_BYTES:
                yield from flush()
                held_bytes = 0
                trim()
        yield from flush()
        trim()

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """Matches of one parcel: sub 0 holds the runs of all chunks, others what a chunk matched itself."""
    blobs = [x.as_buffer() for x in table.column("runs")]
    if table.column("sub")[0].as_py():
        kinds = [(CHUNK, np.concatenate([unplaned(x, _MATCH) for x in blobs]))]
    else:
        e = np.concatenate([unplaned(x, _RUN) for x in blobs])
        e, keys = _by_place(e, np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")]))
        first = np.flatnonzero(np.r_[True, e["sig"][1:] != e["sig"][:-1]][: len(e)])
        size = np.diff(np.r_[first, len(e)])
        e, keys = _chosen(e, keys, np.flatnonzero(np.repeat(size > 1, size)))
        new, found, _ = exact(e, keys)
        e = e[new]
        kinds = [(SMALLEST, joined(found)), (NEAR, joined(near(e))), (REST, rest(e))]
    columns = {to: int64(np.concatenate([m[of] for _, m in kinds])) for to, of in (("doc_id", "doc"), ("source", "source"), ("i0", "i0"), ("i1", "i1"), ("shift", "shift"))}
    return pa.table(columns | {"kind": pa.array(np.concatenate([np.full(len(m), k, np.int32) for k, m in kinds]))})


def _open(i0: np.ndarray, i1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of [i0, i1], the first and last starts that no [c0, c1] has; where all are had, the last is before the first."""
    if not len(i0) or not len(c0):
        return i0, i1
    top = int(max(i1.max(), c1.max())) + 2
    steps = np.zeros(top + 1, np.int64)
    np.add.at(steps, c0, 1)
    np.add.at(steps, c1 + 1, -1)
    open_ = np.flatnonzero(np.cumsum(steps)[:top] == 0)  # top - 1 is always there
    after, before = np.searchsorted(open_, i0), np.searchsorted(open_, i1, "right") - 1
    return open_[after], np.where(after <= before, open_[before], open_[after] - 1)


def uncovered(m: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """The matches with the starts from the first to the last that ``cover`` (rows of the same document) lacks."""
    lo, hi = _open(m["i0"], m["i1"], cover["i0"], cover["i1"])
    left = lo <= hi
    out = m[left]
    out["i0"], out["i1"] = lo[left], hi[left]
    return out


def _asking(m: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """REST rows of one document with the starts to try that no [c0, c1] has."""
    m = m.copy()
    lo, hi = m["i0"] + (m["shift"] >> 8 & 255), m["i0"] + (m["shift"] >> 16)
    asks = np.flatnonzero(lo <= hi)
    lo, hi = (x - m["i0"][asks] for x in _open(lo[asks], hi[asks], c0, c1))
    m["shift"][asks] = m["shift"][asks] & 255 | np.where(lo <= hi, lo << 8 | hi << 16, 1 << 8)
    return m


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, kind, m): a document's distinct matches. Those with smallest documents, and REST, are one row without a source, others a row for each.

    Near matches stay where exact ones leave something. A list is bounded by its document's length.
    """
    for batch in batches:
        ids, sources, kinds, lists = [], [], [], []
        for k, doc in enumerate(batch.column(0).to_pylist()):
            m = batch.column(1)[k].values
            rows = np.empty(len(m), _MATCH)
            rows["doc"] = doc
            for f, name in enumerate(("source", "i0", "i1", "shift")):
                rows[name] = m.field(f).to_numpy(zero_copy_only=False)
            of = m.field(4).to_numpy(zero_copy_only=False)
            smallest = joined(rows[of == SMALLEST])
            found = [(None, SMALLEST, smallest[np.argsort(smallest["i0"], kind="stable")])] if len(smallest) else []
            equal = rows[of < NEAR]
            if (of == REST).any():
                found.append((None, REST, _asking(rows[of == REST], equal["i0"], equal["i1"])))
            for which, own in ((CHUNK, rows[of == CHUNK]), (NEAR, uncovered(rows[of == NEAR], equal))):
                own = joined(own)
                found += [(s, which, part) for s, part in record_slices(own["source"], own)]
            for s, which, part in found:
                ids.append(doc)
                sources.append(s)
                kinds.append(which)
                lists.append(part)
        all_ = np.concatenate(lists or [np.empty(0, _MATCH)])
        values = pa.StructArray.from_arrays([int64(all_[n]) for n in ("source", "i0", "i1", "shift")], ["source", "i0", "i1", "shift"])
        m = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), values)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.int64()), pa.array(kinds, pa.int32()), m], ["doc_id", "source", "kind", "m"])


def _columns(m) -> list[np.ndarray]:
    """Source, i0, i1 and shift of a list of matches."""
    return [m.values.field(f).to_numpy(zero_copy_only=False) for f in range(4)]


def _stretched(doc: int, source: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> np.ndarray:
    """(doc_id, source, a, b) rows: the words of matches, one span where they overlap or touch, named by the smallest source."""
    order = np.argsort(i0, kind="stable")
    source, i0, i1 = source[order], i0[order], i1[order]
    end = np.maximum.accumulate(i1 + PASSAGE)
    first = np.flatnonzero(np.r_[True, i0[1:] > end[:-1]])
    return np.c_[np.full(len(first), doc), np.minimum.reduceat(source, first), i0[first], end[np.r_[first[1:], len(i0)] - 1]]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, a, b): the words of matches with smallest documents."""
    for batch in batches:
        yield _span_rows([_stretched(doc, *_columns(batch.column(1)[k])[:3]) for k, doc in enumerate(batch.column(0).to_pylist())])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, a, b): the words of matches within a chunk, whose first document's own matches say who is smallest."""
    for batch in batches:
        rows = []
        for k, (doc, via) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            _, i0, i1, shift = _columns(batch.column(2)[k])
            least = np.full(int((i1 + shift).max()) + 1, via)
            if batch.column(3)[k].is_valid:
                for s, a, b, _ in zip(*(c.tolist() for c in _columns(batch.column(3)[k])), strict=True):
                    least[a : b + 1] = np.minimum(least[a : b + 1], s)
            source = np.array([least[a + d : b + d + 1].min() for a, b, d in zip(i0.tolist(), i1.tolist(), shift.tolist(), strict=True)], np.int64)
            rows.append(_stretched(doc, source, i0, i1))
        yield _span_rows(rows)


def _span_rows(rows: list[np.ndarray]) -> pa.RecordBatch:
    all_ = np.concatenate(rows or [np.empty((0, 4), np.int64)])
    return pa.RecordBatch.from_arrays([int64(all_[:, i]) for i in range(4)], ["doc_id", "source", "a", "b"])


def _present(v: np.ndarray, kinds: int, n: int, t: int) -> np.ndarray:
    """For starts 0..n-1, which of the values below ``kinds`` lie in v[start : start + t]."""
    p = np.arange(len(v))
    steps = np.zeros((n + 1, kinds), np.int16)
    np.add.at(steps, (np.maximum(p - t + 1, 0), v), 1)
    np.add.at(steps, (np.minimum(p, n - 1) + 1, v), -1)
    return np.cumsum(steps[:n], axis=0, dtype=np.int16) > 0


def similar_sets(y: np.ndarray, x: np.ndarray, t: int) -> np.ndarray:
    """For each start i, whether the sets of y[i : i + t] and x[i : i + t] (equally long) have the Jaccard similarity."""
    n = len(y) - t + 1
    out = np.zeros(n, bool)
    for lo in range(0, n, _STARTS):
        hi = min(lo + _STARTS, n)
        a, b = y[lo : hi + t - 1], x[lo : hi + t - 1]
        values, v = np.unique(np.r_[a, b], return_inverse=True)
        if (2 * len(a) - len(values)) * (DEN + NUM) < 2 * t * NUM and len(np.unique(a)) == len(a) and len(np.unique(b)) == len(b):
            continue  # all windows together share too little, and none is less than t values
        in_a, in_b = _present(v[: len(a)], len(values), hi - lo, t), _present(v[len(a) :], len(values), hi - lo, t)
        out[lo:hi] = (in_a & in_b).sum(axis=1) * DEN >= (in_a | in_b).sum(axis=1) * NUM
    return out


def repeated_starts(y: np.ndarray, x: np.ndarray, i0: np.ndarray, i1: np.ndarray, shift: np.ndarray, t: int) -> np.ndarray:
    """Which starts of y, in the matched runs, repeat a passage of x."""
    ok = np.zeros(max(0, len(y) - t + 1), bool)
    for d in np.unique(shift):
        mine = shift == d
        lo, hi = max(0, -d, i0[mine].min()), min(len(y), len(x) - d, i1[mine].max() + t)  # where y and x line up in the runs
        if hi - lo < t:
            continue
        same = np.r_[0, np.cumsum(y[lo:hi] == x[lo + d : hi + d])]
        equal = same[t:] - same[:-t]
        close = equal * DEN >= (2 * t - equal) * NUM
        for a, b in zip(i0[mine], i1[mine], strict=True):
            a, b = max(a, lo), min(b, hi - t)
            if a > b:
                continue
            ok[a : b + 1] |= close[a - lo : b - lo + 1]
            at = np.flatnonzero(~ok[a : b + 1])
            if len(at):  # words put in or left out: compare as sets
                a, b = a + at[0], a + at[-1]
                ok[a : b + 1] |= similar_sets(y[a : b + t], x[a + d : b + d + t], t)
    return ok


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, a, b, i0, i1): words and starts of near matches that hold."""
    hasher, t = Hasher(), PASSAGE - SHINGLE + 1
    last: tuple = (None, None, None)
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        rows = []
        for k in range(batch.num_rows):
            source = col["source"][k].as_py()
            if last[0] != source:
                x = hasher.shingles(col["tx"][k].as_py())
                last = (source, x, np.sort(x))
            y = hasher.shingles(col["ty"][k].as_py())
            _, i0, i1, shift = _columns(col["m"][k])
            i1 = np.minimum(i1, len(y) - t)
            at = np.flatnonzero(repeated_starts(y, last[1], i0, i1, shift, t))
            if len(at):
                gap = np.flatnonzero(np.diff(at) > 1)
                for a, b in zip(np.r_[at[0], at[gap + 1]], np.r_[at[gap], at[-1]], strict=True):
                    part = y[a : b + t]
                    place = np.minimum(np.searchsorted(last[2], part), len(last[2]) - 1)
                    inside = a + np.flatnonzero(last[2][place] == part)  # the span ends where shared shingles do
                    rows.append((col["doc_id"][k].as_py(), source, int(inside[0]), int(inside[-1]) + SHINGLE, int(a), int(b)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["doc_id", "source", "a", "b", "i0", "i1"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUN rows of REST matches (m), without the starts that near matches (done) have."""
    for batch in batches:
        out = []
        for k, doc in enumerate(batch.column(0).to_pylist()):
            own = batch.column(1)[k]
            m = np.empty(len(own.values), _MATCH)
            m["doc"] = doc
            for name, values in zip(("source", "i0", "i1", "shift"), _columns(own), strict=True):
                m[name] = values
            done = batch.column(2)[k]
            c = [done.values.field(f).to_numpy(zero_copy_only=False) for f in (0, 1)] if done.is_valid else [np.empty(0, np.int64)] * 2
            out.append(_asking(m, *c))
        m = np.concatenate(out or [np.empty(0, _MATCH)])
        columns = {"doc_id": m["doc"], "sig": m["source"], "i0": m["i0"], "more": m["i1"] - m["i0"], "c": m["shift"] & 255, "lo": m["shift"] >> 8 & 255, "hi": m["shift"] >> 16}
        yield pa.RecordBatch.from_arrays([int64(x) for x in columns.values()], list(columns))


def _shingled(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """RUN rows with the shingles that their starts' windows have."""
        hasher, t = Hasher(), PASSAGE - SHINGLE + 1
        for batch in batches:
            rows, blobs = [], []
            for doc, text, runs_ in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "text", "runs")), strict=True):
                tokens = hasher.shingles(text.as_py())
                own = np.stack([runs_.values.field(f).to_numpy(zero_copy_only=False) for f in range(6)], axis=1)
                rows.append(np.c_[np.full(len(own), doc.as_py()), own])
                blobs += [tokens[i0 : i0 + more + t].tobytes() for i0, more in own[:, 1:3].tolist()]
            all_ = np.concatenate(rows or [np.empty((0, 7), np.int64)])
            part = (all_[:, 1].astype(np.uint64) >> np.uint64(40)).astype(np.int64) & (parts - 1)
            names = ["part", "doc_id", "sig", "i0", "more", "c", "lo", "hi"]
            yield pa.RecordBatch.from_arrays([int64(part), *(int64(all_[:, i]) for i in range(7)), pa.array(blobs, pa.binary())], [*names, "tokens"])

    return run


def _tried(table: pa.Table) -> pa.Table:
    """SPAN rows: starts that runs ask for and that a smaller document of the signature has."""
    col = {n: table.column(n).to_numpy() for n in ("doc_id", "sig", "i0", "more", "c", "lo", "hi")}
    order = np.lexsort((col["i0"], col["doc_id"], col["sig"]))
    col = {n: x[order] for n, x in col.items()}
    blobs, out = table.column("tokens"), []
    edges = np.flatnonzero(np.r_[True, np.diff(col["sig"]) != 0, True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = {n: x[a:b] for n, x in col.items()}
        out += repeats_in_signature(own, [np.frombuffer(blobs[int(k)].as_buffer(), np.uint64) for k in order[a:b]])
    return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("doc_id", "source", "a", "b"))})


def repeats_in_signature(col: dict[str, np.ndarray], tokens: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(doc, source, a, b) words of starts asked for (lo to hi from i0 on) that repeat those of smaller documents, which are tried one by one until one does.

    Runs by document, with the shingles of their starts. All windows have the signature's minimum, so in a
    table with it in one column they line up by columns. A window is compared, as a set, with those that have one of its
    rarest shingles: as many as it may lack, and one more.
    """
    t, doc, n = PASSAGE - SHINGLE + 1, col["doc_id"], len(tokens)
    length, left = np.array([len(x) for x in tokens]), t - 1 - col["c"]  # a run's shingles and its first column
    values, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    run = np.repeat(np.arange(n), length)
    column = left[run] + np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
    grid, last = np.full((n, 2 * t - 1), len(values), np.int32), np.full((n, 2 * t - 1), -1, np.int8)  # the last value: nothing
    grid[run, column] = ids
    order = np.lexsort((column, ids, run))
    again = np.flatnonzero((run[order][1:] == run[order][:-1]) & (ids[order][1:] == ids[order][:-1]))
    last[run[order[again + 1]], column[order[again + 1]]] = column[order[again]]  # where a run has the value before
    sizes = np.stack([(last[:, s : s + t] < s).sum(axis=1) for s in range(t)], axis=1)  # of the windows, as sets
    before, start = np.searchsorted(doc, doc), np.arange(t)
    has = (start >= left[:, None]) & (start <= left[:, None] + col["more"][:, None])
    fewest = np.where(has, sizes, t).min(axis=0)
    least = np.maximum(-(-(sizes + fewest) * NUM // (DEN + NUM)), -(-sizes * NUM // DEN))  # what a window shares with one that is similar
    once = np.delete(order, again + 1)
    once = once[np.lexsort((run[once], ids[once]))]
    holds, at = run[once], np.searchsorted(ids[once], np.arange(len(values) + 1))  # a value's runs
    at = np.r_[at, len(once)]
    count = np.diff(at)
    early = np.r_[holds[at[:-2]], n]  # its first one
    most = np.cumsum(np.pad(early[grid] < before[:, None], ((0, 0), (1, 0))), axis=1, dtype=np.int16)
    first = left + col["lo"]
    asks = has & (start >= first[:, None]) & (start <= (left + col["hi"])[:, None]) & (most[:, t:] - most[:, :t] >= least)
    met, out = np.zeros(len(values) + 1, bool), []
    for y in np.flatnonzero(asks.any(axis=1)):
        start = np.flatnonzero(asks[y])
        cells = start[:, None] + np.arange(t)
        rank = np.argsort(np.where(last[y][cells] < start[:, None], count[grid[y][cells]], n + 1), axis=1)  # the rarest first, each once
        few = np.arange(t) <= (sizes[y, start] - least[y, start])[:, None]
        wanted = np.unique(grid[y][np.take_along_axis(cells, rank, 1)[few]])
        some = np.zeros(before[y] + 1, bool)
        for v in wanted.tolist():
            some[np.minimum(holds[at[v] : at[v + 1]], before[y])] = True
        some = np.flatnonzero(some[:-1])
        done, step = 0, _BLOCK
        while len(start) and done < len(some):
            rows = some[done : done + step]
            source = np.full(len(start), -1)
            for j, s in enumerate(start.tolist()):
                own = rows[has[rows, s]]
                met[grid[y, s : s + t]] = True
                both = (met[grid[own, s : s + t]] & (last[own, s : s + t] < s)).sum(axis=1)
                met[grid[y, s : s + t]] = False
                ok = np.flatnonzero(both * DEN >= (sizes[y, s] + sizes[own, s] - both) * NUM)
                if len(ok):
                    source[j] = own[ok[0]]
            for k in np.unique(source[source >= 0]):
                good, theirs = start[source == k], grid[k, left[k] : left[k] + length[k]]
                for g in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
                    inside = col["i0"][y] - left[y] + g[0] + np.flatnonzero(np.isin(grid[y, g[0] : g[-1] + t], theirs))
                    out.append((int(doc[y]), int(doc[k]), int(inside[0]), int(inside[-1]) + SHINGLE))
            start = start[source < 0]
            done, step = done + len(rows), min(step * 2, _BLOCKS)
    return out


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans (doc_id, source, a, b) become one; the smallest source names it."""
    order = Window.partitionBy("doc_id").orderBy("a", "b", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("a") > F.max("b").over(before)).cast("int"), F.lit(1))
    numbered = spans.withColumn("opens", opens).withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "span").agg(F.min("a").alias("start_word"), (F.max("b") - F.min("a")).alias("n_words"), F.min("source").alias("source_doc_id")).drop("span")


SPAN = "doc_id long, source long, a long, b long"
LIST = "array<struct<source: long, i0: long, i1: long, shift: long>>"
#: A run in a signature, its minimum's place, and from i0 on the starts to try, lo to hi (none: hi before lo).
RUN = "doc_id long, sig long, i0 long, more long, c long, lo long, hi long"


def exact_spans(matches: DataFrame) -> DataFrame:
    """(doc_id, source, a, b): the spans of exact matches, those of a chunk carried on to the smallest document that has them."""
    own = matches.filter(F.col("kind") == SMALLEST).select("doc_id", "m")
    first = own.select(F.col("doc_id").alias("source"), F.col("m").alias("s"))
    met = matches.filter(F.col("kind") == CHUNK).select("doc_id", "source", "m").join(first, "source", "left")
    return own.mapInArrow(_spans, SPAN).unionByName(met.select("doc_id", "source", "m", "s").mapInArrow(_carried, SPAN))


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, source_doc_id: the spans that an earlier document has too."""
    small_batches(spark)
    scratch = Scratch(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    twice = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.limit(1).count():
        some, others = split_by(docs, twice, "doc_id")
        docs = scratch.keep(others.unionByName(some.groupBy("doc_id").agg(F.max("text").alias("text"))))
    parcels = docs.mapInArrow(_windows(fragments(spark, docs)), "part int, sub int, runs binary, keys binary")
    found = parcels.groupBy("part", "sub").applyInArrow(_grouped, MATCH)
    gathered = found.groupBy("doc_id").agg(F.collect_list(F.struct("source", "i0", "i1", "shift", "kind")).alias("m"))
    matches = scratch.keep(gathered.mapInArrow(_by_document, f"doc_id long, source long, kind int, m {LIST}"))
    pairs = matches.filter(F.col("kind") == NEAR).select("doc_id", "source", "m")
    sides = pairs.select("doc_id", F.lit(1).alias("is_y"), F.lit(0).alias("is_x")).union(pairs.select("source", F.lit(0), F.lit(1)))
    ids = scratch.keep(sides.groupBy("doc_id").agg(F.max("is_y").alias("is_y"), F.max("is_x").alias("is_x")))
    held = scratch.keep(matching(docs, ids, "doc_id").select("doc_id", "text", "is_y", "is_x"))
    ty = held.filter("is_y = 1").select("doc_id", F.col("text").alias("ty"))
    tx = held.filter("is_x = 1").select(F.col("doc_id").alias("source"), F.col("text").alias("tx"))
    both = pairs.hint("merge").join(ty, "doc_id").hint("merge").join(tx, "source").select("doc_id", "source", "m", "ty", "tx")
    close = scratch.keep(both.mapInArrow(_verify, f"{SPAN}, i0 long, i1 long"))
    spans = close.drop("i0", "i1").unionByName(exact_spans(matches))
    more = rest_spans(scratch, docs, matches.filter(F.col("kind") == REST).select("doc_id", "m"), close)
    return scratch.finish(merged(spans if more is None else spans.unionByName(more)))


def rest_spans(scratch: Scratch, docs: DataFrame, runs_: DataFrame, close: DataFrame) -> DataFrame | None:
    """(doc_id, source, a, b): what the starts of REST runs that neither exact nor near matches (close) have repeat."""
    done = close.groupBy("doc_id").agg(F.collect_list(F.struct("i0", "i1")).alias("done"))
    asked = scratch.keep(runs_.hint("merge").join(done.hint("merge"), "doc_id", "left").select("doc_id", "m", "done").mapInArrow(_asked, RUN))
    asking = asked.filter("lo <= hi")
    if not asking.limit(1).count():
        return None
    last = asking.groupBy("sig").agg(F.max("doc_id").alias("last"))
    met = asked.hint("merge").join(last.hint("merge"), "sig").filter("doc_id <= last")
    kept = scratch.keep(met.groupBy("doc_id").agg(F.collect_list(F.struct("sig", "i0", "more", "c", "lo", "hi")).alias("runs")))
    runs_ = matching(docs, kept, "doc_id").select("doc_id", "text", "runs").mapInArrow(_shingled(fragments(scratch.spark, docs)), f"part long, {RUN}, tokens binary")
    return scratch.keep(runs_.groupBy("part").applyInArrow(_tried, SPAN))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans``; documents left without a word go, all others keep their columns.

    Lines and spacing between kept words stay as they are. n_chars, where there is one, follows. Of several texts
    under one doc_id the greatest is cut, as it is the one that spans are of.
    """
    names = docs.columns
    own, mark = fresh(names, "_doc", "_cut")
    cut = spans.groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias(mark))
    some, others = split_by(docs, spans.select("doc_id"), "doc_id")
    marked = some.join(cut.hint("merge"), F.col("doc_id") == F.col(own), "left")
    if some.groupBy("doc_id").count().filter("doc_id is not null and count > 1").limit(1).count():
        greatest = fresh([*names, own, mark], "_text")[0]
        most = some.groupBy(F.col("doc_id").alias(own)).agg(F.max("text").alias(greatest))
        marked = marked.drop(own).join(most.hint("merge"), F.col("doc_id") == F.col(own), "left").withColumn(mark, F.when(F.col("text") == F.col(greatest), F.col(mark)))
    marked = marked.select(*named(names), mark)
    return others.unionByName(marked.mapInArrow(_strip(names, mark), docs.schema))


def _strip(names: list[str], mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            cuts, out, keep = batch.column(batch.schema.get_field_index(mark)).to_pylist(), [], []
            for k, text in enumerate(texts(batch)):
                if cuts[k] is None or text is None:
                    keep.append(k)
                    out.append(text)
                    continue
                ends = [m.span() for m in word.finditer(text)]
                pieces, at = [], 0
                for c in cuts[k]:
                    a, b = c["start_word"], min(c["start_word"] + c["n_words"], len(ends))
                    if a < b:
                        pieces.append(text[at : ends[a][0]])
                        at = ends[b][0] if b < len(ends) else len(text)
                pieces.append(text[at:])
                left = "".join(pieces).strip()
                if word.search(left):
                    keep.append(k)
                    out.append(left)
            rest = batch.take(pa.array(keep, pa.int64()))
            cols = []
            for name in names:
                i = rest.schema.get_field_index(name)
                col = rest.column(i)
                if name == "text":
                    col = pa.array(out, rest.schema.field(i).type)
                elif name == "n_chars":
                    old = col.to_pylist()
                    col = pa.array([old[j] if cuts[k] is None or x is None else len(x) for j, (k, x) in enumerate(zip(keep, out, strict=True))], rest.schema.field(i).type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names)

    return run
