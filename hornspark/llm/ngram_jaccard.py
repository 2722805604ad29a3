"""Operator 5: n-gram Jaccard self-join by vertical partitioning of the global n-gram order.

A document is the set of its 5-word shingles (64-bit hashes; two different shingles meet in one
hash with probability 2^-64). Two documents link when 100 * |intersection| >= 80 * |union|.

1. Equal sets are one class. One pass gives each row its class and counts, per chunk of text, the
   shingles that several classes of the chunk hold. The counts add up in a sketch of fixed size, whose
   estimate (as a power of two) is a shingle's rank: the global order is by rank, then by hash. Any
   order is exact; this one keeps common passages out of prefixes, at every size of the corpus.
2. A class posts only its prefix, the first n - ceil(0.8 n) + 1 shingles of the order: linked
   classes share one of them. Chunks group their own postings first and ship one entry a shingle,
   so no shingle fills a task; entries that stay alone fall away.
3. Candidates, all under length and position bounds: a shingle of a few classes pairs them all; one
   of many pairs each class with a few leaders per band of lengths, in turns that leave out what
   components already join, and last whatever is left between different components. So a
   group of copies costs its size and not its square, and no link between components is missed.
   Each class has a bitmap of parities (long ones have a second, wider one), which bounds the overlap of a
   pair from above and drops most pairs that do not link.
4. Pivots cut the global order into fragments: CUTS ranges of hashes among the shingles of rank 0,
   and those of higher ranks. Each (class, fragment) is a row of its own, with the class's shingles
   in that fragment. A pair meets once in each fragment, where its partial overlap is counted
   without the rest of either document; the partial overlaps are summed per pair.

Classes are known by the hash of their set in all of this, never by doc_id.

Cases: null, empty or blank text: n_shingles 0, component_id its own doc_id, no link. Fewer than
five words: one shingle. Equal texts: one class, linked. Rows with a null doc_id link as others do,
also between others, and never name a component while another id is there. Repeated rows stay;
rows with one doc_id and different texts are documents of their own, in ``kept_documents``, too.
Columns other than doc_id and text are ignored (``kept_documents`` returns them). An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hornspark.llm.common import (
    CHUNK_BYTES,
    Hasher,
    Scratch,
    distinct,
    fragments,
    fresh,
    int64,
    named,
    planed,
    record_slices,
    small_batches,
    split_by,
    texts,
    trim,
    unplaned,
)
from hornspark.llm.components import components

#: Bytes of shingles or entries that a task gathers before it hands them on.
CHUNK = CHUNK_BYTES // 2
#: Similarity as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Counters in each of the two rows of the sketch; a bound on what is broadcast, as one byte each. It steers cost, not results.
CELLS = 1 << 20
#: Classes of one chunk that hold a shingle before it is counted.
HEAVY_LOCAL = 3
#: Bits of a class's bitmap, and of the second one that classes of more than LONG shingles have.
BITS, WIDE, LONG = 1 << 10, 1 << 14, 512
#: Fragments of the order's shingles of rank 0; those of higher ranks are one more.
CUTS = 4
#: Classes that share a shingle and are all paired at once; beyond, leaders come first.
FEW = 8
#: Leaders of a shingle and band in one turn, and turns, while they find links, before what is left between components is paired.
LEADERS = 4
TURNS = 6
#: Classes per shingle, on average over entries, up to which what is left is paired without more turns.
DENSE = 400

#: The top bit of ``pos`` marks a shingle that several classes of the chunk hold. A shingle is known by its part and 32 more
#: bits; where two meet in these, candidates grow by a pair that verification drops.
_ENTRY = np.dtype([("tok", "<u4"), ("nid", "<i8"), ("n", "<u4"), ("pos", "<u4")])
_SHARED = np.uint32(1 << 31)


def shingle_set(text: str | None, hasher: Hasher) -> np.ndarray:
    """The sorted distinct shingles."""
    return distinct(hasher.shingles(text))


def class_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the shingles in each of so many classes. Two bitmaps differ in at most as many bits as two sets in shingles."""
    counts = np.bincount((s >> np.uint64(3)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def counters(s: np.ndarray) -> np.ndarray:
    """The counters of shingles in the sketch: the first row's for all, then the second row's."""
    low, shift = np.uint64(CELLS - 1), np.uint64(CELLS.bit_length() - 1)
    return np.concatenate([s & low, (s >> shift & low) + np.uint64(CELLS)]).astype(np.int64)


def ranks(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The rank of each shingle: the lesser of its two counters."""
    at = counters(s)
    return np.minimum(sketch[at[: len(s)]], sketch[at[len(s) :]])


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, nid) of each row and (null, count, counter) of what is heavy in a chunk."""
    hasher, seen, held, size = Hasher(), set(), [], 0
    names, maps = ["doc_id", "n", "nid", "heavy", "bits", "wide"], pa.list_(pa.int64())

    def heavy() -> pa.RecordBatch:
        all_, count = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
        many = count >= HEAVY_LOCAL
        cells, which = np.unique(counters(all_[many]), return_inverse=True)
        sums = np.bincount(which.ravel(), np.tile(count[many], 2), len(cells))
        k = len(cells)
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), int64(sums), int64(cells), pa.array([True] * k, pa.bool_()), pa.nulls(k, maps), pa.nulls(k, maps)], names)

    for batch in batches:
        ns, ids, bits, wide = [], [], [], []
        for text in texts(batch):
            s = shingle_set(text, hasher)
            nid = class_id(s) if len(s) else None
            ns.append(len(s))
            ids.append(nid)
            first = nid is not None and nid not in seen
            bits.append(bitmap(s, BITS) if first else None)
            wide.append(bitmap(s, WIDE) if first and len(s) > LONG else None)
            if nid is not None and nid not in seen:
                seen.add(nid)
                held.append(s)
                size += s.nbytes
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), int64(ns), pa.array(ids, pa.int64()), pa.array([False] * len(ns), pa.bool_()), pa.array(bits, maps), pa.array(wide, maps)], names)
        if size > CHUNK:
            yield heavy()
            seen, held, size = set(), [], 0
            trim()
    yield heavy()
    trim()


def _postings(sketch, parts: int):
    """Prefix entries in groups (part, sub): sub 0 to be grouped with other chunks', else known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, places, size = Hasher(), set(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            e = np.concatenate(held)
            part = np.concatenate(places)
            order = np.lexsort((e["tok"], part))
            e, part = e[order], part[order]
            key = part << 32 | e["tok"]
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            ship = np.zeros(len(e), bool)
            ship[first] = True
            shared = np.repeat(count > 1, count)
            e["pos"][shared] |= _SHARED
            sub = 1 + (int(e["nid"][0]) & 1023)
            out = [(k, 0, planed(s)) for k, s in record_slices(part[ship], e[ship])]
            out += [(k, sub, planed(s)) for k, s in record_slices(part[shared & ~ship], e[shared & ~ship])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["part", "sub", "entries"])

        for batch in batches:
            for text in texts(batch):
                s = shingle_set(text, hasher)
                n = len(s)
                if not n or (nid := class_id(s)) in seen:
                    continue
                seen.add(nid)
                k = prefix_length(n)
                late = ranks(s, sketch.value)
                if late.any():
                    s = s[np.argsort(late, kind="stable")]
                e = np.empty(k, _ENTRY)
                e["tok"], e["nid"], e["n"], e["pos"] = s[:k] & np.uint64(0xFFFFFFFF), nid, n, np.arange(k)
                held.append(e)
                places.append((s[:k] >> np.uint64(32)).astype(np.int64) & (parts - 1))
                size += e.nbytes
            if size > CHUNK:
                yield from flush()
                seen, held, places, size = set(), [], [], 0
                trim()
        yield from flush()
        trim()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Entries whose shingle two classes hold; of small groups that are all here, those that have a partner within bounds."""
    e = np.concatenate([unplaned(x.as_buffer(), _ENTRY) for x in table.column("entries")])
    marked, pos = (e["pos"] & _SHARED) > 0, (e["pos"] & ~_SHARED).astype(np.int64)
    tok, nid, n = e["tok"].astype(np.int64) | table.column("part")[0].as_py() << 32, e["nid"], e["n"].astype(np.int64)
    if not table.column("sub")[0].as_py():
        order = np.lexsort((nid, tok))
        tok, nid, n, pos, marked = (x[order] for x in (tok, nid, n, pos, marked))
        first = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (nid[1:] != nid[:-1])])
        pos, marked = np.minimum.reduceat(pos, first), np.logical_or.reduceat(marked, first)
        tok, nid, n = tok[first], nid[first], n[first]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        count = np.diff(np.r_[start, len(tok)])
        elsewhere = np.logical_or.reduceat(marked, start)
        keep = np.repeat(elsewhere | (count > FEW), count)
        small = np.repeat(~elsewhere & (count <= FEW), count)
        room = DEN * n - (NUM + DEN) * pos
        for d in range(1, min(FEW, len(tok))):
            i = np.flatnonzero(small[:-d] & (tok[d:] == tok[:-d]))
            j = i + d
            fit = (np.minimum(n[i], n[j]) * DEN >= np.maximum(n[i], n[j]) * NUM) & (room[i] >= NUM * n[j]) & (room[j] >= NUM * n[i])
            keep[i[fit]] = keep[j[fit]] = True
        tok, nid, n, pos = tok[keep], nid[keep], n[keep], pos[keep]
    return pa.table({"tok": int64(tok), "nid": int64(nid), "n": int64(n), "pos": int64(pos)})


def _bounds(a: str, b: str):
    """Length and position bounds of pairs that share the shingle at which both stand."""
    na, nb, pa_, pb = (F.col(f"{x}.{y}") for x, y in ((a, "n"), (b, "n"), (a, "pos"), (b, "pos")))
    alike = (F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM)
    most = F.least(na - pa_, nb - pb)
    return alike & (most * (NUM + DEN) >= (na + nb) * NUM)


def _segments(sketch):
    """(nid, cut, part): the shingles of classes in each fragment of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, size = Hasher(), set(), 0
        edges = np.arange(1, CUTS, dtype=np.uint64) * np.uint64((1 << 64) // CUTS)
        for batch in batches:
            nids, cuts, parts = [], [], []
            for text in texts(batch):
                s = shingle_set(text, hasher)
                if not len(s) or (nid := class_id(s)) in seen:
                    continue
                seen.add(nid)
                size += s.nbytes
                late = ranks(s, sketch.value) > 0
                own = s[~late]
                for cut, part in enumerate([*np.split(own, np.searchsorted(own, edges)), s[late]]):
                    if len(part):
                        nids.append(nid)
                        cuts.append(cut)
                        parts.append(part.view(np.int64))
            ends = np.cumsum([0, *map(len, parts)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), int64(np.concatenate(parts or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([int64(nids), pa.array(cuts, pa.int32()), lists], ["nid", "cut", "part"])
            if size > CHUNK:
                seen, size = set(), 0

    return run


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that link: the overlap in each fragment, summed. segments: (nid, cut, part)."""
    met = pairs.withColumn("cut", F.explode(F.array(*map(F.lit, range(CUTS + 1)))))
    for x in "ba":
        held = split_by(segments, pairs.select(F.col(x).alias("nid")), "nid")[0]
        side = held.select(F.col("nid").alias(x), "cut", F.col("part").alias(f"part_{x}"))
        met = met.hint("merge").join(side, [x, "cut"])
    partial = met.select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("both"))
    counted = partial.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("both").alias("both"))
    return counted.filter(F.col("both") * DEN >= (F.col("na") + F.col("nb") - F.col("both")) * NUM)


def _useful(entries: DataFrame) -> DataFrame:
    """Entries that can have a partner.

    With ``room`` = 5 n - 9 pos, the position bound of a pair reads room(x) >= 4 n(y) and room(y) >= 4 n(x).
    Lengths that are alike lie in one band of ratio 5/4 or in neighbours, so the least length and the most
    room per shingle and three bands decide whether anything can pass.
    """
    e = entries.withColumn("band", F.floor(F.log(F.col("n")) / math.log(DEN / NUM)).cast("int")).withColumn("room", DEN * F.col("n") - (NUM + DEN) * F.col("pos"))
    own = e.groupBy("tok", "band").agg(F.min("n").alias("least"), F.max("room").alias("most"), F.count(F.lit(1)).alias("c"))
    near = own.withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1))))).groupBy("tok", "band")
    near = near.agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("c").alias("c")).filter("c > 1")
    return e.join(near, ["tok", "band"]).filter((F.col("room") >= NUM * F.col("least")) & (F.col("most") >= NUM * F.col("n"))).select("tok", "nid", "n", "pos")


def _leaders(entries: DataFrame, turn: int) -> DataFrame:
    """Pairs of each class with some leaders per shingle and band of lengths.

    The first turn takes the classes that hold the shingle earliest in their order, as these have the
    fewest shingles of their own; later turns take others at random.
    """
    found = []
    for k in range(LEADERS if turn else 2):
        band = F.floor(F.log(F.col("n")) / math.log(DEN / NUM) + k % 2 / 2).cast("int")
        first = F.xxhash64("nid", F.lit(turn * LEADERS + k)) if turn else F.col("pos")
        e = entries.withColumn("band", band)
        lead = e.groupBy("tok", "band").agg(F.min(F.struct(first.alias("first"), "nid", "n", "pos", "comp")).alias("l")).select("tok", "band", "l.*")
        found.append(_pairs(e.alias("x").join(lead.alias("y"), ["tok", "band"]).filter((F.col("x.nid") != F.col("y.nid")) & (F.col("x.comp") != F.col("y.comp")) & _bounds("x", "y"))))
    return reduce(DataFrame.unionByName, found).distinct()


def _all_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share a shingle."""
    x, y = entries.alias("x"), entries.alias("y")
    return _pairs(x.join(y, "tok").filter((F.col("x.nid") < F.col("y.nid")) & (F.col("x.comp") != F.col("y.comp")) & _bounds("x", "y")))


def _pairs(found: DataFrame) -> DataFrame:
    swap = F.col("x.nid") > F.col("y.nid")
    pick = [F.when(swap, F.col(f"{b}.{c}")).otherwise(F.col(f"{a}.{c}")).alias(n) for a, b, c, n in (("x", "y", "nid", "a"), ("y", "x", "nid", "b"), ("x", "y", "n", "na"), ("y", "x", "n", "nb"))]
    return found.select(*pick).distinct()


def _bitmap_passed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow the similarity: sets that differ in d shingles overlap in (na + nb - d) / 2."""
    maps = classes.select("nid", "bits", "wide").hint("merge")
    both = pairs.join(maps.toDF("a", "xa", "wa"), "a").join(maps.toDF("b", "xb", "wb"), "b")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda n, k: n + k)
    differ = F.coalesce(apart("wa", "wb"), apart("xa", "xb"))
    size = F.col("na") + F.col("nb")
    return both.withColumn("differ", differ).filter((size - F.col("differ")) * (NUM + DEN) >= size * 2 * NUM).select("a", "b", "na", "nb", "differ")


def _open(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries with their components, of shingles that several components hold."""
    tagged = entries.drop("comp").join(comps.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    several = tagged.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok")
    return tagged.join(several, "tok", "left_semi").select("tok", "nid", "n", "pos", "comp")


def sketched(heavy: DataFrame) -> np.ndarray:
    """The sketch: how often, as a power of two, what meets in each counter was found. heavy: (n, nid), a counter's counts."""
    sums = heavy.groupBy("nid").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * CELLS rows
    out = np.zeros(2 * CELLS, np.uint8)
    out[sums["nid"].to_numpy(np.int64)] = np.log2(sums["n"].to_numpy(np.float64)).astype(np.uint8)
    return out


def link_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, heavy: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of the classes that link with another."""
    sketch = spark.sparkContext.broadcast(sketched(heavy))
    posted = docs.select("text").mapInArrow(_postings(sketch, fragments(spark, docs)), "part int, sub int, entries binary")
    entries = scratch.keep(posted.groupBy("part", "sub").applyInArrow(_shared, "tok long, nid long, n long, pos long"))
    whole, entries = entries, scratch.keep(_useful(entries))
    scratch.free(whole)
    held = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("k"))
    useful, entries = entries, scratch.keep(entries.join(held, "tok").withColumn("comp", F.col("nid")))
    scratch.free(useful)
    few, many = entries.filter(F.col("k") <= FEW).drop("k"), entries.filter(F.col("k") > FEW).drop("k")
    first = scratch.keep(_all_pairs(few).unionByName(_leaders(many, 0)).distinct())
    passed = scratch.keep(_bitmap_passed(first, classes))

    def fetched(pairs: DataFrame) -> DataFrame:
        """The segments of the pairs' classes; only documents that name one of them are read on."""
        nids = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
        roots = scratch.keep(nids.join(classes, "nid").select(F.col("root").alias("doc_id")))
        held = split_by(docs, roots, "doc_id")[0].select("text").mapInArrow(_segments(sketch), "nid long, cut int, part array<long>")
        return scratch.keep(held.groupBy("nid", "cut").agg(F.first("part").alias("part")))

    def resolve(pairs: DataFrame, segments: DataFrame) -> DataFrame:
        """Those of the pairs that link."""
        return scratch.keep(verified(pairs, segments).select("a", "b"))

    near = fetched(passed)
    best = passed.groupBy("b").agg(F.min(F.struct("differ", "a", "na", "nb")).alias("m")).select("m.a", "b", "m.na", "m.nb")
    best = scratch.keep(best)  # one likely partner each joins most groups
    links = resolve(best, near)
    comps = components(links, scratch)
    label = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    apart = passed.join(best.select("a", "b"), ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = scratch.keep(apart.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "na", "nb"))
    new = resolve(apart, near)
    if new.limit(1).count():
        links = links.unionByName(new)
        comps = components(links, scratch)
    done, turn, found = first, 1, 1
    rest = scratch.keep(_open(many, comps))
    while True:
        sizes = rest.groupBy("tok").agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("pairs")).first()
        if not sizes.n:
            return comps
        last = not found or turn > TURNS or sizes.pairs <= DENSE * sizes.n
        more = _all_pairs(rest) if last else _leaders(rest, turn)
        more = scratch.keep(more.join(done.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"))
        passed, found, turn = scratch.keep(_bitmap_passed(more, classes)), 0, turn + 1
        if passed.limit(1).count():
            new = resolve(passed, fetched(passed))
            found = new.limit(1).count()
        if found:
            links = links.unionByName(new)
            comps = components(links, scratch)
        if last:
            return comps
        done = done.unionByName(more)
        scratch.free(rest)
        rest = scratch.keep(_open(many, comps))


def grouped(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, nid) of every row, and (nid, comp, component_id, component_rows) of the classes whose component has several rows."""
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = scratch.keep(docs.mapInArrow(_survey, "doc_id long, n long, nid long, heavy boolean, bits array<long>, wide array<long>"))
    info = survey.filter("not heavy").select("doc_id", "n", "nid")
    held = survey.filter("not heavy and nid is not null").groupBy("nid")
    classes = scratch.keep(held.agg(F.min("doc_id").alias("root"), F.count(F.lit(1)).alias("rows"), *(F.first(c, ignorenulls=True).alias(c) for c in ("bits", "wide"))))
    comps = link_classes(spark, docs, classes, survey.filter("heavy"), scratch)
    known = classes.join(comps.withColumnRenamed("node", "nid"), "nid", "left").select("nid", "root", "rows", F.coalesce("comp", "nid").alias("comp"))
    groups = known.groupBy("comp").agg(F.min("root").alias("component_id"), F.sum("rows").alias("component_rows")).filter("component_rows > 1")
    return info, scratch.keep(known.select("nid", "comp").join(scratch.keep(groups), "comp").select("nid", "comp", "component_id", "component_rows"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and the size of its component. Only rows of larger components meet the table of these."""
    scratch = Scratch(spark, "ngram")
    info, labels = grouped(spark, docs, scratch)
    some, others = split_by(info, labels, "nid")
    rows = some.join(labels, "nid", "left").unionByName(others, allowMissingColumns=True)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_rows", F.lit(1)).alias("component_rows"))
    return scratch.finish(out)


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: one row of each component stays.

    It is the one with the smallest doc_id (any id before null; of several texts under that id the one whose
    class has the smallest hash; of equal rows one). Rows are told apart by doc_id and class, so a document that
    shares its id with a copy of another stays. Rows without words have no copies, and all stay.
    """
    scratch = Scratch(spark, "copies")
    info, labels = grouped(spark, docs, scratch)
    rows = split_by(info, labels, "nid")[0].join(labels.select("nid", "comp"), "nid").groupBy("comp", "nid", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = scratch.keep(rows)
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "nid")).alias("k"))
    stays = F.col("k.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k.nid") == F.col("nid"))
    names = docs.columns
    doc, theirs, nid, own, verdict = fresh(names, "_doc", "_judged", "_nid", "_own", "_stays")
    judged = rows.join(first, "comp").withColumn("stays", stays).filter("not stays or copies > 1")
    judged = scratch.finish(judged.select(F.col("doc_id").alias(doc), F.col("nid").alias(nid), F.col("stays").alias(verdict)))  # ids; texts stay where they are
    some, others = split_by(docs.withColumn(doc, F.col("doc_id").cast("long")), judged, doc)
    schema = StructType([*some.schema.fields, StructField(own, LongType())])
    met = some.mapInArrow(_with_class(own), schema).join(judged.withColumnRenamed(doc, theirs), F.col(doc).eqNullSafe(F.col(theirs)) & (F.col(own) == F.col(nid)), "left")
    alone = met.filter(F.col(verdict).isNull()).select(*named(names))
    one = met.filter(F.col(verdict)).dropDuplicates([doc, nid]).select(*named(names))
    return others.select(*named(names)).unionByName(alone).unionByName(one)


def _with_class(name: str):
    """Rows with their class as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sets = (shingle_set(text, hasher) for text in texts(batch))
            nids = [class_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nids, pa.int64())], [*batch.schema.names, name])

    return run
