"""Operator 4: benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and characters beyond ASCII, in lower case. A seed hashes the
words at a mask's positions and ignores those between, so that a changed word between them leaves
the hash as it is. Test and training hashes are joined: the benchmark's seeds are a table, and of a
document those seeds that a Bloom filter of the benchmark's lets through, each stretch of text around them as one row
with the hashes of its words. A pair of equal seeds names a diagonal (document position minus item position),
which is verified once: item and document words are compared position by position, and the passage counts when some
window of the item, of WINDOW words or of the whole item where it is shorter, agrees in 80 % of its
positions. The masks are such that every pattern of changed words that this allows, in windows of SHORTEST
to WINDOW words, leaves at least one seed whole (a test goes through all of them), so nothing is left to chance.

Neither table goes through the driver, and documents are read once whatever the benchmark's size. What
is broadcast is the filter, of at most 2^MOST_BITS bits: beyond that it lets more seeds through to the join.

Result: one row per document and benchmark item that it holds: doc_id, item_id, item_start, doc_start
(word positions of the best window), n_window, n_equal. Documents without a passage have no row.

Cases: null texts and texts without words match nothing. Items of fewer than SHORTEST words are too
short to be told from chance and match nothing. Null ids stay null in the result; rows with equal
ids count as one document or item, whose best window is kept. ``clean_documents`` drops rows: of texts that share an
id, those that hold a passage. Empty tables give empty results. Other columns are ignored (``clean_documents`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.llm.common import Hasher, Scratch, fresh, int64, mixed, named, small_batches, split_by, texts

#: Offsets of the words that count.
MASKS = [(0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 6, 7), (0, 2, 4, 6, 8, 10), (0, 1, 4, 5, 8, 9), (0, 1, 3, 5, 7, 8)]
WINDOW = 20
NUM, DEN = 4, 5
SHORTEST = 8
#: Bits of the filter, as powers of two: from LEAST_BITS, with 64 bits a seed, to MOST_BITS; and bits that a seed sets.
LEAST_BITS, MOST_BITS, PROBES = 20, 27, 4

#: ASCII characters that are neither letters nor digits part words.
_APART = bytes(c for c in range(128) if not chr(c).isalnum())
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def word_ids(text: str, hasher: Hasher) -> np.ndarray:
    return hasher.words(text.lower())


def seeds(w: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(w) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.full(n, len(mask) * 1000 + mask[-1] * 31 + mask[2], np.uint64)
        for k, o in enumerate(mask):
            s = s + w[o : o + n] * _K[k]
    return mixed(s)


def key_of(ident: int | None, start: int, words: np.ndarray) -> int:
    """A hash that names a text's words under an id."""
    return xxhash.xxh3_64_intdigest(f"{ident} {start} ".encode() + words.tobytes()) - (1 << 63)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), int64(np.concatenate(rows or [np.empty(0, np.int64)]).view(np.int64)))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, words, seeds, at): the items' words and their seeds with positions."""
    hasher = Hasher(_APART)
    for batch in batches:
        ids, keys, words, keyed, at = [], [], [], [], []
        for item, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            w = word_ids(text or "", hasher)
            if len(w) >= SHORTEST:
                found = [seeds(w, m) for m in MASKS]
                ids.append(item)
                keys.append(key_of(item, 0, w))
                words.append(w)
                keyed.append(np.concatenate(found))
                at.append(np.concatenate([np.arange(len(s), dtype=np.int64) for s in found]))
        yield pa.RecordBatch.from_arrays([int64(keys), pa.array(ids, pa.int64()), _lists(words), _lists(keyed), _lists(at)], ["item", "item_id", "words", "seeds", "at"])


def probed(s: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the seeds that the filter lets through."""
    low, hit = np.uint64(8 * len(bitmap) - 1), np.arange(len(s))
    for k in range(PROBES):
        at = (s[hit] + np.uint64(k) * (s[hit] >> np.uint64(32))) & low
        hit = hit[bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]
    return hit


def stretches(w: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, seeds, positions): the parts of a text around the seeds that may be the benchmark's."""
    found, places = [], []
    for mask in MASKS:
        s = seeds(w, mask)
        hit = probed(s, bitmap)
        found.append(s[hit])
        places.append(hit)
    found, places = np.concatenate(found), np.concatenate(places)
    if not len(places):
        return
    order = np.argsort(places, kind="stable")
    found, places = found[order], places[order]
    cuts = np.flatnonzero(np.diff(places) > 2 * WINDOW) + 1  # further apart, no window holds both
    for s, p in zip(np.split(found, cuts), np.split(places, cuts), strict=True):
        yield max(0, int(p[0]) - WINDOW), min(len(w), int(p[-1]) + WINDOW), s, p


def _hits(bitmap):
    """(stretch, doc_id, start, words, seeds, at) of the documents' stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(_APART)
        for batch in batches:
            keys, ids, starts, words, keyed, at = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                w = word_ids(text, hasher) if text else np.empty(0, np.uint64)
                for a, b, s, p in stretches(w, bitmap.value) if len(w) >= SHORTEST else ():
                    keys.append(key_of(doc, a, w[a:b]))
                    ids.append(doc)
                    starts.append(a)
                    words.append(w[a:b])
                    keyed.append(s)
                    at.append(p)
            yield pa.RecordBatch.from_arrays([int64(keys), pa.array(ids, pa.int64()), int64(starts), _lists(words), _lists(keyed), _lists(at)], ["stretch", "doc_id", "start", "words", "seeds", "at"])

    return run


def window_on(q: np.ndarray, d: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """The best window of q against d[shift:], if it agrees in enough positions."""
    size = min(WINDOW, len(q))
    a, b = max(0, -shift), min(len(q), len(d) - shift)
    if b - a < size:
        return None
    same = np.r_[0, np.cumsum(q[a:b] == d[a + shift : b + shift])]
    equal = same[size:] - same[:-size]
    k = int(equal.argmax())
    return (int(equal[k]), -(a + k), -(a + k + shift), size) if equal[k] * DEN >= size * NUM else None


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages on candidate diagonals: (doc_id, start, words, item_id, item words, diagonal within the stretch)."""
    for batch in batches:
        doc, start, item, shift = (batch.column(i).to_pylist() for i in (0, 1, 3, 5))
        rows = []
        for k in range(batch.num_rows):
            d, q = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in (2, 4))
            if best := window_on(q, d, shift[k]):
                equal, at, p, size = best
                rows.append((doc[k], item[k], -at, start[k] - p, size, equal))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["doc_id", "item_id", "item_start", "doc_start", "n_window", "n_equal"])


def seed_bits(seeds_: DataFrame) -> np.ndarray:
    """The filter of the seeds (seed), packed; its words come to the driver, 2^(MOST_BITS - 6) at most."""
    n = seeds_.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))
    low = (1 << bits) - 1
    probes = F.array(*(F.expr(f"((seed & {low}) + {k} * (shiftrightunsigned(seed, 32) & {low})) & {low}") for k in range(PROBES)))
    at = seeds_.select(F.explode(probes).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = words.toPandas()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The passages of ``benchmark`` in ``docs``."""
    scratch = Scratch(spark, "seeds")
    return scratch.finish(passages(spark, docs, benchmark, scratch))


def passages(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items, "item long, item_id long, words array<long>, seeds array<long>, at array<long>")
    items = scratch.keep(items.dropDuplicates(["item"]))
    tests = items.select("item", F.explode(F.arrays_zip("seeds", "at")).alias("z")).select("item", F.col("z.seeds").alias("seed"), F.col("z.at").alias("at"))
    bitmap = spark.sparkContext.broadcast(seed_bits(tests.select("seed")))
    held = scratch.keep(docs.mapInArrow(_hits(bitmap), "stretch long, doc_id long, start long, words array<long>, seeds array<long>, at array<long>").dropDuplicates(["stretch"]))
    own = held.select("stretch", "start", F.explode(F.arrays_zip("seeds", "at")).alias("z")).select("stretch", F.col("z.seeds").alias("seed"), (F.col("z.at") - F.col("start")).alias("place"))
    met = own.hint("merge").join(tests, "seed").select("stretch", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    met = met.join(items.select("item", "item_id", F.col("words").alias("q")), "item").join(held.select("stretch", "doc_id", "start", "words"), "stretch")
    schema = "doc_id long, item_id long, item_start long, doc_start long, n_window long, n_equal long"
    rows = met.select("doc_id", "start", "words", "item_id", "q", "shift").mapInArrow(_verified, schema)
    best = F.max(F.struct("n_equal", -F.col("item_start"), -F.col("doc_start"), "n_window", "item_start", "doc_start"))
    return rows.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.item_start", "b.doc_start", "b.n_window", "b.n_equal")


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no passage of the benchmark.

    Passages are found per id; where texts share an id (or have none), the row's own hash stands in for it,
    so that one text does not speak for another.
    """
    scratch = Scratch(spark, "clean")
    names = docs.columns
    own, hit = fresh(names, "_own", "_hit")
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    found = scratch.finish(passages(spark, keyed.select(F.col(own).alias("doc_id"), "text"), benchmark, scratch).select(F.col("doc_id").alias(hit)).distinct())
    some, others = split_by(keyed, found.withColumnRenamed(hit, own), own)
    kept = some.join(found.hint("merge"), F.col(own) == F.col(hit), "left_anti")
    return others.unionByName(kept).select(*named(names))
