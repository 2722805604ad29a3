"""Operator 7: packing documents into sequences of 2048 tokens by exact-complement hashing.

A document is its token ids and a closing id 0. Longer ones are cut from the end into pieces of 2048
tokens, so that only the first piece is shorter. Pieces of equal length are alike, so the plan needs
only how many pieces there are of each length: a table of at most 2048 counts, whatever the
corpus. The planner, on the driver, takes the longest length left and looks its gap up in hash tables by sum:
the single lengths, the pairs of lengths with that sum, and for triples each length with the pairs of the
sum that is left (listing triples themselves would take a hundred million entries). Entries whose
pieces are used up are passed over for good. Where a combination fills
the gap exactly, as many sequences as the counts allow are closed at once. Lengths that no
combination completes go best-fit: the fullest open sequence that has room.

The plan is a list of blocks: ``m`` sequences that each take a piece of given lengths. Its size is
bounded by the lengths, not the pieces. Pieces get their rank among equal lengths from counts per
hash bucket and a rank inside a bucket; pieces are numbered as they are written, so equal rows part, too. A length has a bucket for each BUCKET_ROWS of its pieces, so one that a
third of all pieces have is spread over as many tasks as it needs.

Cases: null and empty texts are one piece of the single id 0. Repeated rows are packed as often as
they occur; null ids stay null. Other columns are ignored. An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornspark.llm.common import Scratch, int64, small_batches, texts

SIZE = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length in a hash bucket, about; what one task ranks.
BUCKET_ROWS = 100_000


class Encoder:
    """Ids of whole texts as the ``tokenizers`` file gives them; its added strings in a text have their own ids.

    Where the same vocabulary lies beside the file as ranks, ``tiktoken`` merges by those: the same ids at
    four times the speed. Without ``added``, such strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = True):
        import base64
        import json
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                own = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=own)
            self.encode = (lambda text: encoding.encode(text, allowed_special="all", disallowed_special=())) if added else encoding.encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = not added
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), "<u4")


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of ``size`` but the first."""
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, number = Encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ids = np.r_[encoder.ids(text or ""), np.zeros(1, "<u4")].astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids))):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            numbers = np.arange(number, number + len(rows))
            number += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(int64(c) for c in cols[2:]), int64(numbers)], ["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return run


@dataclass(frozen=True)
class Block:
    """``count`` sequences from number ``first`` on; ``lengths`` are the pieces of each, in order."""

    first: int
    count: int
    lengths: tuple[int, ...]


def plan(counts: dict[int, int], size: int = SIZE) -> list[Block]:
    """Blocks that use every piece of ``counts`` (pieces by length) exactly once: the fewest sequences of a few tries.

    Combinations of up to three pieces are nearly always best; where lengths are few and odd, their
    use of short pieces can cost more than it closes, so smaller combinations are tried as well.
    """
    return min((_plan(counts, size, parts) for parts in (3, 2, 1)), key=lambda blocks: sum(b.count for b in blocks))


class SumIndex:
    """Pairs of lengths by their sum, the longer one first and longest pairs first; ``left`` says what there still is."""

    def __init__(self, left: dict[int, int]):
        self.left = left
        self.all = np.array(sorted(left, reverse=True), np.int64)
        self.there = np.zeros(int(self.all[0]) + 1 if len(self.all) else 1, bool)
        self.there[self.all] = True
        self.table: dict[int, list[int]] = {}
        self.gone: dict[int, int] = {}

    def lengths(self, below: int) -> Iterator[int]:
        return (int(a) for a in self.all[np.searchsorted(-self.all, -below, "right") :] if a in self.left)

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        longer = self.table.get(total)
        if longer is None:
            a = self.all[(self.all < total) & (2 * self.all >= total)]
            b = total - a
            longer = self.table[total] = a[(b < len(self.there)) & self.there[np.minimum(b, len(self.there) - 1)]].tolist()
        k = self.gone.get(total, 0)
        while k < len(longer) and not (longer[k] in self.left and total - longer[k] in self.left):
            k += 1  # used up, and pieces never come back
        self.gone[total] = k
        return ((a, total - a) for a in longer[k:] if a in self.left and total - a in self.left)


def _plan(counts: dict[int, int], size: int, parts: int) -> list[Block]:
    left = {n: c for n, c in counts.items() if c > 0}
    blocks: list[Block] = []
    number = 0

    def emit(lengths: tuple[int, ...], count: int) -> None:
        nonlocal number
        blocks.append(Block(number, count, lengths))
        number += count
        for n in lengths:
            left[n] -= count
            if not left[n]:
                del left[n]

    def uses(lengths: tuple[int, ...]) -> int:
        return min(left.get(n, 0) // lengths.count(n) for n in lengths)

    index = SumIndex(left) if parts > 1 else None

    def complement(n: int, gap: int) -> tuple[int, ...] | None:
        """Lengths of one, two or three pieces that sum to ``gap``, the longest first, as far as there are any."""
        if gap in left and uses((n, gap)):
            return (gap,)
        if parts > 1 and (pair := next((p for p in index.pairs(gap) if uses((n, *p))), None)):
            return pair
        for a in index.lengths(gap) if parts > 2 else ():
            if 3 * a < gap:
                break
            if pair := next((p for p in index.pairs(gap - a) if p[0] <= a and uses((n, a, *p))), None):
                return (a, *pair)
        return None

    residual: dict[int, int] = {}
    while left:
        n = max(left)
        if n == size:
            emit((n,), left[n])
        elif (found := complement(n, size - n)) is not None:
            lengths = (n, *found)
            emit(lengths, uses(lengths))
        else:
            residual[n] = left.pop(n)
    return blocks + _best_fit(residual, number, size)


def _best_fit(counts: dict[int, int], number: int, size: int) -> list[Block]:
    """Lengths from long to short, each into the open sequences with the least room that holds them."""
    open_: dict[tuple[int, ...], int] = {}  # contents: sequences alike
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, ...]]] = defaultdict(list)

    def put(lengths: tuple[int, ...], count: int) -> None:
        room = size - sum(lengths)
        if lengths in open_:
            open_[lengths] += count
            return
        open_[lengths] = count
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(lengths)

    def take(room: int, most: int) -> tuple[tuple[int, ...], int]:
        lengths = by_room[room][-1]
        k = min(most, open_[lengths])
        open_[lengths] -= k
        if not open_[lengths]:
            del open_[lengths]
            by_room[room].pop()
            if not by_room[room]:
                rooms.remove(room)
        return lengths, k

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            room = next((r for r in rooms if r >= n), None)
            if room is None:
                fit = min(size // n, c)
                put((n,) * fit, c // fit)
                c %= fit
            else:
                lengths, k = take(room, c)
                put((*lengths, n), k)
                c -= k
    blocks = []
    for lengths, count in open_.items():
        blocks.append(Block(number, count, lengths))
        number += count
    return blocks


def slots(blocks: list[Block]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first, offset): pieces of ``length`` with rank in [lo, hi) go to sequence first + rank - lo, at ``offset``."""
    used: dict[int, int] = defaultdict(int)
    out = []
    for b in blocks:
        offset = 0
        for n in b.lengths:
            out.append((n, used[n], used[n] + b.count, b.first, offset))
            used[n] += b.count
            offset += n
    return out


def _place(table):
    """Sequence and offset of each piece, by binary search among the slots of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        stride = int(s[:, 2].max()) + 1
        low = s[:, 0] * stride + s[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(low, length * stride + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), int64(s[at, 3] + rank - s[at, 1]), int64(s[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long, number long")
    pieces = scratch.keep(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most SIZE rows
    if not counts:
        return scratch.finish(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    table = np.array(sorted(slots(plan(counts))), np.int64)
    buckets = F.broadcast(spark.createDataFrame([(n, 1 + c // BUCKET_ROWS) for n, c in counts.items()], "length long, buckets long"))  # at most SIZE rows
    bucket = F.pmod(F.xxhash64("number"), F.col("buckets"))
    dealt = pieces.join(buckets, "length").withColumn("bucket", bucket).drop("buckets")
    order = Window.partitionBy("length").orderBy("bucket")
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each BUCKET_ROWS pieces, and one a length
    before = scratch.keep(sizes.select("length", "bucket", (F.sum("n").over(order) - F.col("n")).alias("before")))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("number"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    placed = ranked.mapInArrow(_place(spark.sparkContext.broadcast(table)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return scratch.finish(placed)
