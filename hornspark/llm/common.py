"""What the corpus operators share: word and shingle hashes, scratch tables, batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; texts of a batch are the unit of Python memory.
BATCH_ROWS = 500
#: Text bytes that a task gathers before it hands its partial groups on.
CHUNK_BYTES = 24 << 20
#: Words in a shingle.
SHINGLE = 5
#: Bits of the broadcast filter before joins on few keys; a bound on its size.
FILTER_BITS = 1 << 24
#: Bytes between words.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of a text that are hashed at once.
_PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15

_MULT = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own serves a single machine alone; a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="hornspark-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound Arrow batches: long texts make the default number of rows too large for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return f"{self.base}/{self.count}"

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and reread."""
        where = self.path()
        df.write.parquet(where)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch = where
        return out

    def free(self, df: DataFrame) -> None:
        """Remove one table that ``keep`` has made."""
        self._delete(df._scratch)

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` cut from the scratch tables, which go."""
        shared_dir(self.spark)
        out = df.checkpoint()
        self.drop()
        return out

    def drop(self) -> None:
        self._delete(self.base)
        release(self.spark)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores where ``taken`` has them already (Spark does not tell cases apart)."""
    used, out = {n.lower() for n in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by name, whatever characters a name has."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def split_by(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have their key in ``wanted``, rows that do not), without a shuffle of ``rows``; null is a key like others.

    A bitmap of FILTER_BITS hash values, whatever the tables' sizes, is broadcast as at most
    FILTER_BITS / 64 rows.
    """
    at, word, bit, bits, hit = fresh([*rows.columns, key], "_at", "_word", "_bit", "_bits", "_hit")
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))
    own = F.expr(f"shiftleft(1L, CAST({at} & 63 AS INT))")
    words = wanted.select(place.alias(at)).select(F.shiftright(at, 6).alias(word), own.alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(bits))
    marked = rows.withColumn(at, place).join(F.broadcast(words), F.shiftright(at, 6) == F.col(word), "left")
    marked = marked.withColumn(hit, F.coalesce(F.col(bits).bitwiseAND(own) != 0, F.lit(False)))
    columns = named(rows.columns)
    return marked.filter(F.col(hit)).select(*columns), marked.filter(~F.col(hit)).select(*columns)


def matching(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``wanted`` on ``key``, where few rows match: the others stay out of the shuffle."""
    return split_by(rows, wanted, key)[0].join(wanted.hint("merge"), key)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is not in ``ids``; only those that may be meet ``ids`` in a join."""
    some, others = split_by(rows, ids, key)
    return others.unionByName(some.join(ids.hint("merge"), key, "left_anti"))


class Hasher:
    """64-bit hashes of the words of a text, over whole byte arrays: sums of random values times powers.

    ``blanks`` separate words. With ``fold``, A-Z hash as a-z. Long texts go in parts that end
    between words. Made on the worker; tables depend on nothing but the arguments.
    """

    def __init__(self, blanks: bytes = BLANKS, fold: bool = True):
        self.value = np.random.default_rng(20240501).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[list(blanks)] = True
        self.value[self.blank] = 0
        if fold:
            self.value[65:91] = self.value[97:123]
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.n, self.up, self.down = n, _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def words(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) <= _PART:
            return self.part(raw)
        out, at = [], 0
        while at < len(raw):
            end = min(at + _PART, len(raw))
            if end < len(raw):
                gaps = np.flatnonzero(self.blank[raw[at:end]])
                while not len(gaps) and end < len(raw):  # a word longer than a part
                    gaps = np.flatnonzero(self.blank[raw[end : end + _PART]]) + (end - at)
                    end = min(end + _PART, len(raw))
                end = at + int(gaps[-1]) + 1 if len(gaps) else len(raw)
            out.append(self.part(raw[at:end]))
            at = end
        return np.concatenate(out)

    def part(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if not n:
            return np.empty(0, np.uint64)
        if n > self.n:
            self.grow(1 << (n - 1).bit_length())
        gap = self.blank[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.r_[0, edge]
        start = edge[::2]
        if not len(start):
            return np.empty(0, np.uint64)
        v = self.value[raw]
        v *= self.up[:n]
        v = np.add.reduceat(v, start)
        v *= self.down[start]
        return mixed(v)

    def shingles(self, text: str | None) -> np.ndarray:
        return shingle_hashes(self.words(text)) if text else np.empty(0, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(s)
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(w: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles in order; fewer words make one shingle, none make none."""
    n = len(w)
    if n == 0:
        return w
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return mixed(np.array([(w * _MULT[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        s = w[: n - 4] * _MULT[0]
        for i in range(1, SHINGLE):
            s = s + w[i : n - 4 + i] * _MULT[i]
    return mixed(s)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def int64(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def fragments(spark: SparkSession, df: DataFrame, per: int = 16 << 20, least: int = 64) -> int:
    """A power of two of hash ranges, in proportion to the bytes that ``df`` scans; texts are measured where the plan does not know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 52:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = least
    while n * per < size:
        n *= 2
    return n


def trim() -> None:
    """Give memory that a worker has freed back to the system, so that idle workers do not hold what one chunk took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def planed(rows: np.ndarray) -> bytes:
    """Structured rows byte by byte of a row, all rows' first bytes first: bytes that hardly change lie side by side and compress."""
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def unplaned(buffer, dtype: np.dtype) -> np.ndarray:
    planes = np.frombuffer(buffer, np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def record_slices(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``rows`` (structured) by ``key``: each key with its rows, in key order."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for part, k in zip(np.split(rows, cuts), key[np.concatenate(([0], cuts))], strict=True):
        yield int(k), part
