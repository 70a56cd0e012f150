"""Helpers shared by the training-data operators.

Batches of text are handled as one byte array with offsets (the Arrow layout), so that
tokenising and hashing are numpy passes over bytes instead of Python loops over words.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.lineage import materialise, shared_folder

#: The white space that separates words in the contracts of this package.
WS_CHARS = " \t\n\x0b\f\r"
WS_CLASS = r"[\x20\x09-\x0D]+"

_U = np.uint64
MASK64 = (1 << 64) - 1

IS_WS = np.zeros(256, bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

#: Odd multiplier of the rolling hash, and a random value for each byte.
_P = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n; grown on demand and kept by the process."""
    global _POW, _INV
    if len(_POW) <= n:
        size = 1 << max(16, n.bit_length())
        inv = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([[_U(1)], np.cumprod(np.full(size, _P, np.uint64))])
            _INV = np.concatenate([[_U(1)], np.cumprod(np.full(size, inv, np.uint64))])
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Rolling:
    """Hashes of any byte range of one array, from prefix sums of byte value times power."""

    def __init__(self, data: np.ndarray):
        self.pow, self.inv = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.pow[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A mixed hash for each range; equal bytes give equal hashes wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])


#: Words of more lanes of 8 bytes than this are hashed as a whole by BLAKE2.
_LANES = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: 8 bytes at a time go through ``mix``, which is not linear, so no pattern of bytes collides by its form."""
    n = ends - starts
    lanes = np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    h = mix(n.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))
    h = mix(h + (lanes[starts] & _LOW[np.minimum(n, 8)]))
    for k in range(1, _LANES):
        idx = np.flatnonzero(n > 8 * k)
        if not len(idx):
            return h
        h[idx] = mix(h[idx] * _U(_P) + (lanes[starts[idx] + 8 * k] & _LOW[np.minimum(n[idx] - 8 * k, 8)]))
    for i in np.flatnonzero(n > 8 * _LANES):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into slices of about ``most`` bytes of text (one long text may exceed it).

    Yields (slice, bytes, offsets): document i of the slice holds bytes[offsets[i]:offsets[i+1]];
    null texts are empty there.
    """
    for batch in batches:
        col = batch.column(column)
        if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            kind = np.int64
        else:
            kind = np.int32
        n = len(col)
        if n == 0:
            continue
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            end = min(end, n)
            yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end


def word_spans(data: np.ndarray, off: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a batch, and the document of each; no word crosses documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_WS[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.diff(np.append(at, len(sorted_keys)))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binary_concat(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# ---------------------------------------------------------------- columns


def words_col(text: Column) -> Column:
    """The words of a text; no word is empty. Null gives an empty array."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_CLASS))


def n_words_col(text: Column) -> Column:
    """How many words a text has; null gives 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_CLASS))).cast("long")


# ---------------------------------------------------------------- distributed order


def prefix(df: DataFrame, group: list[str], order: list[str], value: str | None, out: str, buckets: int = 1024, coarse: Column | None = None) -> DataFrame:
    """Adds the exclusive prefix sum of ``value`` (or the row number from 0) inside each group.

    A window over a whole group would put a hot group into one task. Rows are dealt into
    hash buckets of ``order`` instead: sums by (group, bucket) are small, get their own
    prefix, and only the rows of one bucket are sorted together. The order is by bucket,
    then by ``order``; ``coarse`` (an int column from 0 to 3) comes before the bucket.
    ``order`` must identify a row for the result to be the same in each run, and the group
    columns must not be null (they are joined by equality).
    """
    rank = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets))
    if coarse is not None:
        rank = rank + coarse.cast("long") * buckets
    df = df.withColumn("_bucket", rank)
    v = F.lit(1).cast("long") if value is None else F.col(value)
    sums = df.groupBy(*group, "_bucket").agg(F.sum(v).alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0).cast("long")).alias("_base"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(v).over(inner), F.lit(0).cast("long")))
    joined = df.join(sums, [*group, "_bucket"])
    return joined.select(*[F.col(c) for c in df.columns if c not in ("_bucket", "_in")], (F.col("_base") + F.col("_in")).alias(out))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], rows: int = 50_000) -> DataFrame:
    """Adds exclusive prefix sums over all rows in ``order``, without a task that sees all of them.

    Rows are dealt out by ranges of ``order`` (about ``rows`` in each), and the sums of the
    ranges, one row each, get their prefix. ``order`` identifies a row and is never null.
    """
    df = materialise(df)
    parts = max(1, -(-df.count() // rows))
    names = {c: f"_{c}_sum" for c in sums}
    ranged = materialise(df.withColumns({names[c]: v for c, v in sums.items()}).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(*[F.sum(n).alias(n) for n in names.values()])
    base = base.select("_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_base") for n in names.values()])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"{n}_in": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names.values()}).join(base, "_part")
    return out.select(*df.columns, *[(F.col(f"{n}_base") + F.col(f"{n}_in")).alias(c) for c, n in names.items()])


# ---------------------------------------------------------------- lineage


def stored(df: DataFrame) -> DataFrame:
    """Like ``materialise``, as a Parquet table in the shared folder: columns are encoded, so large results take far less room."""
    return stored_at(df)[0]


#: Stored tables that are left, and go when the driver ends.
_LEFT: dict[str, SparkSession] = {}


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, and the table's path for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LEFT[path] = spark
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    _LEFT.pop(path, None)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _discard_left() -> None:
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):  # a session that is gone cannot delete
            discard(spark, path)


def _collect_garbage(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that the driver has let go; asking once after a large step keeps the disk low, and needs no waiting."""
    gc.collect()
    with contextlib.suppress(Exception):  # only a hint: sessions without a JVM of their own have none to ask
        spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Inside, at most ``rows`` rows go to a Python worker at once: documents are long, and the default of 10,000 is a third of a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(taken: list[str], name: str) -> str:
    """A column name that no column of ``taken`` has, whatever its case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b): (id, comp), comp the smallest id reachable.

    Minimum labels move along edges and then jump to the label of the label, so the rounds
    grow with the logarithm of a component's diameter. Labels are only ever held in
    DataFrames; each round is cut with a reliable checkpoint.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("top"))
        new = materialise(step.join(up, step.comp == up.up).select("id", F.least("comp", "top").alias("comp"), "old"))
        labels = new.select("id", "comp")
        if new.where("comp <> old").limit(1).count() == 0:
            return labels


def sorted_sets(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (group, hash) once, in order of groups; groups are small whole numbers from 0.

    One sort of a single key (group, then the upper bits of the hash) is several times faster
    than a sort by two keys; hashes that agree in those bits are put in order afterwards.
    """
    if len(h) == 0:
        return group, h
    bits = _U(max(1, int(group.max()).bit_length()))
    by = np.argsort(group.astype(np.uint64) << (_U(64) - bits) | h >> bits)
    group, h = group[by], h[by]
    same = (group[1:] == group[:-1]) & (h[1:] >> bits == h[:-1] >> bits)
    if (same & (h[1:] != h[:-1])).any():
        by = np.lexsort((h, group))
        group, h = group[by], h[by]
    keep = np.ones(len(h), bool)
    keep[1:] = (group[1:] != group[:-1]) | (h[1:] != h[:-1])
    return group[keep], h[keep]
