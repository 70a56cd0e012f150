"""Suffix-array dedup: removes bytes covered by a 200-byte string that also starts elsewhere.

Sampled suffixes. A window of LENGTH bytes is represented by its anchor, the position with
the smallest hash among its GRAM-byte substrings (the leftmost of equal ones). Equal windows
have equal anchors at equal places, wherever they stand, so only suffixes that begin at
anchors need to be indexed, about one in 85. Neighbouring windows with the same anchor
form a run; a run is known by its anchor's hash and the hash of all its bytes.

Logarithmic index family. Each task keeps an index of levels. A new batch of text gets its
suffix array (runs sorted by anchor hash, then content hash); it is merge-scanned against
the levels for whole runs that match; then levels of equal size class merge, so a run is
moved a logarithmic number of times. A task hands on one entry for each distinct run; runs
found again inside the task are already known to be covered. The tasks' last levels are
merged by Spark: by (anchor, content) for whole runs, and where an anchor occurs with
different contents, by the single windows of one run of each content.

Runs that match as a whole need no bytes beyond their hash. For the rest the windows are
hashed (64 bits of content) and counted, after a combination in each task. Groups of copies
therefore cost one entry for each task, and windows inside copies are never listed. Equality is
that of 128 bits, 64 of the anchor (or block) and 64 of the content; what is hashed is shorter than 512
bytes, below the length at which patterns collide under a polynomial modulo 2 ** 64.

Defined results: null and empty texts have 0 bytes; texts under LENGTH bytes lose nothing;
repeated rows, and rows with equal doc_ids, count as different places; strings are judged
on the input, so both copies go (the first copy is not spared); what is left may split a
UTF-8 sequence, so texts are compared and hashed as bytes; extra columns are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Rolling, as_long, discard, documents, mix, stored, stored_at, text_batches

LENGTH = 200
GRAM = 32
#: Anchors with more different contexts than HOT are dealt out by blocks of BLOCK windows and the bytes that a block's windows share.
HOT = 64
BLOCK = 16

_U = np.uint64
_PLACE = _U((1 << 22) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: block-wise minima from both sides."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Runs:
    """The runs of windows of a batch: document, first window (absolute), windows, distance to the anchor, its hash, content hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, gram: int):
        self.data, self.off = data, off
        empty = np.zeros(0, np.int64)
        self.back = empty
        self.doc, self.at, self.n, self.anchor, self.content = empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
        n = len(data)
        size = np.diff(off)
        if n < length or not (size >= length).any():
            return
        self.rolling = rolling = Rolling(data)
        place = np.arange(n - gram + 1)
        h = rolling.ranges(place, place + gram)
        low = sliding_min((h & ~_PLACE) | (place.astype(np.uint64) & _PLACE), length - gram + 1)
        window = np.arange(len(low))
        anchor = window + (((low & _PLACE).astype(np.int64) - window) & int(_PLACE))
        edge = np.zeros(n + 1, np.int64)  # windows that lie inside one document
        long = np.flatnonzero(size >= length)
        edge[off[long]] += 1
        edge[off[long] + size[long] - length + 1] -= 1
        inside = np.cumsum(edge)[: len(low)] > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        first[off[long]] = True
        self.at = np.flatnonzero(first)
        last = np.cumsum(inside)
        ends = np.append(self.at[1:], len(low))
        self.n = last[ends - 1] - last[self.at] + 1
        self.doc = np.searchsorted(off, self.at, "right") - 1
        where = anchor[self.at]
        self.anchor = h[where]
        self.back = where - self.at
        self.content = mix(rolling.ranges(self.at, self.at + self.n - 1 + length) ^ mix(self.back.astype(np.uint64) << _U(32) | self.n.astype(np.uint64)))


class LogIndex:
    """Levels of sorted entries (two keys and an entry number) that merge when they are of one size class."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, k1: np.ndarray, k2: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Adds entries of a batch, whose keys are distinct and sorted, unless a level has their keys.

        Returns for each the entry number it was found under, or -1 if it is new.
        """
        found = np.full(len(k1), -1, np.int64)
        for a, b, e in self.levels:
            self._scan(a, b, e, k1, k2, found)
        new = found < 0
        if new.any():
            self.levels.append((k1[new], k2[new], entry[new]))
            while len(self.levels) > 1 and len(self.levels[-2][0]).bit_length() <= len(self.levels[-1][0]).bit_length():
                self._merge()
        return found

    @staticmethod
    def _scan(a: np.ndarray, b: np.ndarray, e: np.ndarray, k1: np.ndarray, k2: np.ndarray, found: np.ndarray) -> None:
        """Merge-scan: the level's entries with the first key, step by step to the second."""
        at, end = np.searchsorted(a, k1, "left"), np.searchsorted(a, k1, "right")
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = b[at[open_]] == k2[open_]
            found[open_[hit]] = e[at[open_[hit]]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[(at[open_] < end[open_]) & (b[np.minimum(at[open_], len(b) - 1)] <= k2[open_])]

    def _merge(self) -> None:
        (a1, b1, e1), (a2, b2, e2) = self.levels.pop(), self.levels.pop()
        a, b, e = np.concatenate([a1, a2]), np.concatenate([b1, b2]), np.concatenate([e1, e2])
        by = np.lexsort((b, a))
        self.levels.append((a[by], b[by], e[by]))


def merged(row: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, first, count) with those that touch or overlap joined."""
    by = np.lexsort((at, row))
    row, at, end = row[by], at[by], (at + n)[by]
    group = np.cumsum(np.append(True, row[1:] != row[:-1])) if len(row) else row
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40) if len(row) else end
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (at[1:] > reach[:-1])
    last = np.append(np.flatnonzero(first)[1:], len(row)) - 1
    return row[first], at[first], reach[last] - at[first]


#: kind 0: an entry of a task's index (many: found again in the task); kind 1: a run known to be covered.
ENTRIES = "kind int, anchor long, content long, row long, at int, n int, back int, many boolean"


def entries(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, text) -> index entries of each task, and the runs that a task itself finds again."""
    names = [f.split()[0] for f in ENTRIES.split(", ")]

    def batch_of(kind: int, anchor, content, row, at, n, back, many) -> pa.RecordBatch:
        kinds = np.full(len(row), kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(as_long(anchor)), pa.array(as_long(content)), pa.array(row), *[pa.array(x.astype(np.int32)) for x in (at, n, back)], pa.array(many)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, total = LogIndex(), [], 0
        many: list[np.ndarray] = []
        for part, data, off in text_batches(batches):
            r = Runs(data, off, length, gram)
            if not len(r.at):
                continue
            row = part.column("row").to_numpy(zero_copy_only=False)[r.doc]
            at = r.at - off[r.doc]
            by = np.lexsort((r.content, r.anchor))
            k1, k2 = r.anchor[by], r.content[by]
            head = np.ones(len(by), bool)
            head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            group = np.cumsum(head) - 1
            size = np.bincount(group)
            u1, u2, first = k1[head], k2[head], by[head]
            number = total + np.arange(len(u1))
            found = index.add(u1, u2, number)
            new = found < 0
            # every run found in a level, and every one but the first of its kind in the batch, is covered
            again = np.ones(len(by), bool)
            again[np.flatnonzero(head)[new]] = False
            some = by[again]
            if len(some):
                spans = merged(row[some], at[some], r.n[some])
                none = np.zeros(len(spans[0]), np.int64)
                yield batch_of(1, none, none, *spans, none, none == 0)
            one = first[new]
            held.append((number[new], u1[new], u2[new], row[one], at[one], r.n[one], r.back[one]))
            many += [number[new & (size > 1)], found[~new]]
            total += len(u1)
        if held:
            number, k1, k2, row, at, n, back = (np.concatenate(x) for x in zip(*held, strict=True))
            flag = np.zeros(total, bool)
            flag[np.concatenate(many)] = True
            for i in range(0, len(number), 100_000):
                s = slice(i, i + 100_000)
                yield batch_of(0, k1[s], k2[s], row[s], at[s], n[s], back[s], flag[number[s]])

    return docs.mapInArrow(run, ENTRIES)


CONTEXTS = "key long, row long, at int, n int, bytes binary"
SPANS = "row long, at int, n int"


def _context_rows(data: np.ndarray, off: np.ndarray, which: np.ndarray, reps: list, length: int) -> tuple[list, ...]:
    """For each run (anchor, at, n, back, hot) of each document: the bytes of its windows under the key that equal windows share."""
    rolling = None
    key, doc, at_, n_, raw = [], [], [], [], []
    for i, runs in zip(which, reps, strict=True):
        base = off[i]
        for r in runs:
            anchor, at, n, back = r["anchor"], r["at"], r["n"], r["back"]
            if not r["hot"]:
                key.append(anchor)
                doc.append(i)
                at_.append(at)
                n_.append(n)
                raw.append(data[base + at : base + at + n - 1 + length].tobytes())
                continue
            if rolling is None:
                rolling = Rolling(data)
            place = at + back
            # window s belongs to block (place - s) // BLOCK; all windows of block b share the bytes from
            # place - b * BLOCK to place - b * BLOCK - (BLOCK - 1) + length
            for b in range((back - n + 1) // BLOCK, back // BLOCK + 1):
                low, high = max(at, place - b * BLOCK - BLOCK + 1), min(at + n - 1, place - b * BLOCK)
                core = rolling.ranges(np.array([base + place - b * BLOCK]), np.array([base + place - b * BLOCK - BLOCK + 1 + length]))
                key.append(int(as_long(core)[0]))
                doc.append(i)
                at_.append(low)
                n_.append(high - low + 1)
                raw.append(data[base + low : base + high + length].tobytes())
    return key, doc, at_, n_, raw


def contexts(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Bytes of the runs that occur with other content around the same anchor elsewhere."""
    by_row = reps.groupBy("row").agg(F.collect_list(F.struct("anchor", "at", "n", "back", "hot")).alias("runs"))
    # equal rows have one id; their texts are equal, so either serves
    both = docs.join(by_row, "row").select("row", "text", "runs").dropDuplicates(["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_batches(batches):
            key, doc, at, n, raw = _context_rows(data, off, np.arange(part.num_rows), part.column("runs").to_pylist(), length)
            row = part.column("row").to_numpy(zero_copy_only=False)[np.array(doc, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(row), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], [f.split()[0] for f in CONTEXTS.split(", ")])

    return both.mapInArrow(run, CONTEXTS)


def matched_windows(ctx: DataFrame, length: int) -> DataFrame:
    """Spans of windows that are found twice or more among the contexts of a key: an index of levels in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, total = LogIndex(), [], 0
        many: list[np.ndarray] = []

        def spans(row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            row, at, n = merged(row, at, np.ones(len(at), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["row", "at", "n"])

        for part, data, off in text_batches(batches, "bytes"):
            n = part.column("n").to_numpy().astype(np.int64)
            first = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(first, n)
            start = np.repeat(off[:-1], n) + step
            row = np.repeat(part.column("row").to_numpy(), n)
            at = np.repeat(part.column("at").to_numpy().astype(np.int64), n) + step
            h = Rolling(data).ranges(start, start + length)
            key = np.repeat(part.column("key").to_numpy().view(np.uint64), n)
            by = np.lexsort((key, h))
            k1, k2 = h[by], key[by]
            head = np.ones(len(by), bool)
            head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            size = np.bincount(np.cumsum(head) - 1)
            u1, u2, one = k1[head], k2[head], by[head]
            number = total + np.arange(len(u1))
            found = index.add(u1, u2, number)
            new = found < 0
            again = np.ones(len(by), bool)
            again[np.flatnonzero(head)[new]] = False
            if again.any():
                yield spans(row[by[again]], at[by[again]])
            held.append((number[new], row[one[new]], at[one[new]]))
            many += [number[new & (size > 1)], found[~new]]
            total += len(u1)
        if held:
            number, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
            flag = np.zeros(total, bool)
            flag[np.concatenate(many)] = True
            some = flag[number]
            if some.any():
                yield spans(row[some], at[some])

    return ctx.repartition("key").mapInArrow(run, SPANS)


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, text) -> spans (row, at, n): windows at..at+n-1 of a row whose bytes also start elsewhere."""
    found, path = stored_at(entries(docs, length, gram))
    own = found.where("kind = 0")
    shared = own.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("c1"), F.max("content").alias("c2")).where("c > 1")
    met = stored(own.drop("kind").join(shared.select("anchor", (F.col("c1") != F.col("c2")).alias("differ")), "anchor"))
    spans = stored(found.where("kind = 1 or many").select("row", "at", "n"))
    discard(docs.sparkSession, path)  # what is needed of it is in the two tables
    kinds = stored(met.groupBy("anchor", "content").agg(F.count("*").alias("k"), F.min(F.struct("row", "at")).alias("rep")))
    whole = met.join(kinds.where("k > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").where("not many")
    contents = kinds.groupBy("anchor").agg(F.count("*").alias("nd")).where("nd > 1")
    reps = met.where("differ").join(kinds.select("anchor", "content", "rep"), ["anchor", "content"]).where("row = rep.row and at = rep.at")
    reps = reps.join(contents, "anchor").select("row", "anchor", "at", "n", "back", (F.col("nd") > HOT).alias("hot"))
    windows = stored(matched_windows(contexts(docs, reps, length), length))
    return spans.unionByName(whole.select("row", "at", "n")).unionByName(windows)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _covered(spans: list, length: int) -> list[tuple[int, int]]:
    """Byte intervals covered by spans of windows, joined where they touch."""
    out: list[list[int]] = []
    for at, n in sorted((s["at"], s["n"]) for s in spans):
        end = at + n - 1 + length
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def with_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the row id is doc_id where it identifies rows, else 64 bits that follow from doc_id and text, so each reading of the table gives the same."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    return docs.withColumn("row", F.xxhash64("doc_id", "text") if shared else F.col("doc_id"))


def suffix_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, hash of what is left (and with ``texts`` the bytes left)."""
    docs = with_row(docs)
    spans = repeated_windows(docs, length, gram).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    schema = RESULT + (", kept binary" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, kept = [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw = text.encode()
                    cuts = _covered(spans or [], length)
                    left = b"".join(raw[a:b] for a, b in zip([0, *(x[1] for x in cuts)], [*(x[0] for x in cuts), len(raw)], strict=True))
                    rows.append((len(raw), len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest()))
                    kept.append(left)
                n, m, k, sha = zip(*rows, strict=True)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(k, pa.int64()), pa.array(sha)] + ([pa.array(kept, pa.binary())] if texts else [])
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in schema.split(", ")])

    return docs.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(documents(spark, sf_dir))


def oracle_sql() -> str:
    """The contract by counting all windows, as hex digits of the bytes."""
    return """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 400) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
    s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY hash(k), k) AS c FROM w) WHERE c > 1),
    g AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS n FROM s)),
    r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
    p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
    t AS (SELECT p.doc_id, sum(b - a)::BIGINT AS gone, count(*) AS runs, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
    SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN t ON t.doc_id = d.doc_id
    """
