"""Line dedup: an exact set-similarity join of lines, which removes later matches.

A line is the set of its distinct words (A-Z lower-cased). Lines are in order of (doc_id,
line number); a line with a word goes when an earlier line of any document, removed or not,
has a Jaccard similarity of 0.8 or more with it.

Tokens are ordered by rarity: their count over the whole corpus in a sketch of
``2 ** SKETCH_BITS`` counters, by powers of two and their parts, then their hash. Any order that all lines share
makes the prefix filter exact, so the collisions of the sketch cost speed only, and its size
does not grow with the data. A task keeps the first of equal lines and sends a posting for
each token of a line's prefix that was counted twice or more; lines so small that only an
equal one reaches the similarity (one to three words at 0.8) send one for their whole set.
Postings travel packed, as columns of bytes for each bucket of tokens, so that the shuffle
has a row for thousands of them.

A token in more than ``HOT`` lines is not a key by itself: a line sends it with each token
that can be the second common one, which the same prefix argument bounds. If even those are
many, the postings of a key are cut into slices and each two slices meet in a task of their own.

Where its postings meet, a line is paired with the earliest lines that pass the length,
positional and parity filters (128 parity bits bound the difference of two sets). Pairs are
verified on whole token sets. Lines that none of these matches and that have further
candidates come again with the next ones (``TURNS``), the last time with all, so groups of
near copies do not form all pairs, and nothing is left out. A turn keeps the postings of the
keys that have such lines for the next one, so texts are cut into words once.

Defined results: null text has 0 lines, stays null, and hashes as the empty string; empty
lines and lines without words stay; repeated documents lose the lines that the first
has; with equal doc_ids, rows share the fate of each line number; rows whose doc_id is null
have no place in the order, and stay as they are; extra columns are dropped
by ``line_report`` and kept by ``without_later_lines``, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import LOWER_AZ, as_long, documents, fresh, mix, runs_of, small_batches, stored, text_batches, word_hashes, word_spans

SKETCH_BITS = 22
#: Counters are sent in a part for each shuffle partition, as a power of two in these bounds.
PARTS = (16, 1024)
#: Counts above this are as good as it.
MOST_COUNT = (1 << 32) - 1
#: Tokens in more lines are joined with a second one; keys in more are cut into slices of so many.
HOT = 1 << 16
SLICE = 1 << 20
#: Candidates of a line, earliest first, that are verified by each turn; the last turn takes all.
TURNS = (8, None)
#: Postings that a task holds before it sends them, those of a packed row, and those meant for a task that joins.
HELD = 1 << 18
PACKED = 1 << 11
MET = 300_000
#: Pairs looked at together.
PAIRS = 1 << 18
#: Bits of the filters that tell the lines and keys of a later turn.
FILTER_BITS = 22
#: Similarity as a ratio of whole numbers.
NUM, DEN = 80, 100

_LOWER = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())

_U = np.uint64


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of a batch, and its document, line of the batch and number of the line in its document."""
    data = LOWER_AZ[data]
    starts, ends, doc = word_spans(data, off)
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, starts)
    # a line of the batch: a new one begins at a line break or at a document
    return word_hashes(data, starts, ends), doc, number + doc, number - np.searchsorted(breaks, off[:-1])[doc]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SKETCH_BITS)).astype(np.int64)


def token_counts(docs: DataFrame) -> np.ndarray:
    """How often the tokens of each sketch counter occur, over all documents; 2 ** SKETCH_BITS numbers."""
    size = 1 << SKETCH_BITS
    parts = min(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS[0]), PARTS[1])
    parts = 1 << parts.bit_length() - 1
    part = size // parts
    names = ["part", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n_held = np.zeros(size, np.int64), [], 0
        for _, data, off in text_batches(batches):
            data = LOWER_AZ[data]
            starts, ends, _ = word_spans(data, off)
            held.append(_counter(word_hashes(data, starts, ends)))
            n_held += len(starts)
            if n_held > size // 4:
                total += np.bincount(np.concatenate(held), minlength=size)
                held, n_held = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        for k in range(parts):
            some = np.flatnonzero(total[k * part : (k + 1) * part])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(some.astype(np.int32))]), pa.array([pack(total[k * part + some])])], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                totals.setdefault(k, np.zeros(part, np.int64))[unpack(at, np.int32)] += unpack(n, np.int64)
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b""]), pa.array([pack(np.minimum(total, MOST_COUNT).astype(np.uint32))])], names)

    schema = "part int, at binary, n binary"
    out = np.zeros(size, np.uint32)
    for row in docs.select("text").mapInArrow(run, schema).repartition(parts, "part").mapInArrow(add, schema).select("part", "n").collect():  # rows of fixed size
        out[row["part"] * part : (row["part"] + 1) * part] = unpack(bytes(row["n"]), np.uint32)
    return out


# ---------------------------------------------------------------- packed columns


def pack(x: np.ndarray) -> bytes:
    """A column as its bytes by place (all first bytes, all second ones ...), so that small numbers compress to little."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


#: A posting: key, tokens of the line, place of the token in it, 64 parity bits twice, 32 bits of the set's hash, doc_id, line number.
POSTING = {"key": np.uint32, "n": np.int32, "pos": np.int32, "p1": np.uint64, "p2": np.uint64, "s": np.uint32, "d": np.int64, "l": np.int32}
_WIDTH = sum(np.dtype(t).itemsize for t in POSTING.values())


def pack_postings(cols: dict[str, np.ndarray]) -> bytes:
    return b"".join(pack(cols[c].astype(t, copy=False)) for c, t in POSTING.items())


def unpack_postings(b: bytes) -> dict[str, np.ndarray]:
    k, at, out = len(b) // _WIDTH, 0, {}
    for c, t in POSTING.items():
        size = np.dtype(t).itemsize * k
        out[c] = unpack(b[at : at + size], t)
        at += size
    return out


# ---------------------------------------------------------------- postings


def _prefixes(words: tuple[np.ndarray, ...], ids: np.ndarray, counts: np.ndarray, num: int, den: int, most: int, per_slice: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Lines of a batch (n, p1, p2, s1, s2, d, l), and their postings by line (line, key as 64 bits, pos, slices)."""
    h, doc, line, number = words
    row = np.cumsum(np.concatenate([[False], line[1:] != line[:-1]])) if len(line) else line
    # by line, rarity (16 steps for each doubling of the count) and hash; equal tokens stand together
    rarity = np.minimum(16 * np.log2(np.maximum(counts[_counter(h)], 1)), 1023).astype(np.uint64)
    bits = _U(max(1, int(row[-1]).bit_length() if len(row) else 1))
    short = row.astype(np.uint64) << (_U(64) - bits) | rarity << (_U(54) - bits) | h >> (_U(10) + bits)
    by = np.argsort(short)
    short, sorted_h = short[by], h[by]
    if ((short[1:] == short[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
        by = np.lexsort((h, rarity, row))
        sorted_h = h[by]
    row, doc, number, h = row[by], doc[by], number[by], sorted_h
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, doc, number, h = row[keep], doc[keep], number[keep], h[keep]
    at, n = runs_of(row)
    if not len(at):
        none = np.zeros(0, np.int64)
        return {c: none.astype(t) for c, t in POSTING.items()} | {"s1": none.astype(np.uint64), "s2": none.astype(np.uint64)}, {c: none for c in ("line", "pos", "slices")} | {"key": none.astype(np.uint64)}
    half, bit = (h >> _U(6)) & _U(1) == 0, _U(1) << (h & _U(63))
    s1, s2 = np.add.reduceat(mix(h), at), np.bitwise_xor.reduceat(mix(h + _U(0x632BE59BD9B4E019)), at)
    lines = {"n": n, "s1": s1, "s2": s2, "s": (s2 >> _U(32)).astype(np.uint32), "d": ids[doc[at]], "l": number[at]}
    lines |= {"p1": np.bitwise_xor.reduceat(np.where(half, bit, _U(0)), at), "p2": np.bitwise_xor.reduceat(np.where(half, _U(0), bit), at)}
    count = counts[_counter(h)].astype(np.int64)
    pos = np.arange(len(h)) - np.repeat(at, n)
    need = -(-num * n // den)  # common tokens with any line that reaches the similarity, at least
    alone = n * den < num * (n + 1)  # the nearest other set has one token more: n of n + 1
    seen = np.minimum.reduceat(count, at) > 1
    of, key, where, times = [], [], [], []
    whole = np.flatnonzero(alone & seen)
    of.append(whole), key.append(mix(s1[whole] ^ _U(0x2545F4914F6CDD1D))), where.append(np.zeros(len(whole), np.int64)), times.append(np.minimum.reduceat(count, at)[whole])
    line = np.arange(len(at))[np.repeat(np.arange(len(at)), n)]
    sent = (pos < (n - need + 1)[line]) & ~alone[line] & (count > 1)
    hot = sent & (count > most)
    single = np.flatnonzero(sent & (~hot | (need < 2)[line]))
    of.append(line[single]), key.append(h[single]), where.append(pos[single]), times.append(count[single])
    # with a hot token, each token after it that may be the second common one: one more than the prefix
    first = np.flatnonzero(hot)
    if len(first):
        many = np.maximum((n - need + 2)[line[first]] - pos[first] - 1, 0)
        many = np.minimum(many, n[line[first]] - pos[first] - 1)
        left = np.repeat(first, many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        good = count[right] > 1
        left, right = left[good], right[good]
        of.append(line[left]), key.append(mix(h[left] * _U(0x9E3779B97F4A7C15) + h[right])), where.append(pos[left]), times.append(np.minimum(count[left], count[right]))
    slices = -(-np.concatenate(times) // per_slice)
    return lines, {"line": np.concatenate(of), "key": np.concatenate(key), "pos": np.concatenate(where), "slices": np.maximum(slices, 1)}


def _sliced(posts: dict[str, np.ndarray], lines: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Postings of keys with several slices go to a key for each other slice, together with the postings of that."""
    many = posts["slices"]
    if not (many > 1).any():
        return posts
    out = {c: np.repeat(v, many) for c, v in posts.items()}
    other = np.arange(len(out["line"])) - np.repeat(np.cumsum(many) - many, many)
    own = (mix(lines["d"][out["line"]].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + lines["l"][out["line"]].astype(np.uint64)) % out["slices"].astype(np.uint64)).astype(np.int64)
    block = np.minimum(own, other) * out["slices"] + np.maximum(own, other) + 1
    out["key"] = np.where(out["slices"] > 1, mix(out["key"] + block.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), out["key"])
    return out


def first_of_equal(lines: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of lines with equal sets, the first by (d, l) is kept; the others that stand elsewhere are gone. Returns both as masks."""
    by = np.lexsort((lines["l"], lines["d"], lines["s2"], lines["s1"], lines["n"]))
    v = {c: lines[c][by] for c in ("n", "s1", "s2", "d", "l")}
    new = np.ones(len(by), bool)
    new[1:] = (v["n"][1:] != v["n"][:-1]) | (v["s1"][1:] != v["s1"][:-1]) | (v["s2"][1:] != v["s2"][:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    elsewhere = (v["d"] != v["d"][head]) | (v["l"] != v["l"][head])
    first, gone = np.zeros(len(by), bool), np.zeros(len(by), bool)
    first[by], gone[by] = new, elsewhere
    return first, gone


SENT = "bucket int, gone boolean, posts binary"


def _rows(cols: dict[str, np.ndarray], buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """Postings as packed rows (bucket, gone, posts), in order of buckets and keys."""
    key = cols["key"]
    bucket = (mix(key.astype(np.uint64)) % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket << 32 | key.astype(np.int64))
    at, n = runs_of(bucket[by])
    for a, k in zip(at, n, strict=True):
        for b in range(a, a + k, PACKED):
            part = by[b : min(b + PACKED, a + k)]
            yield int(bucket[by[a]]), False, pack_postings({c: cols[c][part] for c in POSTING})


def postings(docs: DataFrame, counts: np.ndarray, buckets: int, num: int, den: int) -> DataFrame:
    """Packed postings by bucket of their keys, and packed lines that are gone as an earlier one of the task equals them."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def send(held: list[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *[len(x["n"]) for x, _ in held]])
        lines = {c: np.concatenate([x[c] for x, _ in held]) for c in held[0][0]}
        posts = {c: np.concatenate([p[c] + base[i] if c == "line" else p[c] for i, (_, p) in enumerate(held)]) for c in held[0][1]}
        first, gone = first_of_equal(lines)
        posts = {c: v[first[posts["line"]]] for c, v in posts.items()}
        posts = _sliced(posts, lines)
        out = {c: lines[c][posts["line"]] for c in ("n", "p1", "p2", "s", "d", "l")} | {"pos": posts["pos"], "key": (posts["key"] >> _U(32)).astype(np.uint32)}
        rows = list(_rows(out, buckets))
        lost = np.flatnonzero(gone)
        for b in range(0, len(lost), PACKED):
            part = lost[b : b + PACKED]
            zero = np.zeros(len(part), np.int64)
            rows.append((int(mix(np.array([lines["d"][part[0]]]).view(np.uint64))[0] % _U(buckets)), True, pack_postings({c: zero for c in POSTING} | {"d": lines["d"][part], "l": lines["l"][part]})))
        for b in range(0, len(rows), 64):
            cols = zip(*rows[b : b + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "gone", "posts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        held, n_held = [], 0
        for part, data, off in text_batches(batches):
            held.append(_prefixes(_words(data, off), part.column("doc_id").to_numpy(zero_copy_only=False), counts, num, den, HOT, SLICE))
            n_held += len(held[-1][1]["line"]) + len(held[-1][0]["n"])
            if n_held > HELD:
                yield from send(held)
                held, n_held = [], 0
        if held:
            yield from send(held)

    return docs.mapInArrow(run, SENT)


# ---------------------------------------------------------------- pairs


def _possible(x: dict[str, np.ndarray], y: dict[str, np.ndarray], num: int, den: int) -> np.ndarray:
    """Filters that no pair of the similarity fails, for lines that share a token.

    Length; position (the tokens before and after a common one bound the overlap, and the
    first common one is in the index prefix of the shorter line); and parity (a token that
    only one line has flips one of 128 bits, so the lines differ in as many tokens as bits).
    """
    both = x["n"] + y["n"]
    low, high = np.minimum(x["n"], y["n"]), np.maximum(x["n"], y["n"])
    good = low * den >= high * num
    bound = np.minimum(x["pos"], y["pos"]) + 1 + np.minimum(x["n"] - x["pos"], y["n"] - y["pos"]) - 1
    good &= bound * (den + num) >= both * num
    short = np.where(x["n"] <= y["n"], x["pos"], y["pos"])
    good &= short <= low - -(-2 * num * low // (den + num))
    left = np.flatnonzero(good)
    flips = np.bitwise_count(x["p1"][left] ^ y["p1"][left]).astype(np.int64) + np.bitwise_count(x["p2"][left] ^ y["p2"][left])
    good[left] = flips * (den + num) <= both[left] * (den - num)
    return good


def pairs_of(posts: dict[str, np.ndarray], low: int, high: int | None, num: int, den: int, only: np.ndarray | None = None, most: int = PAIRS) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Of all postings of some keys: (0, lines that are gone as an earlier one equals them), (1, pairs), (2, lines with further candidates and the key), (3, all postings of such keys).

    A line's candidates of one key are numbered from the earliest; those from ``low`` to
    before ``high`` come as pairs. ``only`` is a filter of lines.
    """
    by = np.lexsort((posts["l"], posts["d"], posts["key"]))
    v = {c: x[by] for c, x in posts.items()}
    # equal sets under a key: the first stays
    whole = mix(mix(mix(mix(v["p1"]) + v["p2"]) + v["n"].astype(np.uint64)) + (v["key"].astype(np.uint64) << _U(32) | v["s"]))
    same = np.argsort(whole, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([v[c][same[1:]] != v[c][same[:-1]] for c in ("key", "s", "n", "p1", "p2")])
    head = np.empty(len(by), np.int64)
    head[same] = same[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(by) else same
    later = (v["d"] != v["d"][head]) | (v["l"] != v["l"][head])
    if only is None and later.any():
        yield 0, {c: v[c][later] for c in ("d", "l")}
    # a line may have two tokens of one key, at two places
    v = {c: x[~later] for c, x in v.items()}
    at, n = runs_of(v["key"])
    before = np.arange(len(v["key"])) - np.repeat(at, n)
    if only is not None:
        mine = only[_line_bits(v["d"], v["l"])]
        ys = np.flatnonzero(mine & (before > 0))
    else:
        ys = np.flatnonzero(before > 0)
    ends = np.cumsum(before[ys])
    again = np.zeros(len(n), bool)
    a = 0
    while a < len(ys):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        part, m = ys[a:b], before[ys[a:b]]
        y = np.repeat(part, m)
        x = np.repeat(part - m, m) + np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m)
        fit = (v["n"][x] * den >= v["n"][y] * num) & (v["n"][y] * den >= v["n"][x] * num) & ((v["d"][x] != v["d"][y]) | (v["l"][x] != v["l"][y]))
        x, y = x[fit], y[fit]
        fields = ("n", "pos", "p1", "p2")
        good = _possible({c: v[c][x] for c in fields}, {c: v[c][y] for c in fields}, num, den)
        x, y = x[good], y[good]
        first, k = runs_of(y)
        rank = np.arange(len(y)) - np.repeat(first, k)
        take = (rank >= low) & (rank < (high if high is not None else len(y) + 1))
        if take.any():
            yield 1, {"xd": v["d"][x[take]], "xl": v["l"][x[take]], "d": v["d"][y[take]], "l": v["l"][y[take]]}
        more = y[first[k > high]] if high is not None and len(first) else y[:0]
        if len(more):
            yield 2, {"d": v["d"][more], "l": v["l"][more], "xl": _key_bits(v["key"][more]).astype(np.int32)}
            again[np.searchsorted(at, more, "right") - 1] = True
        a = b
    if again.any():
        kept = np.repeat(again, n)
        yield 3, {c: x[kept] for c, x in v.items()}


def _key_bits(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint32(32 - FILTER_BITS)).astype(np.int64)


def _line_bits(d: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(d.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + line.astype(np.uint64)) >> _U(64 - FILTER_BITS)).astype(np.int64)


FOUND = "kind int, d long, l int, xd long, xl int, posts binary"


def candidates(sent: DataFrame, tasks: int, buckets: int, low: int, high: int | None, num: int, den: int, only: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """What ``pairs_of`` finds in each bucket: kind 0, 1 or 2 with the later line (d, l) and the earlier (xd, xl); kind 3 with packed postings and their bucket as l. ``only`` are filters of keys and lines."""
    shared = sent.sparkSession.sparkContext.broadcast(only)
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines = shared.value or (None, None)
        held: list[dict[str, np.ndarray]] = []

        def out(kind: int, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
            k = len(cols["d"])
            zero = np.zeros(k, np.int64)
            arrays = [np.full(k, kind, np.int32), cols["d"], cols["l"].astype(np.int32), cols.get("xd", zero), cols.get("xl", zero).astype(np.int32)]
            return pa.RecordBatch.from_arrays([*[pa.array(x) for x in arrays], pa.nulls(k, pa.binary())], names)

        for batch in batches:
            for gone, posts in zip(batch.column("gone").to_pylist(), batch.column("posts"), strict=True):
                x = unpack_postings(posts.as_py())
                if gone:
                    yield out(0, x)
                    continue
                if keys is not None:
                    mine = keys[_key_bits(x["key"])]
                    x = {c: v[mine] for c, v in x.items()}
                held.append(x)
        if held:
            whole = {c: np.concatenate([x[c] for x in held]) for c in POSTING}
            held.clear()
            for kind, cols in pairs_of(whole, low, high, num, den, lines, PAIRS):
                if kind < 3:
                    yield out(kind, cols)
                    continue
                for bucket, _, posts in _rows(cols, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((3, pa.int32()), (0, pa.int64()), (bucket, pa.int32()), (0, pa.int64()), (0, pa.int32()), (posts, pa.binary()))], names)

    return sent.repartition(tasks, "bucket").mapInArrow(run, FOUND)


def _bitmap(bits: DataFrame) -> np.ndarray:
    """A filter of 2 ** FILTER_BITS bits from a column of them, whose distinct values are as many at most."""
    out = np.zeros(1 << FILTER_BITS, bool)
    out[bits.distinct().toArrow().column(0).to_numpy()] = True
    return out


def _words_of(line: bytes) -> frozenset[bytes]:
    return frozenset(line.translate(_LOWER).split())


def _verify(pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (xd, xl, yd, yl) whose lines reach the similarity, on their whole token sets."""
    need = pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select(F.col("yd").alias("d"), F.col("yl").alias("l")))
    wanted = need.groupBy(F.col("d").alias("doc_id")).agg(F.collect_set("l").alias("_want"))
    texts = docs.join(wanted, "doc_id").withColumn("_lines", F.split("text", "\n"))
    # of rows with equal doc_ids, the first line by order of bytes stands for a line number
    texts = texts.select(F.col("doc_id").alias("d"), F.explode(F.transform("_want", lambda i: F.struct(i.alias("l"), F.get("_lines", i).alias("t")))).alias("x")).groupBy("d", "x.l").agg(F.min("x.t").alias("t"))
    texts = stored(texts)
    x = texts.select(F.col("d").alias("xd"), F.col("l").alias("xl"), F.col("t").alias("tx"))
    y = texts.select(F.col("d").alias("yd"), F.col("l").alias("yl"), F.col("t").alias("ty"))
    both = pairs.join(y, ["yd", "yl"]).join(x, ["xd", "xl"]).select("xd", "xl", "yd", "yl", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sx = None, frozenset()
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            good = []
            for tx, ty in zip(*[batch.column(c).cast(pa.binary()).to_pylist() for c in ("tx", "ty")], strict=True):
                if tx != last:  # pairs of a line stand together
                    last, sx = tx, _words_of(tx)
                sy = _words_of(ty)
                good.append(len(sx & sy) * (den + num) >= (len(sx) + len(sy)) * num)
            yield batch.select(["xd", "xl", "yd", "yl"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "xd long, xl int, yd long, yl int")


def gone_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(d, l): the lines that an earlier line matches."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        counts = token_counts(docs)
        # a line sends about a fifth of its tokens, each of which was counted
        tasks = max(8, -(-int(counts.sum()) // (5 * MET)))
        gone, low, only, sent = None, 0, None, postings(docs, counts, 4 * tasks, num, den)
        for high in TURNS:
            found = stored(candidates(sent, tasks, 4 * tasks, low, high, num, den, only))
            equal = found.where("kind = 0").select("d", "l").distinct()
            pairs = found.where("kind = 1").select("xd", "xl", F.col("d").alias("yd"), F.col("l").alias("yl")).distinct()
            if low == 0:  # those that are gone anyway need no look
                pairs = pairs.join(equal.select(F.col("d").alias("yd"), F.col("l").alias("yl")), ["yd", "yl"], "left_anti")
            match = _verify(stored(pairs), docs, num, den).select(F.col("yd").alias("d"), F.col("yl").alias("l")).distinct()
            gone = stored(equal.union(match) if gone is None else gone.union(match))
            still = stored(found.where("kind = 2").select("d", "l", "xl").distinct().join(gone, ["d", "l"], "left_anti"))
            if high is None or still.limit(1).count() == 0:
                return gone.distinct()

            def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(_line_bits(b.column("d").to_numpy(), b.column("l").to_numpy()))], ["bit"])

            only, low = (_bitmap(still.select("xl")), _bitmap(still.mapInArrow(bits, "bit long"))), high
            sent = found.where("kind = 3").select(F.col("l").alias("bucket"), F.lit(False).alias("gone"), "posts")
    raise AssertionError("the last turn takes all candidates")


def _apply(docs: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """``docs`` with an array ``name`` of the numbers of their lines that go (null: none)."""
    key = fresh([*docs.columns, name], "_d")
    gone = gone_lines(docs, num, den).groupBy(F.col("d").alias(key)).agg(F.collect_set("l").alias(name))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left").drop(key)


def _cut(text: str, gone: list[int] | None) -> tuple[bytes, int, int]:
    """The text without the lines that go, how many lines it had and how many went."""
    lines = text.encode().split(b"\n")
    lost = set(gone or ())
    left = [x for i, x in enumerate(lines) if i not in lost or not x.split()]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def line_report(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per document: lines, lines removed, and the hash of the text that is left."""

    def report(text: str | None, gone: list[int] | None) -> tuple[int, int, str] | None:
        if text is None:
            return None
        cut, n, m = _cut(text, gone)
        return n, m, hashlib.sha256(cut).hexdigest()

    docs = _apply(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), num, den, "gone")
    cut = F.udf(report, "n long, m long, sha string", useArrow=False).asNondeterministic()
    text = F.coalesce("text", F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    docs = docs.select("doc_id", "text", cut(F.when(F.col("gone").isNotNull(), F.col("text")), "gone").alias("cut"))
    return docs.select(
        "doc_id",
        F.coalesce("cut.n", F.when(F.col("text").isNull(), 0).otherwise(breaks).cast("long")).alias("n_lines"),
        F.coalesce("cut.m", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut.sha", F.sha2(text, 256)).alias("kept_sha256"),
    )


def remnant(text: str, gone: list[int] | None, least: float) -> bool:
    """Whether a cut leaves no word, or less than ``least`` of the words that count.

    The words of kept lines count, and those of cut lines, each set of words once and not if a
    kept line has it: lines that a text repeats itself do not make what is left a remnant.
    """
    lost = set(gone or ())
    kept, cut, sets = 0, {}, set()
    for i, line in enumerate(text.encode().split(b"\n")):
        words = line.translate(_LOWER).split()
        if i in lost:
            cut[frozenset(words)] = len(words)
        elif words:
            kept += len(words)
            sets.add(frozenset(words))
    return bool(cut) and kept <= least * (kept + sum(n for x, n in cut.items() if x not in sets))


def without_later_lines(docs: DataFrame, num: int = NUM, den: int = DEN, least: float = 0.0) -> DataFrame:
    """The documents with their later matching lines cut; remnants go: those that lose their last word by it, or keep no more than ``least`` of their words (see ``remnant``).

    Columns are those of ``docs``; n_chars, if there, is that of the new text.
    """
    columns, name = docs.columns, fresh(docs.columns, "_gone")
    cut = fresh([*columns, name], "_cut")

    def run(text: str | None, gone: list[int] | None) -> tuple[str, bool] | None:
        if text is None:
            return None
        left, _, lost = _cut(text, gone)
        return (left.decode(), not remnant(text, gone, least)) if lost else None

    # plain rows, not Arrow: a hundred documents at a time go to Python, whenever the result is read, and only those with lines that go
    cut_text = F.udf(run, "text string, good boolean", useArrow=False).asNondeterministic()
    out = _apply(docs, num, den, name).withColumn(cut, cut_text(F.when(F.col(name).isNotNull(), F.col("text")), name))
    out = out.where(F.coalesce(F.col(cut)["good"], F.lit(True)))
    out = out.withColumn("text", F.coalesce(F.col(cut)["text"], F.col("text")).cast(docs.schema["text"].dataType)).drop(cut, name)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def oracle_sql() -> str:
    """The definition by a join of all lines that share a word."""
    return r"""
    WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
    t AS (SELECT *, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS ws FROM l),
    k AS (SELECT *, len(ws) AS n, row_number() OVER (ORDER BY doc_id, no) AS id FROM t),
    u AS (SELECT id, n, unnest(ws) AS w FROM k WHERE n >= 1),
    p AS (SELECT y.id, y.n AS ny, x.n AS nx, count(*) AS i FROM u x JOIN u y ON x.w = y.w AND x.id < y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY x.id, y.id, x.n, y.n),
    g AS (SELECT DISTINCT id FROM p WHERE 180 * i >= 80 * (nx + ny))
    SELECT k.doc_id, count(*) AS n_lines, count(g.id) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.id IS NULL THEN line END, chr(10) ORDER BY no), '')) AS kept_sha256
    FROM k LEFT JOIN g ON g.id = k.id GROUP BY k.doc_id
    """
