"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenated raw bytes.

Pre-tokenising is a chain of matches, each of which begins where the last one ended, so a
text can be cut at any place as long as the chains meet again. A long text is cut into
chunks that overlap; each chunk is pre-tokenised by its own task from its own start; chunks
are stitched at the first boundary in the overlap that both neighbours have, as from there
on both chains are the same. The last two boundaries of a chunk are not used, as their
matches might have gone on or looked further in the whole text. Where no boundary
is shared within an overlap, the chain goes on from the left chunk's last sure boundary
until it meets the right chunk's, so the result never depends on the cuts. Pieces are
encoded on their own by merge ranks, by the task of their chunk; the task that stitches
takes the ids of the pieces that stand, and encodes only those that no chunk has.

Between the two goes no matched text and no boundary: ids decode to the text they were made of, and
the characters of a piece's ids tell where it ends. Ids and their number in each piece are
sent as bytes of the least width that holds them.

Texts of one chunk are encoded where they are read; only longer ones are dealt out by chunk
and brought together by document (a document is one row of the input, so that is bounded).
All steps are linear in a text's length.

Defined results: a null or empty text has no tokens and the hash of the empty string;
repeated rows are encoded one by one; special-token strings are ordinary text; unpaired
surrogates cannot occur in a UTF-8 column; extra columns are dropped; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents

#: Code points of a chunk and of the overlap of two.
CHUNK = 16_384
OVERLAP = 512
#: Pieces whose ids a worker remembers.
MEMORY = 400_000
#: The bytes that go on with a character of UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))


class Tokenizer:
    """Ranks and pattern of a vocabulary, and a bounded memory of encoded pieces."""

    def __init__(self, path: str, pattern: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.find = regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall
        self.match = regex.compile(pattern).search
        self.raw = {rank: token for token, rank in ranks.items()}
        self.chars = np.zeros(max(ranks.values(), default=0) + 1, np.int64)  # characters that begin in each token
        for token, rank in ranks.items():
            self.chars[rank] = len(token.translate(None, CONTINUED))
        # the merges themselves; the pattern takes any piece whole, as pieces come pre-tokenised
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            ids = self.known[piece] = tuple(self.merge(piece))
        return ids

    def encode(self, pieces: list[str]) -> list[int]:
        known, piece = self.known, self.piece
        out: list[int] = []
        add = out.extend
        for p in pieces:
            ids = known.get(p)
            add(piece(p) if ids is None else ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each worker process and vocabulary."""
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = Tokenizer(path, pattern)
    return _TOKENIZERS[path, pattern]


def pack(numbers: list[int]) -> bytes:
    """Whole numbers from 0 to 2^32 - 1 in 1, 2 or 4 bytes each, after a byte that tells which."""
    a = np.array(numbers, np.uint32)
    width = np.min_scalar_type(a.max(initial=0)).itemsize
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def boundaries(t: Tokenizer, text: str, at: int = 0) -> list[int]:
    """Where the matches of ``text`` from ``at`` on end."""
    return [m.end() for m in t.find(text, at)]


def stitch(t: Tokenizer, text: str, starts: list[int], ends: list[list[int]]) -> list[int]:
    """The boundaries of the whole text from those of its chunks.

    ``starts`` ascend from 0; ``ends[i]`` are absolute, and all but its last two are sure to be
    matches of the chain that begins at starts[i] (all, in the last chunk).
    """
    sure = [e if i == len(ends) - 1 else e[:-2] for i, e in enumerate(ends)]
    out = list(sure[0])
    for i in range(1, len(sure)):
        right = {starts[i], *sure[i]}
        meet = next((x for x in islice(out, bisect_left(out, starts[i]), None) if x in right), None)
        if meet is None:  # the left chain goes on over the whole text until it meets the right one
            at = out[-1] if out else 0
            while at < len(text) and at not in right:
                at = t.match(text, at).end()
                out.append(at)
            meet = at
        del out[bisect_right(out, meet) :]
        out += sure[i][bisect_right(sure[i], meet) :]
    return out


def assemble(t: Tokenizer, text: str, starts: list[int], ends: list[list[int]], counts: list[list[int]], ids: list[list[int]]) -> list[int]:
    """Ids of the whole text from those of its chunks' pieces (``counts`` of each piece)."""
    pieces = []  # for each chunk, start of a piece -> (its end, where its ids begin and end)
    for start, e, n in zip(starts, ends, counts, strict=True):
        at = list(accumulate(n, initial=0))
        pieces.append(dict(zip([start, *e], zip(e, at, at[1:], strict=False), strict=False)))
    out: list[int] = []
    a = 0
    for b in stitch(t, text, starts, ends):
        i = bisect_right(starts, a) - 1
        for k in (i, i - 1):
            found = pieces[k].get(a) if k >= 0 else None
            if found is not None and found[0] == b:
                out += ids[k][found[1] : found[2]]
                break
        else:
            out += t.piece(text[a:b])
        a = b
    return out


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>"


def _digest(t: Tokenizer, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()


def _rows(doc_ids: list, ids: list[list[int]], t: Tokenizer, digests: bool) -> pa.RecordBatch:
    if not digests:
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    rows = [_digest(t, x) for x in ids]
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], [f.split()[0] for f in RESULT.split(", ")])


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids), or with ``digests`` the count and hashes of ids and decoded bytes."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = RESULT if digests else IDS
    length = F.char_length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _rows(part.column("doc_id").to_pylist(), [t.encode(t.findall(x)) for x in part.column("text").to_pylist()], t, digests)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each chunk; each text is walked once."""
        for batch in batches:
            for row, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "text")], strict=True):
                starts = list(range(0, (len(text) - overlap - 1) // step * step + 1, step))
                for i in range(0, len(starts), 64):
                    some = starts[i : i + 64]
                    cols = [pa.array([row] * len(some), pa.int64()), pa.array([doc_id] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([text[x : x + chunk] for x in some])]
                    yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "start", "text"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            counts, ids, rest = [], [], []
            for text in batch.column("text").to_pylist():
                own = boundaries(t, text)
                of = [t.piece(text[a:b]) for a, b in zip([0, *own], own, strict=False)]
                counts.append(pack([len(x) for x in of]))
                ids.append(pack([i for x in of for i in x]))
                rest.append(text[own[-1] if own else 0 :])
            cols = [*[batch.column(c) for c in ("row", "doc_id", "start")], pa.array(counts, pa.binary()), pa.array(ids, pa.binary()), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "start", "counts", "ids", "rest"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        t = tokenizer(path, pattern)
        rows = rows.sort_values("start")
        starts, texts, ends, counts, ids = rows["start"].tolist(), [], [], [], []
        for start, n, tokens, rest in zip(starts, map(unpack, rows["counts"]), map(unpack, rows["ids"]), rows["rest"], strict=True):
            at = np.concatenate([[start], start + np.cumsum(t.chars[tokens])])
            ends.append(at[np.cumsum(n, dtype=np.int64)].tolist())
            counts.append(n.tolist())
            ids.append(tokens.tolist())
            texts.append(t.decode(ids[-1]).decode() + rest)
        whole = "".join(x[: b - a] for a, b, x in zip(starts, starts[1:], texts, strict=False)) + texts[-1]
        ids = assemble(t, whole, starts, ends, counts, ids)
        doc_id = rows["doc_id"].iloc[0]
        return _rows([None if pd.isna(doc_id) else int(doc_id)], [ids], t, digests).to_pandas()

    brief = docs.where(length <= chunk).mapInArrow(short, schema)
    step = chunk - overlap
    long = docs.where(length > chunk).withColumn("row", F.monotonically_increasing_id())
    long = long.select("row", "doc_id", "text").mapInArrow(deal, "row long, doc_id long, start int, text string")
    long = long.repartition("row", "start").mapInArrow(chunks, "row long, doc_id long, start int, counts binary, ids binary, rest string")
    return brief.unionByName(long.groupBy("row").applyInPandas(join, schema))


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes): the raw bytes of the tokens, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir) if docs is None else docs
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
