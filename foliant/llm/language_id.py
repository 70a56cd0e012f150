"""Language ID: interpolated Kneser-Ney character models, one per language.

Models are fitted on a bounded sample of labelled rows: for each of the ``MAX_LANGUAGES``
commonest languages, ``SAMPLE_DOCS`` documents on average and no more characters than its
part of ``SAMPLE_CHARS``, chosen by a hash of doc_id among those of ``SAMPLE_LENGTH``
characters or less. All n-grams of the sample count. n-gram counts are gathered with Spark, each
language's model is built in a task of its own from its (bounded) counts, and the models are
broadcast as sorted hash arrays: for each order, hashes of n-grams with their interpolated
log probability, and hashes of contexts with their log back-off weight. A document goes to
the language with the lowest cross-entropy per character; its score is the softmax of the
cross-entropies over up to ``SCORE_CHARS`` characters.

Rejection is calibrated on a fifth of the sample, which the models are not fitted on: for
each power of two up to ``LONGEST``, windows of so many characters of these texts are scored,
and ``MARGIN`` times the 0.999 quantile of their cross-entropies is the limit for texts of
that length up to twice it (the last one for longer texts too). A text without a letter is
``und`` and rejected.

Scoring is a row-local map; n-grams that a worker has met are kept in a table of fixed size.

Defined results: null text, or none with a letter, gives und with score 0; repeated rows are
judged one by one; whole texts count, however long (in pieces of ``PIECE`` characters that
see the characters before them); a null doc_id is not fitted on; ties go to the first language by code
point; no labelled rows, or an empty table: every prediction is und, or no rows; extra
columns are dropped by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, mix

ORDER = 4
SAMPLE_DOCS = 2_000
#: Bounds of the sample: languages, characters of all languages together, and characters of a document.
MAX_LANGUAGES = 500
SAMPLE_CHARS = 64_000_000
SAMPLE_LENGTH = 200_000
#: The uniform distribution below the unigrams.
ALPHABET = 4_096
SCORE_CHARS = 60
LONGEST = 256
MARGIN = 1.3
#: Characters that are scored together.
PIECE = 1 << 18
TABLE_BITS = 19

_U = np.uint64
_MULT = np.random.default_rng(77).integers(1, 1 << 63, ORDER, dtype=np.uint64) * _U(2) + _U(1)


def gram_hash(cols: list[np.ndarray]) -> np.ndarray:
    """Hash of an n-gram given by its characters, first to last."""
    h = np.full(len(cols[0]), len(cols) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1), np.uint64)
    for c, m in zip(cols, _MULT, strict=False):
        h += c.astype(np.uint64) * m
    return mix(h)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each after ORDER - 1 zeros, and where each begins."""
    return laid_out(["\0" * (ORDER - 1) + t.lower() for t in texts])


def laid_out(lows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in lows], np.int64)
    data = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum(n)])


def positions(off: np.ndarray, n: int) -> np.ndarray:
    """Indices of the last characters of all n-grams (none is padding)."""
    keep = np.ones(n, bool)
    for k in range(ORDER - 1):
        keep[off[:-1] + k] = False
    return np.flatnonzero(keep)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", *[f"c{i}" for i in range(ORDER)], "n"]
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
        for lang, part in frame.groupby("lang"):
            data, off = codes(part["text"].tolist())
            at = positions(off, len(data))
            if not len(at):
                continue
            grams = np.stack([data[at - ORDER + 1 + i] for i in range(ORDER)], 1)
            _, first, n = np.unique(gram_hash(list(grams.T)), return_index=True, return_counts=True)
            cols = [pa.array(grams[first, i].astype(np.int32)) for i in range(ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *cols, pa.array(n.astype(np.int64))], names)


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hash arrays of one language's model from its distinct n-grams (rows of ORDER code points)."""
    levels = {ORDER: (grams, counts.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):  # lower orders count how many characters come before
        kept, n = np.unique(levels[k + 1][0][:, 1:], axis=0, return_counts=True)
        levels[k] = (kept, n.astype(np.float64))
    model: dict[str, np.ndarray] = {}
    lower_hash, lower_prob = np.zeros(0, np.uint64), np.zeros(0)
    for k in range(1, ORDER + 1):
        rows, n = levels[k]
        n1, n2 = (n == 1).sum(), (n == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cols = list(rows.T)
        if k == 1:
            total = n.sum()
            rest = discount * len(n) / total
            prob = (n - discount) / total + rest / ALPHABET
            model["floor"] = np.array([np.log(rest / ALPHABET)])
        else:
            context, where = np.unique(gram_hash(cols[:-1]), return_inverse=True)
            total = np.bincount(where, n)
            rest = discount * np.bincount(where) / total
            suffix = gram_hash(cols[1:])
            below = lower_prob[np.searchsorted(lower_hash, suffix)]
            prob = (n - discount) / total[where] + rest[where] * below
            model[f"context{k}"], model[f"backoff{k}"] = context, np.log(rest)
        h = gram_hash(cols)
        by = np.argsort(h)
        lower_hash, lower_prob = h[by], prob[by]
        model[f"gram{k}"], model[f"logp{k}"] = lower_hash, np.log(lower_prob)
    return model


def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return values[at], keys[at] == h


def log_prob(model: dict[str, np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
    """ln P(last character | those before) of n-grams given by columns."""
    n = len(grams[0])
    out, back, open_ = np.zeros(n), np.zeros(n), np.ones(n, bool)
    for k in range(ORDER, 0, -1):
        idx = np.flatnonzero(open_)
        if not len(idx):
            return out
        cols = [g[idx] for g in grams[ORDER - k :]]
        value, found = _find(model[f"gram{k}"], model[f"logp{k}"], gram_hash(cols))
        out[idx[found]] = back[idx[found]] + value[found]
        open_[idx[found]] = False
        if k > 1:
            idx, miss = idx[~found], ~found
            weight, known = _find(model[f"context{k}"], model[f"backoff{k}"], gram_hash([c[miss] for c in cols[:-1]]))
            back[idx] += np.where(known, weight, 0.0)
    out[open_] = back[open_] + model["floor"][0]
    return out


class Scorer:
    """All models, and a table of fixed size of n-grams scored before."""

    def __init__(self, models: list[dict[str, np.ndarray]]):
        self.models = models
        self.key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.value = np.zeros((1 << TABLE_BITS, len(models)), np.float32)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (texts x languages) in nats, and characters of each."""
        total, n = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        size = 0

        def score() -> None:
            of = np.array([i for i, _ in held])
            sums, m = self._sums([x for _, x in held])
            np.add.at(total, of, sums)
            np.add.at(n, of, m)

        for i, text in enumerate(texts):
            for a in range(0, len(text), PIECE):
                before = text[max(0, a - ORDER + 1) : a].lower()[1 - ORDER :] if a else ""
                held.append((i, before.rjust(ORDER - 1, "\0") + text[a : a + PIECE].lower()))
                size += min(PIECE, len(text) - a)
                if size >= 2 * PIECE:
                    score()
                    held, size = [], 0
        if held:
            score()
        return total / np.maximum(n, 1)[:, None], n

    def _sums(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log-probability (pieces x languages), and characters of each; a piece begins with ORDER - 1 characters that only count as context."""
        data, off = laid_out(pieces)
        n = np.diff(off) - (ORDER - 1)
        at = positions(off, len(data))
        out = np.zeros((len(pieces), len(self.models)))
        if not len(at):
            return out, n
        h = gram_hash([data[at - ORDER + 1 + i] for i in range(ORDER)])
        slot = (h & _U((1 << TABLE_BITS) - 1)).astype(np.int64)
        values = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            grams = [data[at[miss[first]] - ORDER + 1 + i] for i in range(ORDER)]
            scores = np.stack([log_prob(m, grams) for m in self.models], 1).astype(np.float32)
            values[miss] = scores[inverse]
            place = slot[miss[first]]
            self.key[place], self.value[place] = 0, 0
            _, last = np.unique(place[::-1], return_index=True)
            last = len(place) - 1 - last
            self.key[place[last]], self.value[place[last]] = new[last], scores[last]
        some = np.flatnonzero(n > 0)
        starts = np.cumsum(n[some]) - n[some]
        for j in range(len(self.models)):
            out[some, j] = -np.add.reduceat(values[:, j].astype(np.float64), starts)
        return out, n


class Model:
    """Languages in order of code points, their hash arrays, and the rejection limits by powers of two of the length (None: not calibrated)."""

    def __init__(self, languages: list[str], models: list[dict[str, np.ndarray]], limits: np.ndarray | None = None):
        self.languages, self.models, self.limits = languages, models, limits

    def rejects(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.limits is None:
            return np.zeros(len(n), bool)
        step = np.log2(np.maximum(n, 1)).astype(np.int64)
        return (n > 0) & (entropy > self.limits[np.minimum(step, len(self.limits) - 1)])


def sample(docs: DataFrame, seed: int = 5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled rows to fit on: not held out, text and lang not null, about ``sample_docs`` for each language; ``check`` marks those kept for calibration."""
    labelled = docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_LENGTH))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, sample_docs / row["n"], SAMPLE_CHARS / len(counts) / max(row["chars"], 1)))).otherwise(share)
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw(seed) < share).select("doc_id", "lang", "text", (draw(seed + 1) < 0.2).alias("check"))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Counts with Spark, builds each language in its own task, and calibrates the limits on the part of the sample that is held back."""
    chosen = sample(docs, sample_docs=sample_docs)
    cols = [f"c{i}" for i in range(ORDER)]
    counts = chosen.where("not check").select("lang", "text").mapInArrow(_count, "lang string, " + ", ".join(f"{c} int" for c in cols) + ", n long").groupBy("lang", *cols).agg(F.sum("n").alias("n"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        model = kneser_ney(frame[cols].to_numpy(np.uint32), frame["n"].to_numpy())
        rows = [(frame["lang"].iloc[0], k, str(v.dtype), v.tobytes()) for k, v in model.items()]
        return pd.DataFrame(rows, columns=["lang", "name", "kind", "data"])

    models: dict[str, dict[str, np.ndarray]] = {}
    for lang, name, kind, data in counts.groupBy("lang").applyInPandas(build, "lang string, name string, kind string, data binary").collect():
        models.setdefault(lang, {})[name] = np.frombuffer(bytes(data), kind)
    languages = sorted(models)
    model = Model(languages, [models[x] for x in languages])
    if languages:
        steps = [1 << k for k in range(LONGEST.bit_length())]
        start = lambda w: (F.pmod(F.xxhash64("doc_id", F.lit(w)), F.greatest(F.char_length("text") - w, F.lit(0)) + 1) + 1).cast("int")
        windows = F.array(*[F.col("text").substr(start(w), F.lit(w)) for w in steps])
        known = predict_with(chosen.where("check").select("doc_id", F.explode(windows).alias("text")), model).where("n > 0")
        step = F.least(F.floor(F.log2("n")), F.lit(len(steps) - 1))
        tops = {row["k"]: row["top"] for row in known.groupBy(step.alias("k")).agg(F.percentile_approx("entropy", 0.999, 10_000).alias("top")).collect()}
        if tops:  # a length without a window has the limit of the next shorter one, or no limit
            limits, last = [], np.inf
            for k in range(len(steps)):
                last = tops[k] * MARGIN if k in tops else last
                limits.append(last)
            model.limits = np.array(limits)
    return model


PREDICTED = "doc_id long, lang_pred string, score double, entropy double, n long, rejected boolean"


def predict_with(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> prediction, score, cross-entropy, characters, and whether the text is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.models)
        names = [f.split()[0] for f in PREDICTED.split(", ")]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                start = at
                while at < batch.num_rows and (size < 1 << 19 or not texts):
                    texts.append(batch.column("text")[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                ids = batch.column("doc_id").slice(start, at - start)
                letters = np.array([any(map(str.isalpha, t)) for t in texts])
                if not model.languages:
                    n, best, score, entropy, known = np.array([len(t) for t in texts]), np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
                else:
                    h, n = scorer.entropies(texts)
                    best = h.argmin(1)
                    entropy = h[np.arange(len(texts)), best]
                    odds = np.exp(-(h - entropy[:, None]) * np.minimum(n, SCORE_CHARS)[:, None]).sum(1)
                    score, known = np.round(1 / odds, 9), letters
                langs = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                out = ~known | model.rejects(entropy, n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(entropy.astype(float)), pa.array(n.astype(np.int64)), pa.array(out)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)


def predict(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Fits on the labelled rows of ``docs`` that are not held out, and predicts all of them."""
    return predict_with(docs, fit(docs, sample_docs))


def keep_known(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that are not rejected; a null lang is filled with the prediction.

    The model is applied where the rows are (no join): a verdict column comes back with each row.
    """
    model = fit(docs, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.models)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t or "" for t in part.column(text).to_pylist()]
                good = np.array([any(map(str.isalpha, t)) for t in texts])
                labels = part.column(lang).to_pylist()
                if model.languages:
                    h, n = scorer.entropies(texts)
                    best = h.argmin(1)
                    low = h[np.arange(len(texts)), best]
                    good &= ~model.rejects(low, n)
                    labels = [model.languages[b] if x is None else x for x, b in zip(labels, best, strict=True)]
                cols = [pa.array(labels, c.type) if i == lang else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return predict(docs).select("doc_id", held, "lang_pred", "score", "entropy", "rejected")
