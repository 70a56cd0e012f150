"""MinHash near-duplicates with tensored banding.

Each document's shingle set gets ``COLLECTIONS`` small collections of ``ROWS`` minhashes;
a table key combines two collections, so COLLECTIONS * (COLLECTIONS - 1) / 2 tables come
from far fewer minhashes than independent bands would need. Two sets meet in a table when
they agree in two collections or more: at a Jaccard similarity of 0.8 with 16 collections of
3, the chance to miss that is below 2 in 10,000, at 0.85 below 1 in 100,000.

Candidates are verified on full sets. Inside a bucket no pairs are formed: every member is
compared with one hub (the member that shares most with others), and the comparison keeps
the symmetric difference of the two sets. Two members of a bucket that both link with the
hub are in one component. For a member u that does not, links to any other member v follow
from the differences: with sizes known, a link needs so many elements of D(v) in D(u) that
one must lie in a prefix of D(v), rarest among the hub's members first. So u's difference is joined with such prefixes by (hub, element), and what meets
is verified on full sets. Nothing is capped or sampled, and groups of copies need a number
of comparisons in proportion to their size.

Equal sets are one class, represented by the smallest doc_id.

Words and shingles are known by 64-bit hashes that are not linear (see ``word_hashes``), so
sets are compared by them: two of a document's shingles, or of two compared documents', fall
together with a chance of their number squared over 2 ** 65.

Defined results: null and empty texts, and texts without words, have the empty set and link
with nothing; texts with fewer words than a shingle have their whole sequence as one
shingle; equal similarities are links at exactly the threshold; repeated texts share a
component; rows with a null doc_id are linked with nothing, and have no component; extra columns are dropped by ``near_duplicates`` and kept by ``keep_first``; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import LOWER_AZ, as_long, components, documents, fresh, materialise, mix, sorted_sets, small_batches, stored, text_batches, word_hashes, word_spans

COLLECTIONS = 16
ROWS = 3
#: Table keys that a task makes.
KEYS = 1_000_000
#: Similarity as a ratio of whole numbers: NUM / DEN.
NUM, DEN = 80, 100

_U = np.uint64
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (COLLECTIONS * ROWS, 2), dtype=np.uint64) * _U(2) + _U(1)
_PAIRS = np.array([(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)])


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle of a batch, repeats included, in order of documents."""
    data = LOWER_AZ[data]
    starts, ends, doc = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    n = np.bincount(doc, minlength=len(off) - 1)
    short = np.flatnonzero((n > 0) & (n < width))
    m = len(words) - width + 1
    if m > 0:
        whole = doc[:m] == doc[width - 1 :]
        h = np.full(m, width, np.uint64)
        for i in range(width):
            h = mix(h * _U(0x9E3779B97F4A7C15) + words[i : i + m])
        doc_of, hashes = doc[:m][whole], h[whole]
    else:
        doc_of, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(short):
        first = np.cumsum(n) - n
        own = []
        for d in short:
            h = np.full(1, n[d], np.uint64)
            for w in words[first[d] : first[d] + n[d]]:
                h = mix(h * _U(0x9E3779B97F4A7C15) + w)
            own.append(h[0])
        doc_of, hashes = np.concatenate([doc_of, short]), np.concatenate([hashes, np.array(own, np.uint64)])
        by = np.argsort(doc_of, kind="stable")
        doc_of, hashes = doc_of[by], hashes[by]
    return doc_of, hashes


SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, sketch array<long>"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per document: size of its set, a 128-bit signature of the set, and its collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_batches(batches, most=1 << 19):
            n_docs = len(off) - 1
            doc, h = sorted_sets(*shingles(data, off, width))
            size = np.bincount(doc, minlength=n_docs)
            some = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[some]
            s1, s2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
            out = np.zeros((n_docs, COLLECTIONS), np.uint64)
            if len(some):
                s1[some] = np.add.reduceat(mix(h), starts)
                s2[some] = np.bitwise_xor.reduceat(mix(h + _U(0x632BE59BD9B4E019)), starts)
                for c in range(COLLECTIONS):
                    key = np.full(len(some), c + 1, np.uint64)
                    for a, b in _SEEDS[c * ROWS : (c + 1) * ROWS]:
                        key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ b) * a, starts))
                    out[some, c] = key
            flat = pa.array(as_long(out).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * COLLECTIONS), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(as_long(s1)), pa.array(as_long(s2)), lists], ["doc_id", "n_shingles", "s1", "s2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def table_keys(reps: DataFrame) -> DataFrame:
    """(doc_id, sketch) -> (key, id): one row for each pair of collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.num_rows
                c = np.array(part.column("sketch").to_pylist(), np.int64).view(np.uint64).reshape(n, COLLECTIONS)
                key = mix(c[:, _PAIRS[:, 0]] * _U(0x9E3779B97F4A7C15) + c[:, _PAIRS[:, 1]])
                ids = np.repeat(part.column("doc_id").to_numpy(), len(_PAIRS))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key).ravel()), pa.array(ids)], ["key", "id"])

    return reps.select("doc_id", "sketch").mapInArrow(run, "key long, id long")


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(col)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


COMPARED = "a long, b long, linked boolean, n_a long, n_b long, diff array<long>, prefix int"


def compare(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Verifies pairs (a, b) on full sets.

    ``diff`` is the symmetric difference; in any order of its elements, a link of b with a member
    that a does not link with needs one of the first ``prefix``.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("other")), "a").select("a", "b", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_batches(batches, most=1 << 18):
            n = part.num_rows
            doc_b, h_b = sorted_sets(*shingles(data, off, width))
            doc_a, h_a = sorted_sets(*shingles(*_flat(part.column("other")), width))
            n_a, n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
            doc, h = np.concatenate([doc_a, doc_b]), np.concatenate([h_a, h_b])
            by = np.lexsort((h, doc))
            doc, h = doc[by], h[by]
            same = np.zeros(len(h), bool)
            same[1:] = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
            inter = np.bincount(doc[same], minlength=n)
            twice = same.copy()
            twice[:-1] |= same[1:]
            doc, h = doc[~twice], h[~twice]
            size = np.bincount(doc, minlength=n)
            linked = den * inter >= num * (n_a + n_b - inter)
            # u, v link when |D(u)|+|D(v)|-2|D(u)&D(v)| <= r (|u|+|v|), r = (den-num)/(den+num); u does not link with a
            need = np.ceil((size * (den + num) + (den - num) * (n_a - n_b)) / (2 * (den + num)) - 1e-9)
            prefix = np.clip(size - np.maximum(need, 1) + 1, 0, size).astype(np.int32)
            diff = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(as_long(h)))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked), pa.array(n_a), pa.array(n_b), diff, pa.array(prefix)], [f.split()[0] for f in COMPARED.split(", ")])

    return both.mapInArrow(run, COMPARED)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, width, num, den)


def _near_duplicates(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialise(sketches(docs, width))
    shared = ["n_shingles", "s1", "s2"]
    reps = sets.where("n_shingles > 0").groupBy(*shared).agg(F.min("doc_id").alias("rep"))
    member = materialise(sets.drop("sketch").join(reps, shared, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    classes = member.where("doc_id = rep and n_shingles > 0").select("doc_id")
    # each class makes a key for each table; about KEYS of them are made by a task
    tasks = max(1, -(-classes.count() * len(_PAIRS) // KEYS))
    keys = table_keys(sets.join(classes, "doc_id", "left_semi").repartition(tasks, "doc_id"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meets = materialise(keys.join(buckets.hint("shuffle_hash"), "key"))
    score = meets.groupBy("id").agg(F.sum("n").alias("score"))
    scored = meets.join(score, "id")
    hubs = scored.groupBy("key").agg(F.max(F.struct(F.col("score"), (-F.col("id")).alias("neg"))).alias("top")).select("key", (-F.col("top.neg")).alias("hub"))
    stars = materialise(meets.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    seen = materialise(compare(stars, docs, width, num, den))
    comps = components(seen.where("linked").select("a", "b"))
    side = lambda x: comps.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}"))
    seen = seen.join(side("a"), "a", "left").join(side("b"), "b", "left")
    seen = materialise(seen.withColumns({x: F.coalesce(x, x[-1]) for x in ("comp_a", "comp_b")}).withColumn("size", F.size("diff")))
    # elements of the differences, rarest among the hub's members first
    each = seen.where("size > 0").select("a", "b", F.col("n_b").alias("n"), "size", (F.col("comp_a") != F.col("comp_b")).alias("open"), F.col("comp_b").alias("comp"), "prefix", F.explode("diff").alias("x"))
    often = each.groupBy("a", "x").agg(F.count("*").alias("often"))
    each = each.join(often, ["a", "x"]).withColumn("j", F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "x")) - 1)
    each = stored(each.where("often > 1 and (open or j <= prefix)").drop("often"))
    u = each.where("open").select("a", F.col("b").alias("u"), F.col("n").alias("n_u"), F.col("size").alias("size_u"), F.col("comp").alias("comp_u"), "x")
    v = each.where("j <= prefix").select("a", F.col("b").alias("v"), F.col("n").alias("n_v"), F.col("size").alias("size_v"), F.col("comp").alias("comp_v"), "j", "x")
    # a link needs ``need`` common elements, so two of them (or one) are among the first size_v - need + 2 (or 1) of v
    need = F.ceil(((den + num) * (F.col("size_u") + F.col("size_v")) - (den - num) * (F.col("n_u") + F.col("n_v"))) / (2 * (den + num)))
    few = F.least(F.greatest(need, F.lit(1)), F.lit(2))
    can = (need <= F.col("size_u")) & (need <= F.col("size_v")) & (F.col("j") < F.col("size_v") - need + few)
    met = u.alias("u").join(v.alias("v"), (F.col("u.a") == F.col("v.a")) & (F.col("u.x") == F.col("v.x")) & (F.col("comp_u") != F.col("comp_v")) & can)
    met = met.groupBy("u.a", "u.u", "v.v", "comp_u", "comp_v", few.alias("few")).agg(F.count("*").alias("met")).where("met >= few")
    flip = F.col("u") > F.col("v")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    more = materialise(met.select(pick("u", "v").alias("a"), pick("v", "u").alias("b"), pick("comp_u", "comp_v").alias("comp_a"), pick("comp_v", "comp_u").alias("comp_b")).distinct())
    new = compare(more.select("a", "b"), docs, width, num, den).where("linked").select("a", "b").join(more, ["a", "b"])
    joined = components(new.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    out = member.join(comps, member.rep == comps.id, "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("c"))
    out = out.join(joined, out.c == joined.id, "left").select("doc_id", "n_shingles", F.coalesce("comp", "c").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, num: int = NUM, den: int = DEN, before: DataFrame | None = None) -> DataFrame:
    """One document of each component: the one with the smallest doc_id stays.

    ``before``: earlier texts of the documents, whose links count too. Where lines that other
    documents have were cut, copies are left with what they do not share, and only their
    earlier texts show that they are copies. Links through documents that are not in
    ``docs`` any more count; the document that stays is one of ``docs``.

    A doc_id that occurs twice keeps all its rows or none; a null doc_id keeps its rows.
    """
    found = near_duplicates(docs, width, num, den).where("doc_id <> component_id").select("doc_id", "component_id")
    if before is not None:
        own = stored(near_duplicates(before, width, num, den).where("doc_id <> component_id").select("doc_id", "component_id"))
        edges = own.unionByName(stored(found)).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        found = components(edges).select(F.col("id").alias("doc_id"), F.col("comp").alias("component_id"))
        here = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        found = stored(found.join(here, "doc_id", "left_semi"))
        first = found.groupBy("component_id").agg(F.min("doc_id").alias("first"))
        found = found.join(first, "component_id").where("doc_id <> first")
    gone = fresh(docs.columns, "_gone")
    lost = found.select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost[gone], "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)


def oracle_sql() -> str:
    """The contract by plain set joins and a recursive closure."""
    return r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT doc_id AS id, doc_id AS comp FROM documents UNION SELECT both_ways.b, r.comp FROM r JOIN both_ways ON both_ways.a = r.id),
    c AS (SELECT id, min(comp) AS comp FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id, d.doc_id = c.comp AS kept
    FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """
