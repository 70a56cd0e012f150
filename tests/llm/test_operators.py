"""Each operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken

from foliant.llm import byte_bpe, language_id, license_scan, line_dedup, media_columns, minhash_dedup, mixing, quality_rules, sharding, suffix_dedup
from foliant.llm.known_licenses import KNOWN

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, _bucket int"


@pytest.fixture(scope="module")
def texts(spark, sf):
    """Ids and texts: documents, their near copies, and edge cases."""
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    base = docs[3][1]
    words = base.split(" ")
    at = 10_000
    extra = [(None, "null"), ("", "empty"), (" \n\t ", "blank"), ("one", "word"), (base, "copy"), (base, "copy"), ("x" * 700, "run"), ("x" * 700, "run"), ("ab " * 4000, "long"), ("Zürich 東京 \U0001f600 <|endoftext|> don't", "wide")]
    for i in range(0, 40, 3):
        w = list(words)
        w[i % len(w)] = f"edit{i}"
        w[(i * 7) % len(w)] = f"mend{i}"
        extra.append((" ".join(w), "near"))
    for text, _ in extra:
        docs.append((at, text, None if at % 3 else "en", None if at % 2 else "src\U00010400"))
        at += 1
    return docs


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*t, None, "clash", "clash", 3) for t in texts], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_suffix_dedup(docs, texts, monkeypatch):
    raw = {i: (t or "").encode() for i, t, *_ in texts}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for hot in (suffix_dedup.HOT, 0):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = rows(suffix_dedup.suffix_report(docs, texts=True))
        for i, b in raw.items():
            cut = np.zeros(len(b), bool)
            for k in range(len(b) - 199):
                if seen[b[k : k + 200]] > 1:
                    cut[k : k + 200] = True
            left = np.frombuffer(b, np.uint8)[~cut].tobytes()
            spans = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(cut.sum()), spans, left)
            assert got[i].kept_sha256 == hashlib.sha256(left).hexdigest()


def test_log_index_levels():
    index, known = suffix_dedup.LogIndex(), {}
    rng = np.random.default_rng(1)
    for n in range(40):
        keys = np.unique(rng.integers(0, 600, (50, 2), dtype=np.uint64), axis=0)
        found = index.add(keys[:, 0].copy(), keys[:, 1].copy(), n * 1000 + np.arange(len(keys)))
        for j, (k, f) in enumerate(zip(map(tuple, keys), found, strict=True)):
            assert f == known.get(k, -1)
            known.setdefault(k, n * 1000 + j)
    sizes = [len(x[0]).bit_length() for x in index.levels]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (40, 7)])
def test_byte_bpe(docs, texts, chunk, overlap):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    ids = {r.doc_id: list(r.ids) for r in out.collect()}
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(out, path, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in texts:
        assert ids[i] == enc.encode_ordinary(t or "")
        assert back[i] == (t or "").encode()


def test_license_scan(spark, docs):
    mit = KNOWN[0][2]
    odd = "Copyright (c) 2024 Someone\n\n" + mit.replace("sublicense", "sub-license").upper().replace(",", " ,")
    docs = spark.createDataFrame([(1, odd), (2, mit + " and more"), (3, "x\nreleased under the MIT Licence\ny"), (4, None), (5, ""), (6, "Copyright (c) 2020")], "doc_id long, text string")
    got = rows(license_scan.scan(docs, license_scan.known_digests(spark)))
    assert [got[i].license for i in range(1, 7)] == ["MIT", None, None, None, None, None]
    assert (got[3].n_license_lines, got[3].line_licenses) == (1, "MIT")
    assert got[4].digest is None


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(spark, docs, texts, monkeypatch, small):
    if small:  # hot tokens, slices and all turns on small data
        for name, value in (("HOT", 6), ("SLICE", 5), ("TURNS", (1, 2, None)), ("HELD", 500), ("PACKED", 7), ("PAIRS", 50)):
            monkeypatch.setattr(line_dedup, name, value)
    words = [f"w{i}" for i in range(30)]
    more = [(20_000, "\n".join([" ".join(words), " ".join(words[:27] + ["q", "r"]), "a b c", "a b c"])), (20_001, " ".join(reversed(words)) + "\nAn other line of six words"), (20_002, "an OTHER line of six words\n\nend")]
    both = [(i, t) for i, t, *_ in texts] + more
    df = spark.createDataFrame(both, "doc_id long, text string")
    got = rows(line_dedup.line_report(df))
    sets: list[frozenset] = []
    for i, t in sorted(both):
        if t is None:
            assert (got[i].n_lines, got[i].n_removed) == (0, 0)
            continue
        out, lines = [], t.encode().split(b"\n")
        for line in lines:
            s = frozenset(line.lower().split())
            gone = bool(s) and any(180 * len(s & o) >= 80 * (len(s) + len(o)) for o in sets)
            if s:
                sets.append(s)
            if not gone:
                out.append(line)
        assert (got[i].n_lines, got[i].n_removed) == (len(lines), len(lines) - len(out)), i
        assert got[i].kept_sha256 == hashlib.sha256(b"\n".join(out)).hexdigest()
    kept = line_dedup.without_later_lines(docs)
    assert kept.columns == docs.columns


def test_line_dedup_short_lines(spark, texts):
    more = [(20_000, "Les.\nAnd ornd.\none two three four\none two three\nthe end of it\n\nmany a word stands here"), (20_001, "les.\nornd. AND and\nfour three two one five\none two\nthe end of\n\nstands here word a"), (20_002, "Les.\nfour one two three\nnew")]
    both = [(i, t) for i, t, *_ in texts] + more
    got = rows(line_dedup.line_report(spark.createDataFrame(both, "doc_id long, text string")))
    sets: list[frozenset] = []
    for i, t in sorted(x for x in both if x[1] is not None):
        out, lines = [], t.encode().split(b"\n")
        for line in lines:
            s = frozenset(line.lower().split())
            if not s or not any(180 * len(s & o) >= 80 * (len(s) + len(o)) for o in sets):
                out.append(line)
            if s:
                sets.append(s)
        assert (got[i].n_lines, got[i].n_removed) == (len(lines), len(lines) - len(out)), i
        assert got[i].kept_sha256 == hashlib.sha256(b"\n".join(out)).hexdigest()
    assert (got[20_001].n_removed, got[20_002].n_removed) == (4, 2)


def test_mixing(docs, texts):
    sizes, per, got = mixing.mix(docs, block_words=16, shard_slots=64)
    summed = lambda df: {r.d: r.n for r in df.groupBy("d").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    taken = summed(got)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in texts}
    source = {i: s for i, _, _, s in texts}
    names = sorted({s for s in source.values() if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    own = collections.Counter()
    for i, n in size.items():
        own[source[i]] += n
    total, target, fixed = sum(size.values()), {}, set()
    while True:
        left = total - sum(3 * own[s] for s in fixed)
        w = sum(weight[s] for s in names if s not in fixed)
        target = {s: 3 * own[s] if s in fixed else left * weight[s] / w for s in names}
        over = {s for s in names if s not in fixed and target[s] > 3 * own[s]}
        if not over:
            break
        fixed |= over
    shown = {None if r.s_null else r.s: r.target for r in per.collect()}
    for s in names:
        assert abs(shown[s] - target[s]) < 1e-6
        assert abs(sum(taken.get(i, 0) for i in size if source[i] == s) - target[s]) <= 1
    assert all(taken.get(i, 0) <= 3 * size[i] for i in size)
    assert summed(mixing.mix(docs, block_words=16, shard_slots=64)[2]) == taken
    # each word of a slot is taken once, and a shard is full but for its last
    for shard, places in collections.Counter((r.shard) for r in got.select("shard", "place").distinct().collect()).items():
        assert places == 64 or shard == max(r.shard for r in got.select("shard").distinct().collect())
    mixed = mixing.mixed_documents(docs, block_words=16)
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in taken.items() if n}


def test_mixing_draws(spark):
    """Counts of a shard are multinomial given the totals: means by share, variances by the hypergeometric law."""
    from pyspark.sql import functions as F

    per = spark.createDataFrame([(False, "a", 400_000, 400_000.0), (False, "b", 150_000, 200_000.0), (True, "", 30_000, 90_000.0)], "s_null boolean, s string, source_size long, target double")
    counts, total = mixing.slot_counts(per, 10)
    drawn = mixing.draws(counts, total, shard_slots=256)
    n = {r.s: r.n_slots for r in counts.collect()}
    assert n == {"a": 40_000, "b": 20_000, "": 9_000} and total == 69_000
    table = np.zeros((total // 256, 3))
    for r in drawn.where(F.col("shard") < total // 256).collect():
        table[r.shard, ["a", "b", ""].index(r.s)] = r.n
    assert (table.sum(1) == 256).all()
    share = np.array([40, 20, 9]) / 69
    assert (abs(table.mean(0) - 256 * share) < 3 * np.sqrt(256 * share * (1 - share) / len(table))).all()
    assert (abs(table.var(0) / (256 * share * (1 - share)) - 1) < 0.35).all()
    slots = mixing.slots(per, 10, 256).collect()
    assert collections.Counter(r.s for r in slots) == n
    assert sorted((r.shard, r.place) for r in slots) == [(i // 256, i % 256) for i in range(total)]
    assert max(collections.Counter((r.s, r.block) for r in slots).values()) <= 3
    assert sum(r.words for r in slots if r.s == "b") == 200_000


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c d e f g h i j", "x"), (1, "a b c d e f g h i j", "x"), (1, "k l m", "x"), (1, "k l m", None), (None, "n o p", "y"), (None, "n o p", "y"), (2, None, "y"), (3, "q " * 400, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _spans", "2 AS _k")
    sizes, per, got = mixing.mix(df, block_words=4)
    taken = {(r.d_null, r.d, r.h, r.k): r.n for r in got.groupBy("d_null", "d", "h", "k").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    all_rows = sizes.collect()
    assert len(all_rows) == 8 and len({(r.d_null, r.d, r.h, r.k) for r in all_rows}) == 8
    assert all(taken.get((r.d_null, r.d, r.h, r.k), 0) <= 3 * r["size"] for r in all_rows)
    target = {(r.s_null, r.s): r.target for r in per.collect()}
    for key, t in target.items():
        assert abs(sum(taken.get((r.d_null, r.d, r.h, r.k), 0) for r in all_rows if (r.s_null, r.s) == key) - t) <= 1
    mixed = mixing.mixed_documents(df, block_words=4)
    assert mixed.columns == df.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        images = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), [F.lit("key")]).alias("x")).collect()
        assert sorted(r.x for r in images) == list(range(n))


def test_media_columns(docs, texts):
    media = media_columns.encode_media(docs)
    got = rows(media_columns.media_features(media))
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    for i, t, *_ in texts:
        b = (t or "").encode()
        payload = b + b"\0" * (-len(b) % 64) if b else b"\0" * 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(files[i]), hashlib.sha256(files[i]).hexdigest())
        assert files[i][:2] == b"\xff\xd8" and files[i][-2:] == b"\xff\xd9"
    a, b = (i for i, t, *_ in texts if t == "x" * 700)
    assert got[a].feature == got[b].feature


def test_language_id(spark, sf, docs, texts):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op7_language_id(spark, "/root/testdata/sf0.01").join(big, "doc_id").where("held_out")
    n, good = got.count(), got.where("lang = lang_pred").count()
    assert good / n > 0.98
    edge = rows(language_id.predict(docs))
    assert edge[10_000].lang_pred == edge[10_001].lang_pred == edge[10_002].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in edge.values())
    kept = {r.doc_id for r in language_id.keep_known(docs).collect()}
    assert {i for i, t, _, _ in texts[:60]} <= kept and 10_001 not in kept


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(3)
    text = rng.choice(list("abcd"), 4000)
    grams = np.stack([[ord(c) for c in text[i : len(text) - 3 + i]] for i in range(4)], 1).astype(np.uint32)
    u, n = np.unique(grams, axis=0, return_counts=True)
    model = language_id.kneser_ney(u, n)
    for context in u[:: len(u) // 5]:
        cols = [np.full(5, c, np.uint32) for c in context[:3]] + [np.array([*map(ord, "abcd"), 999], np.uint32)]
        p = np.exp(language_id.log_prob(model, cols))
        assert abs(p[:4].sum() + (language_id.ALPHABET - 4) * p[4] - 1) < 1e-6


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_dedup(docs, texts, width):
    got = rows(minhash_dedup.near_duplicates(docs, width))
    sets = {}
    for i, t, *_ in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), comp[i], comp[i] == i)
    kept = minhash_dedup.keep_first(docs, width)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in comp if comp[i] == i}


def test_sharding(docs, texts):
    got = rows(sharding.shard_documents(docs))
    counts = collections.Counter(r.shard for r in got.values())
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(counts[s]))
    for i, t, *_ in texts:
        b = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
    groups = collections.defaultdict(set)
    for i, t, *_ in texts:
        groups[t].add(got[i].shard)
    assert sum(len(v) > 1 for v in groups.values()) <= 1


def split_groups(df):
    groups = collections.defaultdict(set)
    for r in df.collect():
        groups[r.text_crc32].add(r.shard)
    return sum(len(v) > 1 for v in groups.values())


def test_sharding_unites_pairs(spark):
    pairs = [(2 * i + j, f"pair {i}") for i in range(300) for j in (0, 1)]
    threes = [(1000 + i, f"group {i % 20}") for i in range(100)]
    singles = [(5000 + i, f"single {i}") for i in range(3000)]
    df = spark.createDataFrame(pairs + threes + singles, "doc_id long, text string")
    assert split_groups(sharding.shard_documents(df)) == 0


def test_sharding_unites_pairs_without_room(spark):
    df = spark.createDataFrame([(2 * i + j, f"pair {i}") for i in range(400) for j in (0, 1)], "doc_id long, text string")
    # of the pairs left, no set closes a cycle of shards: 7 at most, where no round has failed to find one
    assert split_groups(sharding.shard_documents(df)) <= 14


def test_flows():
    assert sharding.flows([[0, 3, 0], [2, 0, 0], [0, 0, 0]], [0, 0, 0]) == [[0, 2, 0], [2, 0, 0], [0, 0, 0]]
    assert sharding.flows([[0, 3, 0], [0, 0, 2], [4, 0, 0]], [0, 0, 0]) == [[0, 2, 0], [0, 0, 2], [2, 0, 0]]
    assert sharding.flows([[0, 3, 0], [0, 0, 2], [0, 0, 0]], [-1, 0, 1]) == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]
    rng = np.random.default_rng(5)
    for _ in range(50):
        want, room = rng.integers(0, 9, (5, 5)) * (1 - np.eye(5, dtype=int)), rng.integers(-3, 4, 5)
        got = np.array(sharding.flows(want.tolist(), room.tolist()))
        gain = got.sum(0) - got.sum(1)
        assert (got >= 0).all() and (got <= want).all() and (gain <= np.maximum(room, 0)).all()


def test_quality_rules(spark, docs, texts):
    loop = [(30_000, "a b c d e f g h " * 6), (30_001, "one two three four five six seven eight nine ten " * 2), (30_002, "\n".join(["same line here"] * 3 + ["# $ %"]))]
    both = [(i, t) for i, t, *_ in texts] + loop
    got = rows(quality_rules.with_verdict(spark.createDataFrame(both, "doc_id long, text string")))
    for i, t in both:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert got[i].base_failed == base and not (base and got[i].kept)


OPERATORS = {
    "suffix": suffix_dedup.suffix_report,
    "lines": line_dedup.line_report,
    "media": lambda d: media_columns.media_features(media_columns.encode_media(d)),
    "language": language_id.predict,
    "minhash": minhash_dedup.near_duplicates,
    "shards": sharding.shard_documents,
    "quality": quality_rules.with_verdict,
    "mix": mixing.mixed_documents,
    "without_lines": line_dedup.without_later_lines,
    "known": language_id.keep_known,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mixing", "byte_bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.count() > 0


def test_pipeline_drops_exact_copies_with_short_lines(spark):
    import corpus_pipeline

    text = "Les.\nAll rights reserved.\nthis line has more than five words\n\nAnd ornd.\none two three four"
    docs = spark.createDataFrame([(1, text), (2, "And ornd.\nnew"), (3, text), (4, text.upper()), (5, None), (6, " \n")], "doc_id long, text string")
    got = rows(corpus_pipeline.dedup_lines(spark, docs, ""))
    assert {i: r.text for i, r in got.items()} == {1: text, 2: "new", 5: None, 6: " \n"}
