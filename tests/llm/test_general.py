"""Hashes, long texts, foreign files, odd columns and the stages of the pipeline, each against a plain form."""

import collections
import hashlib
import struct

import numpy as np
import pytest
import tiktoken

from foliant.llm import byte_bpe, common, language_id, license_scan, line_dedup, media_columns, minhash_dedup, mixing, quality_rules, sharding, suffix_dedup
from foliant.llm.known_licenses import KNOWN


def rows(df):
    return {r.doc_id: r for r in df.collect()}


# ---------------------------------------------------------------- hashes


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_under_polynomials(spark):
    one = thue_morse(10)
    two = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{one} {two} {one} x"), (2, f"{one} {one}"), (3, f"{two} {two}")], "doc_id long, text string")
    got = rows(minhash_dedup.near_duplicates(df, 2))
    assert [got[i].n_shingles for i in (1, 2, 3)] == [3, 1, 1]
    assert len({got[i].component_id for i in (2, 3)}) == 2


def test_word_hashes():
    words = [b"", b"a", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 511, b"x" * 512, b"x" * 513, b"x" * 5000]
    data = np.frombuffer(b" ".join(words) + b"tail", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    first = common.word_hashes(data, starts, ends)
    assert len(set(first.tolist())) == len(words)
    moved = np.concatenate([np.frombuffer(b"12345", np.uint8), data])
    assert (common.word_hashes(moved, starts + 5, ends + 5) == first).all()


# ---------------------------------------------------------------- tokens


def test_long_texts_and_digests(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "a", "word " * 9000, " " * 300 + "x" * 300 + "\n\n  y" * 200, "don't 12345678 é東京 " * 900, "z" * 20_000]
    df = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for chunk, overlap in ((16_384, 512), (64, 9)):
        got = {(-1 if r.doc_id is None else r.doc_id): r for r in byte_bpe.encode(df, path, public_tokenizers.PATTERN, digests=True, chunk=chunk, overlap=overlap).collect()}
        for i, t in enumerate(texts):
            r, ids = got[-1 if i == 5 else i], enc.encode_ordinary(t or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_packed_numbers():
    for numbers, width in (([], 1), ([0], 1), ([255, 0], 1), ([256, 3], 2), ([65_535], 2), ([65_536, 1], 4), ([2**32 - 1], 4)):
        packed = byte_bpe.pack(numbers)
        assert len(packed) == 1 + width * len(numbers)
        assert byte_bpe.unpack(packed).tolist() == numbers


def test_chunks_shuffle_little(spark):
    """What goes to the tasks of chunks and back is less than three times the texts."""
    import public_tokenizers

    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuvwzé"), rng.integers(1, 11))) for _ in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 20_000)) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = written()
    assert byte_bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True).count() == 4
    moved = sum(n for k, n in written().items() if k not in before)
    assert 0 < moved < 3 * sum(len(x.encode()) for x in texts)


# ---------------------------------------------------------------- media


def codes(lengths, symbols):
    out, code, last = {}, 0, 0
    for n, s in zip(lengths, symbols, strict=True):
        code <<= n - last
        out[s], code, last = format(code, f"0{n}b"), code + 1, n
    return out


DC, AC = codes(media_columns.DC_LENGTHS, media_columns.DC_SYMBOLS), codes(media_columns.AC_LENGTHS, media_columns.AC_SYMBOLS)


def extra_bits(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def plain_block(block, before):
    n, extra = extra_bits(block[0] - before)
    bits, run = DC[n] + extra, 0
    for v in block[1:]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            bits, run = bits + AC[0xF0], run - 16
        n, extra = extra_bits(v)
        bits, run = bits + AC[run << 4 | n] + extra, 0
    return bits + (AC[0] if run else "")


def stuffed(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def plain_read(scan, n_blocks):
    """Blocks of one component, each a restart interval, bit by bit."""
    back_dc, back_ac = {v: k for k, v in DC.items()}, {v: k for k, v in AC.items()}
    parts, at, part = [], 0, bytearray()
    while at < len(scan):
        if scan[at] == 0xFF and scan[at + 1] != 0:
            parts.append(bytes(part))
            part = bytearray()
            at += 2
            continue
        part.append(scan[at])
        at += 2 if scan[at] == 0xFF else 1
    out = []
    for raw in parts[:n_blocks]:
        bits, pos, block = "".join(f"{b:08b}" for b in raw), 0, [0] * 64

        def symbol(table):
            nonlocal pos
            n = 1
            while bits[pos : pos + n] not in table:
                n += 1
            pos += n
            return table[bits[pos - n : pos]]

        def value(n):
            nonlocal pos
            if not n:
                return 0
            v = int(bits[pos : pos + n], 2)
            pos += n
            return v if v >> (n - 1) else v - (1 << n) + 1

        block[0], k = value(symbol(back_dc)), 1
        while k < 64:
            s = symbol(back_ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                block[k] = value(s & 15)
            k += 1
        out.append(block)
    return out


def test_files_read_by_a_plain_decoder():
    rng = np.random.default_rng(7)
    for payload in (b"", b"hello world " * 9, rng.integers(0, 256, 700, dtype=np.uint8).tobytes(), b"\0" * 130 + b"\xff" * 64):
        file = media_columns.encode_payloads(np.frombuffer(payload, np.uint8), np.array([0, len(payload)]))[0]
        head = media_columns.Header(file)
        blocks = plain_read(file[head.scan :], head.n_mcus)
        assert len(blocks) == head.n_mcus
        raw = b"".join(np.array(b, np.int8).tobytes() for b in blocks)
        assert raw[: len(payload)] == payload and not any(raw[len(payload) :])


def test_long_payloads_are_cut_into_slices(monkeypatch):
    data = np.random.default_rng(8).integers(0, 256, 64 * 300 + 5, dtype=np.uint8)
    off = np.array([0, len(data)])
    whole = media_columns.encode_payloads(data, off)
    monkeypatch.setattr(media_columns, "SLICE", 32)
    assert media_columns.encode_payloads(data, off) == whole
    head, coefs = media_columns.decode_files(whole)[0]
    assert coefs.astype(np.int8).tobytes()[: len(data)] == data.tobytes() and head.n_mcus >= 301


@pytest.mark.parametrize("restart", [0, 1, 4])
@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
def test_colour_files(restart, sampling):
    """Three components with own sampling factors, tables and predictors, with and without restart intervals."""
    rng = np.random.default_rng(restart * 10 + sum(sampling))
    h, v = sampling
    width, height = 37, 29
    cols, lines = -(-width // (8 * h)), -(-height // (8 * v))
    pattern = [0] * (h * v) + [1, 2]
    blocks = [np.where(rng.random(64) < 0.2, rng.integers(-60, 60, 64), 0) for _ in range(cols * lines * len(pattern))]
    scan, bits, before = b"", "", [0, 0, 0]
    for m in range(cols * lines):
        if restart and m and m % restart == 0:
            scan += stuffed(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, before = "", [0, 0, 0]
        for j, part in enumerate(pattern):
            block = [int(x) for x in blocks[m * len(pattern) + j]]
            bits += plain_block(block, before[part])
            before[part] = block[0]
    scan += stuffed(bits)
    seg = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    quant = seg(0xDB, b"\0" + bytes([3]) * 64 + b"\x01" + bytes([9]) * 64)
    tables = b"".join(media_columns.table_bytes(k << 4 | t, *x) for k, x in enumerate(((media_columns.DC_LENGTHS, media_columns.DC_SYMBOLS), (media_columns.AC_LENGTHS, media_columns.AC_SYMBOLS))) for t in (0, 1))
    frame = seg(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 1, 3, 0x11, 1]))
    file = b"\xff\xd8" + seg(0xE0, b"JFIF") + quant + frame + seg(0xC4, tables) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9"
    head, coefs = media_columns.decode_files([file, b"not a file", file[:60]])[0]
    assert (coefs == np.array(blocks)).all()
    thumb = media_columns.thumbnail(head, coefs)
    assert thumb.shape == (-(-height // 8), -(-width // 8))
    for y in range(thumb.shape[0]):
        for x in range(thumb.shape[1]):
            mcu, j = (y // v) * cols + x // h, (y % v) * h + x % h
            assert thumb[y, x] == np.clip(blocks[mcu * len(pattern) + j][0] * 3 // 8 + 128, 0, 255)
    assert media_columns.decode_files([file, b"not a file", file[:60]])[1:] == [None, None]


# ---------------------------------------------------------------- licences, rules, languages


def test_licence_paragraphs_and_spellings(spark):
    gpl = next(t for name, _, t in KNOWN if name == "GPL-3.0-or-later")
    apache = next(t for _, _, t in KNOWN if t.startswith("Licensed under the Apache License, Version 2.0 (the"))
    mit = KNOWN[0][2]
    wrap = lambda t, n: "\n".join(" ".join(w) for w in (t.split()[i : i + n] for i in range(0, len(t.split()), n)))
    texts = [
        (1, f"Copyright Jane Doe\n\n{wrap(mit, 9)}"),
        (2, f"code\n\n{wrap(gpl, 7)}\n\nmore code"),
        (3, wrap(apache, 8) + "\n\n  http://www.apache.org/licenses/LICENSE-2.0\n"),
        (4, None),
        (5, wrap(mit, 5).replace("copyright notice", "copyright\nnotice")),
        (6, "plain words " * 2000),
        (7, f"Copyright The Foo Authors. All rights reserved.\n{wrap(mit, 11)}"),
        (7, f"Copyright The Foo Authors. All rights reserved.\n{wrap(mit, 11)}"),
    ]
    df = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id long, text string, license string, digest string")
    known = license_scan.known_digests(spark)
    stems = license_scan.stems_of([x[2] for x in KNOWN])
    assert stems and all(any(s in t.lower() for s in stems) for _, _, t in KNOWN)
    for use in (stems, None):
        got = rows(license_scan.scan(df, known, use))
        assert [got[i].license for i in (1, 2, 3, 4, 5, 7)] == ["MIT", None, None, None, "MIT", "MIT"]
        assert (got[2].block_licenses, got[3].block_licenses, got[6].n_license_blocks) == ("GPL-3.0-or-later", "Apache-2.0", 0)
    assert license_scan.scan(df.limit(0), known, stems).collect() == []
    own = license_scan.digests_of(spark.createDataFrame([("mine", "do as you like with it")], "license string, text string"))
    assert rows(license_scan.scan(spark.createDataFrame([(1, "DO as you like, with it!")], "doc_id long, text string"), own))[1].license == "mine"


def test_rules_keep_clashing_columns_and_other_scripts(spark):
    text = " ".join(f"一二{i}三四" for i in range(40))
    english = " ".join(f"the cat number{i} sat on a mat" for i in range(30))
    nothing = " ".join(f"zork{i} blib{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "mine", 5, 6), (2, english, "mine", 5, 6), (3, nothing, "mine", 5, 6), (4, None, None, None, None)], "doc_id long, text string, kept string, n_words int, _w int")
    got = rows(quality_rules.with_verdict(df))
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[3].failed_rules == ["stop_words"] and got[1].stop_word_ratio is None
    assert (got[1].kept_input, got[1].n_words_input, got[1]["_w"]) == ("mine", 5, 6)


def test_language_limits_and_long_texts(spark):
    rng = np.random.default_rng(3)
    words = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "und der die das nicht werden".split()}
    labelled = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i in range(400) for lang in ("aa" if i % 2 else "bb",)]
    df = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == ["aa", "bb"] and len(model.limits) == language_id.LONGEST.bit_length()
    long = "lorem ipsum dolor " * 40_000
    odd = spark.createDataFrame([(1, "zzqx" * 30), (2, "lorem ipsum"), (3, long), (4, "123 !"), (5, None), (6, "zzqxkjw")], "doc_id long, text string")
    got = rows(language_id.predict_with(odd, model))
    assert [got[i].rejected for i in range(1, 7)] == [True, False, False, True, True, True]
    scorer = language_id.Scorer(model.models)
    whole, n = scorer.entropies([long])
    before = language_id.PIECE
    language_id.PIECE = 1000
    try:
        pieces, m = language_id.Scorer(model.models).entropies([long])
    finally:
        language_id.PIECE = before
    assert n[0] == m[0] == len(long) and np.allclose(whole, pieces, atol=1e-5)


# ---------------------------------------------------------------- odd columns


NAMES = "_keep string, _gone string, _spans int, _d int, _k string, kept string, rank int, shard int, id int, key int, row int, comp int, _BUCKET int"
OPERATORS = {
    "suffix": suffix_dedup.suffix_report,
    "lines": line_dedup.line_report,
    "without_lines": line_dedup.without_later_lines,
    "media": lambda d: media_columns.media_features(media_columns.encode_media(d)),
    "language": language_id.predict,
    "known": language_id.keep_known,
    "minhash": minhash_dedup.near_duplicates,
    "keep_first": minhash_dedup.keep_first,
    "keep_first_of_both": lambda d: minhash_dedup.keep_first(d, before=d),
    "shards": sharding.shard_documents,
    "quality": quality_rules.with_verdict,
    "mix": mixing.mixed_documents,
}


@pytest.fixture(scope="module")
def odd(spark):
    text = "the first line of this text\nand one more line of it\nyes"
    data = [(1, text, None, "s"), (None, text, "en", None), (None, None, None, None), (2, text + "\nother words", "en", "s"), (1, text, None, "s"), (3, "", "en", "t")]
    return spark.createDataFrame([(*d, None, *["x", "y", 1, 2, "k", "v", 1, 2, 3, 4, 5, 6, 7]) for d in data], f"doc_id long, text string, lang string, source string, n_chars int, {NAMES}")


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_and_clashing_names(odd, name):
    out = OPERATORS[name](odd)
    n = out.count()
    if name in ("without_lines", "known", "keep_first", "keep_first_of_both", "mix"):
        assert out.columns == odd.columns and n > 0
    else:
        assert n == 6


def test_pipeline_on_empty_and_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline

    for docs, least in ((odd, 1), (odd.limit(0), 0)):
        folder = tmp_path / str(least)
        folder.mkdir()
        docs.write.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.count() >= least and "decoded_sha256" in docs.columns


def test_pipeline_drops_near_copies(spark, tmp_path):
    """Copies whose lines were cut leave what they do not share, and go with the text that they came with."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    data, n = [], 60
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary, 12)) for _ in range(30)]
        data.append((i, "\n".join(lines), "en", "a"))
        changed = list(lines)
        changed[int(rng.integers(30))] = " ".join(rng.choice(vocabulary, 12))
        data.append((1000 + i, "\n".join(changed), "en", "a"))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.documents(spark, str(tmp_path))
    cut = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in cut.collect()) == list(range(n))
    whole = line_dedup.without_later_lines(docs)
    whole.write.parquet(f"{tmp_path}/cut")
    whole = spark.read.parquet(f"{tmp_path}/cut")
    assert whole.count() == 2 * n
    assert sorted(r.doc_id for r in minhash_dedup.keep_first(whole, before=docs).collect()) == list(range(n))


def test_cut_documents_go_to_python_in_small_pieces(odd):
    """The result is read when small_batches is over: an Arrow batch would hold 10,000 whole documents."""
    out, text = line_dedup.without_later_lines(odd), odd.first().text
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "MapInArrow" not in plan
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (0, text), (1, text), (1, text), (2, "other words"), (3, "")]


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """Later turns read the postings that the turn before kept."""
    monkeypatch.setattr(line_dedup, "TURNS", (1, 2, None))
    calls, plain = [], line_dedup.postings
    monkeypatch.setattr(line_dedup, "postings", lambda *a, **b: calls.append(1) or plain(*a, **b))
    words, at = [f"x{i}" for i in range(5000)], np.arange(5001) * 8
    h = common.word_hashes(np.frombuffer(b"".join(w.ljust(8).encode() for w in words), np.uint8), at[:-1], at[:-1] + [len(w) for w in words])
    same = [w for w, x in zip(words, h, strict=True) if x & np.uint64(127) == h[0] & np.uint64(127)]  # an even number of them leaves the parity bits as they are
    lines = [[*[f"w{k}" for k in range(16)], *same[4 * i : 4 * i + 4]] for i in range(6)]  # candidates of each other, by 16 of 24
    lines.append([*lines[3][:19], "z"])  # matches its fourth candidate, by 19 of 21
    lines += [[w] * 50 for w in same[:24]]  # these words come last in a line's order
    gone = line_dedup.gone_lines(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string"))
    assert [(r.d, r.l) for r in gone.collect()] == [(6, 0)]
    assert len(calls) == 1


def test_remnants():
    text = "One two three\nfour five six seven\neight\none TWO three\n\neight"
    assert not line_dedup.remnant(text, None, 0.2) and not line_dedup.remnant(text, [3, 5], 0.2)
    assert line_dedup.remnant(text, [0, 1, 2, 3, 5], 0.0)
    assert line_dedup.remnant(text, [0, 1, 3, 5], 0.2) and not line_dedup.remnant(text, [0, 1, 3, 5], 0.1)
    assert not line_dedup.remnant("a b c\na b c\na b c\na b c\na b c\na b c", [1, 2, 3, 4, 5], 0.2)


def test_counts_by_collection():
    assert collections.Counter(k for k, _ in minhash_dedup._PAIRS)[0] == minhash_dedup.COLLECTIONS - 1
