"""Mixing sources to target weights, with DataFrame operations only.

The words of each source form a stream (documents in a fixed pseudorandom order) that is
packed into blocks of ``block_words`` words. A source's target fixes how many block slots
it fills: whole epochs of its blocks, then a part of one more, whose last slot may be cut
short so that the words taken meet the target.

Draws: the slots of all sources go through one pseudorandom permutation, and each
``shard_slots`` places in a row are an output shard. So a shard's counts of the sources are
multinomial draws with the targets as weights, conditioned on the totals of all shards being
the targets themselves. The counts are a table of their own (``draws``); a shard's slots are
numbered from it, inside each source, and get places inside the shard by a permutation too.
A slot finds its block through the source's own permutation of block indices (swap-or-not
rounds, a bijection of any 0..n-1), and blocks are joined by index.

No group is put into one task: offsets of the streams come from ``prefix`` (hash buckets),
ranks and sums over all sources from ``running`` (ranges), and slots are generated in chunks.

Defined results: null texts and texts without words have size 0 and taken 0; a null source
is a source of its own, after all others; null doc_ids are a doc_id of their own; rows with
equal doc_ids are documents of their own, those that are equal in text and source too are
numbered and interchangeable; an empty table gives an empty result; columns of the input are not passed
on by ``mix`` (so names cannot clash) and are all kept by ``mixed_documents``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import documents, fresh, materialise, n_words_col, prefix, running

#: Words of a block, and slots of an output shard.
BLOCK_WORDS = 512
SHARD_SLOTS = 4096
CHUNK = 1024
WEIGHTS = (5, 2, 1)
CAP = 3
ROUNDS = 8

_S = ["s_null", "s"]
#: What tells documents apart: doc_id (with a flag for null), hash of text and source, and a number among rows equal in these.
_ID = ["d_null", "d", "h", "k"]


def _identity(docs: DataFrame, numbered: bool) -> dict[str, Column]:
    """The columns of ``_ID`` over those of ``docs``; ``numbered``: some rows are equal in all but the number."""
    key = [docs["doc_id"].isNull(), F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), F.xxhash64(docs["text"].cast("string"), docs["source"].cast("string"))]
    k = F.row_number().over(Window.partitionBy(*key).orderBy(key[1])) - 1 if numbered else F.lit(0)
    return dict(zip(_ID, [*key, k.cast("int")], strict=True))


def _has_repeats(docs: DataFrame) -> bool:
    key = _identity(docs, False)
    return docs.select(*[v.alias(n) for n, v in key.items()]).groupBy(*_ID).count().where("count > 1").limit(1).count() > 0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its size, weight and target words.

    With all capped sources taken out, the rest share what is left by weight; sorted by
    cap / weight, the first k capped are found from prefix sums, which is the fixed point
    of resharing the excess until no target is above its cap.
    """
    per = sizes.groupBy(*_S).agg(F.sum("size").alias("source_size"))
    per = running(per, _S, {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumns({"weight": weight, "cap": F.col("source_size") * cap}).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = running(per, ["ratio", *_S], {"caps": F.col("cap"), "used": F.col("weight")})
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("caps")) / (F.lit(whole["weight"]) - F.col("used"))
    # the first source in this order whose cap is above the level fixes the level of all that follow
    top = per.withColumn("level", level).where("ratio >= level").agg(F.min(F.struct("ratio", *_S, "level"))["level"]).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(top).cast("double") * F.col("weight"))
    return per.select(*_S, "source_size", F.col("weight").cast("double").alias("weight"), F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def permute(index: Column, n: Column, key: list[Column], rounds: int = ROUNDS) -> Column:
    """The image of ``index`` under a permutation of 0..n-1 chosen by ``key`` (swap-or-not rounds).

    A fold over the rounds keeps the expression small however often it is copied by the optimizer.
    """

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r, F.greatest(x, other), *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def slot_counts(per: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """Per source: words to take, blocks, whole blocks, epochs, words of the last epoch, slots and the first of them among all; and how many slots there are."""
    take = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * CAP).cast("long")
    per = per.where("source_size > 0").withColumn("take", take)
    per = per.withColumns({"n_blocks": F.ceil(F.col("source_size") / block_words), "n_full": F.floor(F.col("source_size") / block_words), "epochs": F.floor(F.col("take") / F.col("source_size"))})
    per = per.withColumn("rest", F.col("take") - F.col("epochs") * F.col("source_size"))
    per = per.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words)).where("n_slots > 0")
    per = running(per, _S, {"first_slot": F.col("n_slots")})
    return per, per.agg(F.sum("n_slots")).first()[0] or 0


def _tasks(slots: int) -> int:
    return max(1, -(-slots // (64 * CHUNK)))


def draws(per: DataFrame, slots: int, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """(shard, source, n): how many slots of a shard each source fills; per source the shards add up to its slots."""
    out = per.select(*_S, "n_slots", "first_slot", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n_slots") - 1) / CHUNK).cast("long"))).alias("chunk"))
    out = out.repartition(_tasks(slots), *_S, "chunk")
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("n_slots")) - 1
    out = out.select(*_S, "first_slot", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("slot"))
    place = permute(F.col("first_slot") + F.col("slot"), F.lit(max(slots, 1)).cast("long"), [F.lit(seed)])
    return out.select(*_S, F.floor(place / shard_slots).alias("shard")).groupBy("shard", *_S).agg(F.count("*").alias("n"))


def slots(per: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """All slots of the mix: shard, place in it, source, slot of the source, epoch, block, words taken from the block's start.

    Whole blocks are permuted; a source's short last block keeps the last index, so the words
    before a slot of an epoch are known from its number.
    """
    per, total = slot_counts(per, block_words)
    per = materialise(per)
    drawn = materialise(draws(per, total, shard_slots, seed))
    drawn = prefix(drawn, _S, ["shard"], "n", "first")
    # a shard has at most as many sources as slots
    inside = Window.partitionBy("shard").orderBy(*_S)
    drawn = drawn.withColumns({"before": F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")), "size": F.sum("n").over(Window.partitionBy("shard"))})
    out = drawn.join(per, _S).repartition(_tasks(total), "shard", *_S)
    out = out.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = out.withColumns({"slot": F.col("first") + F.col("j"), "place": permute(F.col("before") + F.col("j"), F.col("size"), [F.lit(seed), F.col("shard")])})
    out = out.withColumns({"epoch": F.floor(F.col("slot") / F.col("n_blocks")), "block": F.pmod(F.col("slot"), F.col("n_blocks"))})
    room = F.col("source_size") - F.col("block") * block_words
    left = F.when(F.col("epoch") < F.col("epochs"), F.lit(block_words).cast("long")).otherwise(F.col("rest") - F.col("block") * block_words)
    out = out.withColumn("words", F.least(F.lit(block_words).cast("long"), room, left))
    image = permute(F.col("block"), F.greatest(F.col("n_full"), F.lit(1).cast("long")), [F.col("s_null"), F.col("s"), F.col("epoch")])
    out = out.withColumn("block", F.when(F.col("block") < F.col("n_full"), image).otherwise(F.col("block")))
    return out.select("shard", "place", *_S, "slot", "epoch", "block", "words")


def pieces(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The blocks that a document has words in: document, source, block, [a, b) inside the block, and the first word's number in the document."""
    laid = prefix(sizes.where("size > 0"), _S, _ID, "size", "off")
    first, last = F.col("off").cast("long"), (F.col("off") + F.col("size") - 1).cast("long")
    out = laid.withColumn("block", F.explode(F.sequence(F.floor(first / block_words), F.floor(last / block_words))))
    start = F.col("block") * block_words
    out = out.withColumns({"a": F.greatest(F.col("off"), start) - start, "b": F.least(F.col("off") + F.col("size"), start + block_words) - start})
    return out.withColumn("at", F.greatest(start - F.col("off"), F.lit(0).cast("long"))).select(*_S, *_ID, "size", "block", "a", "b", "at")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, taken): taken has a row for each piece of a document in each slot of the mix.

    A piece is ``n`` words of the document from number ``at``; ``shard`` and ``place`` say where the slot stands in the mix.
    """
    own = _identity(docs, _has_repeats(docs))
    sizes = docs.select(*[v.alias(n) for n, v in own.items()], docs["source"].isNull().alias("s_null"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("s"), n_words_col(docs["text"]).alias("size"))
    sizes = materialise(sizes)
    per = materialise(targets(sizes, weights))
    filled = slots(per, block_words, shard_slots)
    got = pieces(sizes, block_words).join(filled.select("shard", "place", *_S, "epoch", "block", "words"), [*_S, "block"])
    got = got.withColumn("n", F.greatest(F.lit(0).cast("long"), F.least("b", "words") - F.col("a")))
    return sizes, per, got.where("n > 0").select(*_ID, "size", "shard", "place", "epoch", "at", "n")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, per, got = mix(documents(spark, sf_dir))
    taken = got.groupBy(*_ID).agg(F.sum("n").alias("taken"), F.min("shard").alias("first_shard"), F.count_distinct("shard").alias("n_shards"))
    out = sizes.join(F.broadcast(per) if per.count() <= 10_000 else per, _S).join(taken, _ID, "left")
    doc_id = F.when(~F.col("d_null"), F.col("d")).alias("doc_id")
    none = F.lit(0).cast("long")
    return out.select(doc_id, F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", none).alias("taken"), "first_shard", F.coalesce("n_shards", none).alias("n_shards"))


def _cut(text: Column, spans: Column) -> Column:
    """The text of the words in sorted, joined spans (at, n); a word keeps the white space before it."""
    tokens = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.btrim(F.array_join(F.transform(spans, lambda x: F.array_join(F.slice(tokens, (x["at"] + 1).cast("int"), x["n"].cast("int")), "")), "\n"), F.lit(" \t\n\x0b\f\r"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents: a row for each document and epoch with a word taken.

    An epoch that takes all words of a document keeps its text; one that takes some keeps the
    words of the blocks taken, in their order. Columns are those of ``docs``; n_chars, if
    there, is that of the new text. Documents without words are not in the mix.
    """
    _, _, got = mix(docs, block_words, weights)
    names = docs.columns
    keys = [fresh(names, f"_{c}") for c in _ID]
    spans, rows = fresh(names, "_spans"), fresh(names, "_epochs")
    # a row's epochs are CAP at most, each with the blocks of one document
    span = F.struct(F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"))
    plan = got.groupBy(*_ID, "epoch").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.sum("n").alias("n"), F.first("size").alias("size"))
    plan = plan.select(*[F.col(c).alias(k) for c, k in zip(_ID, keys, strict=True)], F.when(F.col("n") < F.col("size"), F.col("spans")).alias(spans))
    own = _identity(docs, _has_repeats(docs))
    out = docs.select("*", *[v.alias(k) for k, v in zip(keys, own.values(), strict=True)]).join(plan, keys)
    out = out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(_cut(F.col("text"), F.col(spans))))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def oracle_sql() -> None:
    """The draws are hashes that SQL engines do not share; tested against the contract instead."""
    return None
