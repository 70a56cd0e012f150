"""Sharding by balanced label propagation.

Documents with links start dealt evenly and move towards the shard that most of their
neighbours are in. Moves are taken as far as shards have room; rows that leave in the same
round make room too, by exchanges between two shards and by cycles of several. All rounds are joins of edges with labels, votes
are counted by (document, shard) and moves into a shard are numbered by a distributed
prefix, so neither a shard nor a hub is ever one task's work. Links form trees, whose levels
take turns: in a round, the even or the odd levels of a tree may move, and in the next the
others; which come first is drawn anew for each tree and two rounds. So no two neighbours move at once, and each move leaves fewer links cut. The
rounds end when no document, whatever its turn, has more neighbours in another shard than in
its own, or when ``QUIET`` rounds running have together moved ``1 / FEW`` of the linked documents
or less (none, where fewer than ``FEW`` are linked).

Law ``rows``: the counts of the shards differ by one at most. After the rounds, each shard
keeps its linked documents first; rows above its quota fill the shards below theirs, in
the order of their numbers, and slots follow from the same numbers.

Equal texts are linked by a tree of degree ``FAN``: the r-th copy hangs on the copy whose
number has r's last non-zero digit (base FAN) cleared. So a group of any size has bounded
degrees, small groups end in one shard, and groups larger than a shard split into pieces of
FAN copies with few cut edges.

Defined results: null text has size 1, crc32 0 and no links; empty texts are equal texts;
rows with equal doc_ids are rows of their own (numbered in the order of their texts); extra
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import documents, materialise, prefix

SHARDS = 8
QUIET, FEW = 4, 10_000
FAN = 64


def tree_parent(rank: Column, fan: int = FAN) -> Column:
    """The number that a copy's number hangs on; null for the root."""
    out = F.lit(None).cast("long")
    step = fan
    while step < 1 << 62:
        step, last = step * fan, step
        out = F.coalesce(out, F.when(rank % last != 0, rank - rank % last))
        if step >= 1 << 62:
            break
    return out


def tree_side(rank: Column, fan: int = FAN) -> Column:
    """0 on the even and 1 on the odd levels of the tree: a level is the count of digits that are not zero."""
    level, step = F.lit(0), 1
    while step * fan < 1 << 62:
        level = level + (rank % (step * fan) >= step).cast("int")
        step *= fan
    return level % 2


def copies_tree(nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that link the nodes with equal ``key`` by a tree of bounded degree, and (id, tree, side) of the nodes with an edge; null keys link with nothing."""
    groups = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c")).where("_c > 1").select(key)
    members = nodes.join(groups, key).select("id", "doc_id", "k", F.col(key).alias("g"))
    members = materialise(prefix(members, ["g"], ["doc_id", "k"], None, "rank", buckets=256))
    low = members.select(F.col("id").alias("a"), "g", tree_parent(F.col("rank")).alias("rank")).where("rank is not null")
    edges = low.join(members.select(F.col("id").alias("b"), "g", "rank"), ["g", "rank"]).select("a", "b")
    return edges, members.select("id", F.xxhash64("g").alias("tree"), tree_side(F.col("rank")).alias("side"))


def quotas(total: int, shards: int) -> list[int]:
    """Rows of each shard."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def flows(want: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the ``want[s][t]`` rows that would go from s to t may go: no more can be added.

    No shard gets more rows than leave it and its room hold; room below 0 is filled by leaving rows first.
    """
    n = len(want)
    left, room = [list(row) for row in want], list(room)
    for s in range(n):
        for t in range(s):
            both = min(left[s][t], left[t][s])
            left[s][t] -= both
            left[t][s] -= both
    # walk until a shard comes again, and take that cycle; a shard without a way on is in none
    dead: set[int] = set()
    for start in range(n):
        path = [start] if start not in dead else []
        while path:
            on = next((t for t in range(n) if left[path[-1]][t] and t not in dead), None)
            if on is None:
                dead.add(path.pop())
            elif on in path:
                cycle = path[path.index(on) :]
                edges = list(zip(cycle, cycle[1:] + cycle[:1], strict=True))
                most = min(left[a][b] for a, b in edges)
                for a, b in edges:
                    left[a][b] -= most
                path = path[: path.index(on) + 1]
            else:
                path.append(on)
    while True:
        at = next(((s, t) for t in range(n) if room[t] > 0 for s in range(n) if left[s][t]), None)
        if at is None:
            return [[want[s][t] - left[s][t] for t in range(n)] for s in range(n)]
        s, t = at
        more = min(left[s][t], room[t])
        left[s][t] -= more
        room[t] -= more
        room[s] += more


def propagate(nodes: DataFrame, edges: DataFrame, sides: DataFrame, total: int, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(id, shard) of the nodes that have an edge, after ``rounds`` at most if given.

    ``nodes`` has id, doc_id and k; ``sides`` has id, tree and side of the
    nodes with an edge, which must join different sides of one tree.
    """
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(nodes.join(sides, "id").select("id", "doc_id", "k", "tree", "side"))
    labels = prefix(labels.withColumn("all", F.lit(0)), ["all"], ["doc_id", "k"], None, "rank").withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int"))
    labels = materialise(labels.drop("all", "rank"))
    quota = quotas(total, shards)
    few, moves = labels.count() // FEW, []
    for r in itertools.count() if rounds is None else range(rounds):
        votes = both.join(labels.select(F.col("id").alias("b"), "shard"), "b").groupBy("a", "shard").agg(F.count("*").alias("v"))
        best = votes.groupBy("a").agg(F.max(F.struct("v", (-F.col("shard")).alias("neg"))).alias("best"), F.collect_list(F.struct("shard", "v")).alias("all"))
        asked = labels.join(best, labels.id == best.a)
        own = F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: F.when(x["shard"] == F.col("shard"), x["v"]).otherwise(acc))
        turn = F.pmod(F.xxhash64("tree", F.lit(r // 2)) + r % 2, F.lit(2)) == F.col("side")
        asked = asked.withColumn("wish", F.when(F.col("best.v") > own, -F.col("best.neg")))
        asked = materialise(asked.select("id", "doc_id", "k", "tree", "side", "shard", "wish", F.when(turn, F.col("wish")).alias("to")))
        if asked.where("wish is not null").limit(1).count() == 0:
            break
        load, want = [0] * shards, [[0] * shards for _ in range(shards)]
        for row in asked.groupBy("shard", "to").count().collect():  # one row for each pair of shards
            load[row["shard"]] += row["count"]
            if row["to"] is not None:
                want[row["shard"]][row["to"]] = row["count"]
        taken = flows(want, [q - n for q, n in zip(quota, load, strict=True)])
        taken = asked.sparkSession.createDataFrame([(s, t, n) for s, row in enumerate(taken) for t, n in enumerate(row)], "shard int, to int, most long")
        movers = prefix(asked.where("to is not null").withColumn("to", F.col("to").cast("int")), ["shard", "to"], ["doc_id", "k"], None, "turn_no")
        movers = movers.join(F.broadcast(taken), ["shard", "to"]).where("turn_no < most")
        moved = asked.join(movers.select("id", F.col("to").alias("new")), "id", "left")
        labels = materialise(moved.select("id", "doc_id", "k", "tree", "side", F.coalesce("new", "shard").alias("shard"), F.col("new").isNotNull().alias("moved")))
        moves.append(labels.where("moved").count())
        labels = labels.drop("moved")
        if len(moves) >= QUIET and sum(moves[-QUIET:]) <= few:
            break
    return labels.select("id", "shard")


def balance_rows(placed: DataFrame, shards: int) -> DataFrame:
    """Exact quotas: adds shard and slot to rows with ``want`` (the shard wished for) and ``linked``."""
    counts = [0] * shards
    for row in placed.groupBy("want").count().collect():  # one row for each shard
        counts[row["want"]] = row["count"]
    total = sum(counts)
    quota = quotas(total, shards)
    ranked = prefix(placed, ["want"], ["doc_id", "k"], None, "rank", coarse=F.when(F.col("linked"), 0).otherwise(1))
    limit, before, at = F.lit(0).cast("long"), F.lit(0).cast("long"), 0
    for s in range(shards):
        limit = F.when(F.col("want") == s, F.lit(quota[s]).cast("long")).otherwise(limit)
        before = F.when(F.col("want") == s, F.lit(at).cast("long")).otherwise(before)
        at += max(0, counts[s] - quota[s])
    ranked = ranked.withColumn("extra", F.when(F.col("rank") >= limit, F.col("rank") - limit + before))
    shard, slot, at = F.col("want"), F.col("rank"), 0
    for s in range(shards):
        free = max(0, quota[s] - counts[s])
        if free:
            here = (F.col("extra") >= at) & (F.col("extra") < at + free)
            shard = F.when(here, F.lit(s)).otherwise(shard)
            slot = F.when(here, F.col("extra") - at + counts[s]).otherwise(slot)
            at += free
    return ranked.withColumns({"_shard": shard.cast("int"), "slot": slot.cast("long")}).withColumn("shard", F.col("_shard")).drop("_shard", "extra", "rank", "want")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text").cast("string")
    nodes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    nodes = nodes.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")).cast("long"))
    nodes = nodes.withColumns({"id": F.struct("doc_id", "k"), "start": F.pmod(F.xxhash64("doc_id", "k"), F.lit(shards)).cast("int")})
    nodes = materialise(nodes)
    labels = propagate(nodes, *copies_tree(nodes, "digest"), nodes.count(), shards, rounds)
    placed = nodes.join(labels.withColumnRenamed("shard", "label"), "id", "left")
    placed = materialise(placed.select("doc_id", "k", "size", "text_crc32", F.col("label").isNotNull().alias("linked"), F.coalesce("label", "start").alias("want")))
    out = balance_rows(placed, shards)
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
