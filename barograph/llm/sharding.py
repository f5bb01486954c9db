"""Sharding by balanced label propagation.

Documents that share a link key (here: equal texts) should meet in one shard. Every document starts in a shard by
hash; in each round each key names its goals: of the shards that have room those that hold most of it, one for
most keys, several for a key larger than a shard. Its documents elsewhere ask to move there, and a shard lets in
as many as its quota allows, chosen by hash. Rounds end when nobody is let in, or after ROUNDS, which bounds the
jobs, not the rows. Loners never ask; they are what the last step moves to make the counts
exactly even, after it has kept linked ones. All choices go by hashes of doc_id and text, so the layout of the
table does not matter, but for which of several equal rows goes where.

Law `rows`: shard sizes differ by one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import gapless_rank, join_skewed, materialise, table, text_bytes

SHARDS, ROUNDS = 24, 32


def _pick(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (index + 1).cast("int"))


def propagate(members: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """members(key, id, shard): the documents that have a partner. Returns them with new shards.

    A shard's quota is an even share of all `total` documents less the linked ones it holds; loners make way
    afterwards. Requests are summed to one number a shard pair before they reach the driver, shards squared
    at most.
    """
    keys = materialise(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    n = members.count()
    names = members.columns
    size = {row["shard"]: row["c"] for row in members.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    for r in range(rounds):
        room = [max(0, total // shards - size.get(s, 0)) for s in range(shards)]
        goals = _goals(members, room, max(1, total // shards // 50))
        asked = materialise(_asking(members, goals, keys, n, r), "asked")
        counts = {(row["shard"], row["goal"]): row["c"] for row in asked.groupBy("shard", "goal").agg(F.count(F.lit(1)).alias("c")).collect()}
        into = [sum(c for (_, g), c in counts.items() if g == s) for s in range(shards)]
        if not sum(into):
            return asked.select(names)
        parts = [min(1_000_000, 1_000_000 * room[s] // into[s]) if into[s] else 0 for s in range(shards)]
        let_in = F.col("goal").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1_000_000)) < _pick(F.coalesce("goal", F.lit(0)), parts))
        members = materialise(asked.withColumn("moved", let_in).withColumn("shard", F.when(let_in, F.col("goal")).otherwise(F.col("shard"))).drop("goal"), "members")
        after = members.groupBy("shard").agg(F.count(F.lit(1)).alias("c"), F.count_if("moved").alias("in")).collect()
        members = members.select(names)
        if not sum(row["in"] for row in after):
            break
        size = {row["shard"]: row["c"] for row in after}
    return members


def _goals(members: DataFrame, room: list[int], least: int) -> DataFrame:
    """key, goals: of the shards with at least `least` room those that hold most of the key, as many as it takes to hold all of it; array<struct<shard, room>>, as many as there are shards at most."""
    held = members.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("c")).withColumn("room", _pick(F.col("shard"), room))
    entry = F.struct("c", F.xxhash64("key", "shard").alias("h"), "shard", "room")
    by_key = held.groupBy("key").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.when(F.col("room") >= least, entry)), asc=False).alias("of"))
    start = F.struct(F.array().cast("array<struct<shard:int,room:bigint>>").alias("g"), F.lit(0).cast("long").alias("got"))
    add = lambda acc, x: F.when(acc["got"] >= F.col("n"), acc).otherwise(F.struct(F.array_append(acc["g"], F.struct(x["shard"].cast("int").alias("shard"), x["room"].alias("room"))).alias("g"), (acc["got"] + x["c"] + x["room"]).alias("got")))
    return by_key.select("key", F.aggregate("of", start, add, lambda acc: acc["g"]).alias("goals"))


def _asking(members: DataFrame, goals: DataFrame, keys: DataFrame, n: int, turn: int) -> DataFrame:
    """members with `goal`: null for those in a goal of their key, else one of its goals by hash, in proportion to room."""
    rows = join_skewed(members, goals, "key", keys, "n", n)
    total = F.aggregate("goals", F.lit(0).cast("long"), lambda acc, g: acc + g["room"])
    start = F.struct(F.pmod(F.xxhash64("id", F.lit(turn), F.lit("goal")), F.greatest(total, F.lit(1))).alias("left"), F.lit(None).cast("int").alias("to"))
    step = lambda acc, g: F.struct((acc["left"] - g["room"]).alias("left"), F.coalesce(acc["to"], F.when(acc["left"] < g["room"], g["shard"])).alias("to"))
    there = F.exists("goals", lambda g: g["shard"] == F.col("shard"))
    return rows.withColumn("goal", F.when(~there, F.aggregate("goals", start, step, lambda acc: acc["to"]))).drop("goals")


def _told_apart(base: DataFrame, total: int, shards: int) -> DataFrame:
    """Rows that repeat in doc_id and text get ids, and first shards, of their own: quotas and ranks split them like any others."""
    again = materialise(base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if again.isEmpty():
        return base
    rows = join_skewed(base.withColumn("row", F.monotonically_increasing_id()), again, "id", again, "n", total)
    own = F.when(F.col("n") > 1, F.xxhash64("id", "row")).otherwise(F.col("id"))
    return materialise(rows.withColumn("id", own).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).select(base.columns), "shard-base")


def assign(docs: DataFrame, shards: int = SHARDS, key: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, linked, shard, slot for each row of docs(doc_id, text, ...).

    Defined cases: a null text counts 8 bytes, checksum 0, and is linked with the other null and empty texts;
    rows that repeat are separate documents; rows without doc_id are placed by their text; fewer rows than
    shards leave shards empty; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = materialise(
        docs.select(
            F.col("doc_id").cast("long"), (text_bytes(F.col("text")) + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary")) if key is None else F.md5(key.cast("binary"))).alias("key"), F.xxhash64(F.col("doc_id").cast("long"), F.md5(text.cast("binary"))).alias("id"),
        ).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")),
        "shard-base",
    )
    total = base.count()
    base = _told_apart(base, max(1, total), shards)
    groups = materialise(base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    marked = materialise(join_skewed(base, groups, "key", groups, "n", max(1, total)).withColumn("linked", F.col("n").isNotNull()).drop("n"), "marked")
    moved = propagate(marked.where("linked"), total, shards)
    names = marked.columns
    both = materialise(moved.select(names).unionByName(marked.where(~F.col("linked"))), "propagated")
    # linked documents come first in their shard, so that only loners are moved while there are any
    ranked = gapless_rank(both.withColumn("late", (~F.col("linked")).cast("int")), ["shard", "late"], F.xxhash64("id"), [F.col("id"), F.col("doc_id"), F.col("text_crc32")], "r", min(4096, max(64, total // 1_000_000)))
    counts = {(row["shard"], row["linked"]): row["c"] for row in both.groupBy("shard", "linked").agg(F.count(F.lit(1)).alias("c")).collect()}
    first = [counts.get((s, True), 0) for s in range(shards)]
    size = [first[s] + counts.get((s, False), 0) for s in range(shards)]
    goal = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-size[s], s))[: total % shards]:
        goal[s] += 1
    over = [max(0, size[s] - goal[s]) for s in range(shards)]
    before = [sum(over[:s]) for s in range(shards)]
    free = [max(0, goal[s] - size[s]) for s in range(shards)]
    ends = [sum(free[: s + 1]) for s in range(shards)]
    place = F.col("r") + F.when(F.col("late") == 1, _pick(F.col("shard"), first)).otherwise(0)
    out = ranked.withColumn("place", place).withColumn("spare", F.col("place") - _pick(F.col("shard"), goal))
    # spare documents are numbered through all full shards and fill the free places in order
    number = F.col("spare") + _pick(F.col("shard"), before)
    to = F.when(F.col("spare") >= 0, sum((number >= e).cast("int") for e in ends))
    out = out.withColumn("number", number).withColumn("to", to)
    slot = F.when(F.col("to").isNull(), F.col("place")).otherwise(F.col("number") - _pick(F.col("to"), [e - f for e, f in zip(ends, free, strict=True)]) + _pick(F.col("to"), size))
    return out.select("doc_id", "size", "text_crc32", "linked", slot.alias("slot"), F.coalesce("to", "shard").cast("int").alias("shard"))


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_label_propagation": op1_label_propagation}
ORACLES: dict[str, str] = {}
