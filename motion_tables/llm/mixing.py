"""Mixing sources to target weights, in DataFrame operations alone.

Every source's texts, in a fixed order, are one stream of words, packed into blocks of a fixed length.  A source's quota of slots is its target in blocks of
its own mean length, so that a short last block counts as what it is.  Output shards have a fixed number of slots; a shard's
counts of the sources are a multinomial draw, one seeded draw a slot, with the quotas as weights.  Then totals are settled: sources drawn too often give up slots in all shards
alike, and the places left open go to those drawn too rarely.  A source's slots are numbered from shard to shard, and slot j takes the
block that a pseudorandom permutation of the source's blocks puts at j modulo their number (one
permutation for each time around).  Blocks meet their texts by a join on (source, block index).

No source is ever sorted or numbered in one task: rows are dealt into buckets by their ids'
hashes, numbered within a bucket, and a bucket's place in its source's stream comes from the sums of the buckets before it.  Tables with a row a
source, or a row a shard, are numbered in one task.  What is settled and what is drawn are stored tables, so that the driver never holds the plan of the whole mix.  Everything is a function of the rows and the seed, so reruns and redone tasks agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import row_key, stored

WHITE = " \t\n\x0b\x0c\r"
ROUNDS = 6
#: Slots that are made from one row.
PIECE = 1 << 16
CELLS = 4096


class Mix(NamedTuple):
    """rows: one per text, with its place; sources: sizes and targets; counts: the draws of each shard (shard, src, drawn); slots: the blocks that the mix takes, by shard."""

    rows: DataFrame
    sources: DataFrame
    counts: DataFrame
    slots: DataFrame


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six white-space characters; null counts 0."""
    return F.coalesce(F.size(F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")), F.lit(0)).cast("long")


def _number(of: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(F.md5(of), 1, digits), 16, 10).cast("long")


def _text(*parts) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def targets(sizes: DataFrame, weights: tuple[float, ...], repeats: float) -> DataFrame:
    """sizes (src, source, source_size) with the target of each source.

    Weights go round the sources by code point, null last.  A target stops at ``repeats`` times its source;
    the excess is shared again by weight: with the sources in order of repeats * size / weight, those are at
    their limit whose limit is under the level that the rest would share.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats).withColumn("all", F.sum("source_size").over(every).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    out = out.withColumn("full", F.col("most") < F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return out.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * level))).drop("weight", "most", "all", "level", "full")


def drawn(sources: DataFrame, total: int, shards: int, seed: str) -> DataFrame:
    """Counts of the sources (src, offset, quota) in each shard: shard, src, drawn.  Each of a shard's slots draws a number under ``total``, which falls to the source whose stretch of numbers holds it."""
    spark, cell = sources.sparkSession, max(1, -(-total // CELLS))
    slot = spark.range(total).withColumnRenamed("id", "at")
    number = F.pmod(_number(_text(seed, "draw", F.col("at"))), F.lit(max(1, total)))
    slot = slot.select(F.floor(F.col("at") / _per_shard(total, shards)).cast("int").alias("shard"), number.alias("number")).withColumn("cell", F.floor(F.col("number") / cell).cast("long"))
    last = F.col("offset") + F.col("quota")
    held = sources.where("quota > 0").select("src", "offset", last.alias("last"), F.explode(F.sequence(F.floor(F.col("offset") / cell).cast("long"), F.floor((last - 1) / cell).cast("long"))).alias("cell"))
    met = slot.join(held, "cell").where((F.col("number") >= F.col("offset")) & (F.col("number") < F.col("last")))
    return met.groupBy("shard", "src").agg(F.count("*").alias("drawn"))


def _per_shard(total: int, shards: int) -> int:
    return max(1, -(-total // shards))


def each(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for each number from low to before high: first for each piece of them, dealt over tasks, so that no array and no task holds more than a piece."""
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((high - low - 1) / PIECE))).alias("_piece")
    dealt = df.where(high > low).withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).select("*", piece)
    dealt = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_low", "_high", "_piece")  # a number, for pieces are small rows that adaptive execution would put together
    first = F.col("_low") + F.col("_piece") * PIECE
    return dealt.select("*", F.explode(F.sequence(first, F.least(F.col("_high"), first + PIECE) - 1)).alias(name)).drop("_low", "_high", "_piece")


def settled(counts: DataFrame, sources: DataFrame, total: int, shards: int) -> DataFrame:
    """Slots of each source in each shard, src, shard, low, high (slots low to high - 1 of the source), so that each source has its quota and each shard its slots."""
    spark, size = sources.sparkSession, _per_shard(total, shards)
    every = Window.partitionBy("src")
    cut = lambda so_far: so_far - F.floor(F.col("over") * so_far / F.col("all")).cast("long")
    own = counts.join(sources.select("src", "quota"), "src").withColumn("all", F.sum("drawn").over(every)).withColumn("so_far", F.sum("drawn").over(every.orderBy("shard")))
    own = own.withColumn("over", F.greatest(F.col("all") - F.col("quota"), F.lit(0)))
    own = own.select("src", "shard", cut(F.col("so_far") - F.col("drawn")).alias("low"), cut(F.col("so_far")).alias("high"))
    row = Window.orderBy("k")
    begins = lambda n: F.sum(n).over(row) - F.col(n)
    units = lambda df, n: each(df.where(F.col(n) > 0).withColumn("begin", begins(n)), F.col("begin"), F.col("begin") + F.col(n), "unit")
    room = F.least(F.lit(size), F.lit(total) - F.col("id") * size)
    there = spark.range(-(-total // size)).join(own.groupBy(F.col("shard").cast("long").alias("id")).agg(F.sum(F.col("high") - F.col("low")).alias("full")), "id", "left")
    open_in = units(there.select(F.col("id").alias("k"), F.col("id").cast("int").alias("shard"), (room - F.coalesce("full", F.lit(0))).alias("n")), "n").select("unit", "shard")
    got = own.groupBy("src").agg(F.max("high").alias("got"))
    lack = sources.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    lack = units(lack.select(F.col("src").alias("k"), "src", "got", (F.col("quota") - F.col("got")).alias("n")), "n").select("unit", "src", (F.col("got") + F.col("unit") - F.col("begin")).alias("low"))
    late = open_in.join(lack, "unit").select("src", "shard", "low", (F.col("low") + 1).alias("high"))
    return own.where("high > low").union(late)


def mix_sources(
    docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeats: float = 3.0, block_words: int = 128, shards: int = 64, seed: str = "mix-1", bucket_digits: int = 3
) -> Mix:
    """Takes from each source of docs (doc_id, text, source; others are carried by none of the tables) words near its target.

    rows: rkey (a key of the row, equal for equal rows), doc_id, source, size, source_size, target, and the row's place: src, bucket, n (unique together) and start, its
    first word in the source's stream.  sources: src, source, source_size, target, blocks, quota, offset.  counts: shard, src, drawn.  slots: src, block, turn, slot, shard.

    A source's taken words differ from its target by under a block's words, and by nothing where the target is a multiple of its size.  A null or empty text has size 0 and takes no part; a null source is a source of its own, last in
    order; rows with null or repeated ids each keep a place.  No block is taken more than ``ceil(repeats)`` times.
    If no source has words all targets are 0.  An empty table gives empty tables.
    """
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    bucket = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, bucket_digits)
    rows = docs.select("doc_id", "source", src.alias("src"), bucket.alias("bucket"), word_count(F.col("text")).alias("size"), row_key().alias("rkey"))
    order = Window.partitionBy("src", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "rkey")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    buckets = docs.select("source", src.alias("src"), bucket.alias("bucket"), word_count(F.col("text")).alias("size")).groupBy("src", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    buckets = stored(buckets, "buckets")
    sizes = buckets.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    sources = targets(sizes, weights, repeats)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5), F.col("blocks") * F.ceil(F.lit(repeats)))).otherwise(0).cast("long")
    sources = sources.withColumn("blocks", blocks).withColumn("quota", quota)
    sources = stored(sources.withColumn("offset", F.sum("quota").over(Window.orderBy("src")) - F.col("quota")), "sources")
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    along = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.drop("source").withColumn("place", F.coalesce(F.sum("words").over(along), F.lit(0))).join(sources.select("src", "source_size", "target"), "src")
    rows = rows.join(placed.select("src", "bucket", "place", "source_size", "target"), ["src", "bucket"])
    rows = rows.select("rkey", "doc_id", "source", "size", "source_size", "target", "src", "bucket", "n", (F.col("place") + F.col("before")).alias("start"))

    counts = stored(drawn(sources, total, shards, seed), "counts")
    own = stored(settled(counts, sources, total, shards), "settled").join(sources.select("src", "blocks"), "src")
    keys = F.array(*[F.pmod(_number(_text(seed, F.col("src"), "key", r)), F.col("blocks")) for r in range(ROUNDS)])
    slots = each(own, F.col("low"), F.col("high"), "slot").select("src", "shard", "blocks", keys.alias("keys"), "slot")
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")

    def swapped(state: Column, key: Column) -> Column:
        """One round of a swap-or-not shuffle: a place and its partner change places if the hash of the larger one says so."""
        place = state["place"]
        partner = F.pmod(key - place, F.col("blocks"))
        swap = F.substring(F.md5(_text(seed, F.col("src"), turn, state["round"], F.greatest(place, partner))), 1, 1) < "8"
        return F.struct((state["round"] + 1).alias("round"), F.when(swap, partner).otherwise(place).alias("place"))

    begin = F.struct(F.lit(0).alias("round"), F.pmod(F.col("slot"), F.col("blocks")).alias("place"))
    block = F.aggregate("keys", begin, swapped)["place"]
    slots = slots.select("src", block.alias("block"), turn.alias("turn"), "slot", "shard")
    return Mix(rows, sources, counts, slots)


def pieces(mix: Mix, block_words: int = 128) -> DataFrame:
    """The rows of a mix, one row for each block that they reach into: src, block, words there (null for a row without words)."""
    last = F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words).cast("long"), F.floor((last - 1) / block_words).cast("long")))
    out = mix.rows.select("*", F.explode_outer(blocks).alias("block"))
    words = F.least(last, (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    return out.withColumn("words", words)


def taken(mix: Mix, block_words: int = 128) -> DataFrame:
    """One row per text: rkey, doc_id, source, size, source_size, target, taken (words, repeats counted), first_shard (null if none)."""
    draws = stored(mix.slots.groupBy("src", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard")), "draws")
    met = pieces(mix, block_words).join(draws, ["src", "block"], "left")
    row = ["rkey", "doc_id", "source", "size", "source_size", "target", "src", "bucket", "n"]
    out = met.groupBy(*row).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"), F.min("shard").alias("first_shard"))
    return out.drop("src", "bucket", "n")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with size, source_size, target and taken of every row (columns of these names are replaced); rows that the mix leaves out have taken 0."""
    block_words = how.get("block_words", 128)
    new = ["size", "source_size", "target", "taken"]
    twin = Window.partitionBy("_mix_key").orderBy("_mix_key")  # equal rows differ in nothing but their number
    got = taken(mix_sources(docs, **how), block_words).select(F.col("rkey").alias("_mix_key"), *new).withColumn("_mix_twin", F.row_number().over(Window.partitionBy("_mix_key").orderBy("taken")))
    keyed = docs.drop(*new).withColumn("_mix_key", row_key()).withColumn("_mix_twin", F.row_number().over(twin))
    return keyed.join(got, ["_mix_key", "_mix_twin"]).drop("_mix_key", "_mix_twin")
