"""Mixing sources to target weights: fixed-length blocks of words, drawn in shards through pseudorandom permutations.

Sources in code point order, null last, weigh 1, 2, 3 and so on in turn. They share all words by weight, each up to
``MAX_EPOCHS`` times its own words; what is cut off is shared again by weight until no source is above. The documents
of a source, in the order of a hash, are one stream of words that is cut into blocks of ``BLOCK_WORDS``. The mix is a
number of slots, each filled with one block, so many slots to an output shard. Which source fills a slot is drawn
without replacement from all slots (a pseudorandom permutation of the slots over the sources' intervals), so the counts
of a shard are multinomial given the sums, and each source's sum is within a block of its target. The slots of a source
run through its blocks in epochs, each by a permutation of its own, and blocks are joined by that index.

Scale: texts leave one number. Running sums per source are range-partitioned, so a source with a third of all rows is
many tasks. Permutations are arithmetic on a row; nothing is sorted or collected but one row of sums. All joins are on
(source, block) and even.

Defined cases: null or empty texts have size 0 and are never taken. A null source is a source, the last one. Rows with
equal ids keep their rows. An empty table gives none; a source without words gets target 0. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, column, n_words
from foliospark.operators.shared import materialise, running, shuffled

BLOCK_WORDS, SHARD_SLOTS, MAX_EPOCHS, WALKS = 64, 1024, 3, 24


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n - 1: a Feistel network over a grid of A x B >= n cells,
    walked on where it leaves the range. Fewer than A cells are outside, so ``WALKS`` steps always suffice for small n
    and fail for large n with a probability below 24 to the power of -24."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def turn(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 1, F.struct(((s["l"] + F.pmod(F.xxhash64(seed, i, s["r"]), a)) % a).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + F.pmod(F.xxhash64(seed, i, s["l"]), b)) % b).alias("r")))

    def once(y: Column) -> Column:
        cell = F.struct(F.floor(y / b).cast("long").alias("l"), (y % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), cell, turn, lambda s: s["l"] * b + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x.cast("long"),
                       lambda y, i: F.when((i > 1) & (y < n), y).otherwise(once(y)))


@dataclass(frozen=True)
class Mix:
    """``sources(key, source, source_size, target, blocks, slots)``, ``rows(id, key, size, end)`` where ``end`` is where a
    document ends in its source's stream, and ``slots(shard, slot, key, epoch, block)``."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame
    block_words: int


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(key, source_size, weight, target)`` for rows ``(key, size)``; keys sort as sources do."""
    per = materialise(sizes.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)))
    weighed = running(per, [], ["key"], {"at": "one"}).select(
        "key", "source_size", ((F.col("at") - 1) % 3 + 1).cast("long").alias("weight"))
    weighed = materialise(weighed.withColumn("most", F.col("source_size") * max_epochs).withColumn("ratio", F.col("most") / F.col("weight")))
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    swept = running(weighed, [], ["ratio", "key"], {"most_to": "most", "weight_to": "weight"})
    left, open_ = F.lit(total or 0) - (F.col("most_to") - F.col("most")), F.lit(weights or 0) - (F.col("weight_to") - F.col("weight"))
    full = swept.where(left / open_ > F.col("ratio")).agg(F.max("most_to"), F.max("weight_to")).first()
    level = ((total or 0) - (full[0] or 0)) / max(1, (weights or 0) - (full[1] or 0))
    return weighed.select("key", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
        block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_epochs: int = MAX_EPOCHS) -> Mix:
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), column(source_col)), F.lit("~"))  # "=" sorts before "~": null last
    sized = materialise(docs.select(column(id_col).alias("id"), key.alias("key"), n_words(column(text_col)).alias("size")))
    sources = targets(sized, max_epochs)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    sources = materialise(sources.withColumn("blocks", blocks).withColumn("slots", slots))
    sources = materialise(running(sources, [], ["key"], {"slots_to": "slots"}))
    ordered = sized.withColumn("h", F.xxhash64(F.lit(seed), "id")).where("size > 0")
    rows = materialise(running(ordered, ["key"], ["h", "id", "size"], {"end": "size"}).select("id", "key", "size", "end"))
    empty = sized.where("size = 0").select("id", "key", "size", F.lit(0).cast("long").alias("end"))

    n = sources.agg(F.sum("slots")).first()[0] or 0
    stride = n // 1024 + 1  # a slot meets only the sources whose interval reaches into its stretch
    places = sources.where("slots > 0").select("key", "blocks", (F.col("slots_to") - F.col("slots")).alias("begin"), F.col("slots_to").alias("stop"))
    places = places.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("begin") / stride), F.floor((F.col("stop") - 1) / stride))))
    drawn = spark.range(n).select("id", permuted(F.col("id"), F.lit(max(1, n)), F.lit(seed)).alias("v"))
    drawn = drawn.withColumn("stretch", F.floor(F.col("v") / stride))
    met = drawn.join(places, "stretch").where((F.col("v") >= F.col("begin")) & (F.col("v") < F.col("stop")))
    nth = F.col("v") - F.col("begin")
    met = met.select(F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("slot"), "key", "blocks",
                     F.floor(nth / F.col("blocks")).alias("epoch"), (nth % F.col("blocks")).alias("nth"))
    block = permuted(F.col("nth"), F.col("blocks"), F.xxhash64(F.lit(seed), "key", "epoch"))
    return Mix(sources, rows.union(empty), met.select("shard", "slot", "key", "epoch", block.alias("block")), block_words)


def pieces(mixed: Mix) -> DataFrame:
    """``(key, end, size, block, from_word, words)``: what of a document lies in which block; ``from_word`` counts in the document."""
    size = mixed.block_words
    start = F.col("end") - F.col("size")
    cut = mixed.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / size), F.floor((F.col("end") - 1) / size))))
    first, last = F.greatest(start, F.col("block") * size), F.least(F.col("end"), (F.col("block") + 1) * size)
    return cut.select("id", "key", "end", "size", "block", (first - start).alias("from_word"), (last - first).alias("words"))


def taken(mixed: Mix) -> DataFrame:
    """``(id, key, size, taken)`` for each document: the words the mix takes, repeats counted."""
    uses = mixed.slots.groupBy("key", "block").agg(F.count("*").alias("uses"))
    per = shuffled(pieces(mixed)).join(uses, ["key", "block"]).groupBy("key", "end").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    per = per.select(F.col("key").alias("_key"), F.col("end").alias("_end"), "taken")
    rows = mixed.rows.join(per, (F.col("key") == F.col("_key")) & (F.col("end") == F.col("_end")) & (F.col("size") > 0), "left")
    return rows.select("id", "key", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def block_texts(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(shard, slot, key, block, text)``: the words of every slot's block, one space between; ids must be unique."""
    words = docs.select(column(id_col).alias("_id"), F.regexp_extract_all(column(text_col), F.lit(WORD), F.lit(0)).alias("w"))
    cut = pieces(mixed).join(words, F.col("id").eqNullSafe(F.col("_id"))).select(
        "key", "block", "end", F.array_join(F.slice("w", (F.col("from_word") + 1).cast("int"), F.col("words").cast("int")), " ").alias("part"))
    filled = cut.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("end", "part"))).alias("parts"))
    filled = filled.select("key", "block", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"))
    return mixed.slots.join(filled, ["key", "block"]).select("shard", "slot", "key", "block", "text")
