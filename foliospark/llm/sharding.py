"""Sharding by sampled splitters: shards of near-equal size over records in key order.

The key is a digest of the text, so equal texts stand side by side, then one of the id, then the id. A record weighs its
size and the mean size, so that many small records count as well as few large ones. A weighted sample of keys gives
quantile boundaries, records fall into the ranges between them, exact weights per range are summed, and ranges that hold
more than twice their share (a text with many copies) are subdivided, by the digest of the id where one key fills them. A record's shard follows from the exact bytes before it, so sampling decides how work is dealt out
and never the result; a shard's size is off by no more than one record.

Scale: the text is read once and leaves five numbers. Windows run inside a subrange, whose share of the bytes and of the
rows is bounded (a third of all rows may be empty); offsets come from one row per subrange. A range of its fair weight
holds ``RANGE_ROWS`` records at most; splitters are found in a sample of ``SAMPLE`` draws a range, in one aggregate.

Defined cases: a null text has no bytes and stands where the empty text stands. Rows that agree in text and id are
interchangeable. A null id is an id of its own. An empty table has no shards. Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import column
from foliospark.operators.shared import materialise, running

RANGE_ROWS, SAMPLE, KEY_BITS = 250_000, 64, 52


def digest_key(value: Column) -> Column:
    """A long of 52 bits, which a double holds exactly."""
    return F.conv(F.substring(F.md5(value), 1, 13), 16, 10).cast("long")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(column(text_col), F.lit("")).cast("binary")
    return docs.select(
        column(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"),
        digest_key(text).alias("k1"), digest_key(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")).alias("k2"),
    )


def splitters(rows: DataFrame, mean: float, fair: float, n_ranges: int) -> list[int]:
    """Quantile boundaries of a weighted sample; a key that fills several ranges is fenced in by itself."""
    even = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) / float(1 << 30)
    draws = F.floor((F.col("size") + F.lit(mean)) * F.lit(SAMPLE / fair) + even).cast("long")
    sample = rows.select("k1", draws.alias("draws")).where("draws > 0")
    at = F.percentile("k1", F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)]), F.col("draws"))
    found = [int(x) for x in sample.agg(at.alias("at")).first()["at"] or []]
    return sorted({*found, *[b + 1 for a, b in zip(found, found[1:]) if a == b]})


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at or below the key, by bisection in an array that is folded into one literal."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["low"] < s["high"]) & (F.get(held, middle) <= key)
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(below | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda s: s["low"])


def parted(rows: DataFrame, total: int, n: int, n_ranges: int) -> DataFrame:
    """``rows`` with their ``range`` and, inside it, ``part``; in key order both, and neither far above its fair weight."""
    mean, fair = total / max(n, 1), 2 * total / n_ranges
    ranged = rows.withColumn("range", _range_of(F.col("k1"), splitters(rows, mean, fair, n_ranges)))
    weight = F.sum("size") + F.count("*") * F.lit(mean)
    held = ranged.groupBy("range").agg(weight.alias("held"), F.min("k1").alias("low"), F.max("k1").alias("high"))
    held = held.select("range", "low", "high", F.when(F.col("held") > 2 * fair, F.ceil(F.col("held") / F.lit(fair))).otherwise(1).alias("parts"))
    inside = F.when(F.col("low") == F.col("high"), F.col("k2") / float(1 << KEY_BITS)).otherwise(
        (F.col("k1") - F.col("low")) / (F.col("high") - F.col("low") + 1))
    return ranged.join(held, "range").withColumn("part", F.floor(inside * F.col("parts"))).drop("low", "high", "parts")


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(id, size, crc, shard, slot)`` for each row of ``docs``."""
    rows = materialise(records(docs, id_col, text_col))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 1
    dealt = materialise(parted(rows, total, n, max(8 * n_shards, ceil(2 * n / range_rows))))
    sums = materialise(dealt.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    sums = running(sums, [], ["range", "part"], {"bytes_to": "bytes", "rows_to": "rows"})
    offsets = sums.select("range", "part", (F.col("bytes_to") - F.col("bytes")).alias("bytes_at"), (F.col("rows_to") - F.col("rows")).alias("rows_at"))
    order = Window.partitionBy("range", "part").orderBy("k1", "k2", "id")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("bytes_at")
    placed = dealt.join(offsets, ["range", "part"]).select(
        "id", "size", "crc", before.alias("before"), (F.row_number().over(order) - 1 + F.col("rows_at")).alias("at"))
    middle = F.expr(f"((2 * before + size) * {n_shards}L) div {2 * total}L")
    placed = materialise(placed.select("id", "size", "crc", "at", F.least(middle, F.lit(n_shards - 1)).cast("int").alias("shard")))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("id", "size", "crc", "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", files: int = 16) -> None:
    """Whole rows in one folder per shard, in ``files`` files each; ids must be unique."""
    placed = shards(docs, n_shards, id_col, text_col).select(F.col("id").alias("_shard_id"), "shard", "slot")
    rows = docs.join(placed, column(id_col).eqNullSafe(F.col("_shard_id"))).drop("_shard_id")
    spread = F.pmod(F.col("slot"), F.lit(files))
    rows.repartition(n_shards * files, "shard", spread).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
