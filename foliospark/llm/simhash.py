"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at ``max_bits`` or fewer differing bits. They are cut into ``max_bits // 2 + 1`` segments,
the fewest for which some segment of a linked pair differs by at most one bit. Each segment is indexed as it is and once
per bit with that bit left out; equality joins on those variants find all candidates, and the join verifies them.

Scale: the text is read once and leaves 8 bytes; copies collapse to one fingerprint. Dense groups first contract
linearly around leaders, one for each value of a segment or two, and later joins only look for links between
different contracted groups, so a group of near copies is not written out as all its pairs. A segment of about 21 bits
holds the number of fingerprints over two million by chance; far beyond a few hundred million, raise ``segments``'
width by lowering ``max_bits``, since any search by these variants compares that many.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other. Texts with fewer words than a
shingle are one shingle. Rows with equal ids each keep their row. Rows without an id get the component of their
fingerprint, whose id is the smallest id in it, or null if no member has one. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import by_batch, column, connected_components
from foliospark.operators.shared import materialise, shuffled

SEED = 42
AT_ONCE = 1 << 16


def simhash(data: bytes | None, shingle: int = 4) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[-n:] if len(words) >= shingle else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    spans = zip(first, last)
    for i in range(0, n, AT_ONCE):
        hashes = np.fromiter((digest(joined[x:y], SEED) for x, y in islice(spans, AT_ONCE)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` for each row: the text's fingerprint as a signed long."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([simhash(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).cast("binary").alias("text"))
    return by_batch(rows, f"id {rows.schema['id'].dataType.simpleString()}, fp long", one)


def cuts(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    n = max_bits // 2 + 1
    at = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _variants(fp: Column, max_bits: int, side: int) -> Column:
    """Keys of a fingerprint. A pair that differs in one bit of a segment meets once: the side with a zero there
    on the left, the side with a one on the right; a pair that agrees in a segment meets under its exact key."""
    keys = []
    for s, (first, width) in enumerate(cuts(max_bits)):
        value = _segment(fp, first, width)
        keys.append(value + F.lit(s << 56))
        for i in range(width):
            without = value.bitwiseAND(F.lit(~(1 << i))) if side else value
            keys.append(F.when(value.bitwiseAND(F.lit(1 << i)) == F.lit(side << i), without + F.lit((s << 56) + (i + 1 << 48))))
    return F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull()))


def _leaders(nodes: DataFrame, max_bits: int, turn: int = 0) -> DataFrame:
    """``(a, b, ga, gb)``: nodes of ``nodes(node, fp, grp)`` and a leader of another group that is near.

    A leader is the first node, in an order that changes with ``turn``, of those that share a segment or two segments. Sharing
    two is rare but among near copies, so there the leader is one of them. Leaders are minima, summed up map-side.
    """
    keys, at = [], cuts(max_bits)
    for s, (first, width) in enumerate(at):
        own = _segment(F.col("fp"), first, width)
        keys.append(F.struct(F.lit(s).alias("s"), own.alias("x"), F.lit(0).cast("long").alias("y")))
        for t in range(s + 1, len(at)):
            keys.append(F.struct(F.lit(100 * s + t + 100).alias("s"), own.alias("x"), _segment(F.col("fp"), *at[t]).alias("y")))
    rows = nodes.select("node", "fp", "grp", F.explode(F.array(*keys)).alias("key"))
    first = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("o"), "node", "fp", "grp"))
    led = rows.groupBy("key").agg(first.alias("to"), F.count("*").alias("n")).where("n > 1")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("to.fp"))) <= max_bits) & (F.col("grp") != F.col("to.grp"))
    return shuffled(rows).join(led, "key").where(near).select(
        F.col("node").alias("a"), F.col("to.node").alias("b"), F.col("grp").alias("ga"), F.col("to.grp").alias("gb")).distinct()


def _across(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``(a, b, ga, gb)``: pairs of ``nodes(node, fp, grp)`` that are near and in different groups; each pair is met once."""
    left = nodes.select(F.col("node").alias("a"), F.col("fp").alias("x"), F.col("grp").alias("ga"), _variants(F.col("fp"), max_bits, 0).alias("key"))
    right = nodes.select(F.col("node").alias("b"), F.col("fp").alias("y"), F.col("grp").alias("gb"), _variants(F.col("fp"), max_bits, 1).alias("other"))
    diff = F.col("x").bitwiseXOR(F.col("y"))
    segment = F.shiftright(F.col("key"), 56)
    once = F.lit(True)
    for s, (first, width) in enumerate(cuts(max_bits)):
        mask = _signed(((1 << width) - 1) << first)
        once = once & ((segment <= s) | (F.bit_count(diff.bitwiseAND(F.lit(mask))) >= 2))
    exact = F.shiftright(F.col("key"), 48).bitwiseAND(F.lit(255)) == 0
    met = (F.col("key") == F.col("other")) & (F.col("ga") != F.col("gb")) & (F.bit_count(diff) <= max_bits)
    return shuffled(left).join(right, met & once & (~exact | (F.col("a") < F.col("b")))).select("a", "b", "ga", "gb")


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the groups merged that ``links(ga, gb)`` connect."""
    roots = connected_components(links.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    return materialise(nodes.join(roots, F.col("grp") == F.col("_n"), "left").withColumn("grp", F.coalesce("_root", "grp")).drop("_n", "_root"))


def components(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(fp, low, root)`` for distinct fingerprints ``(fp, low)``: ``root`` is the same for all that links connect."""
    nodes = fps.select(F.col("fp").alias("node"), "fp", "low", F.col("fp").alias("grp"))
    nodes = _merged(nodes, _leaders(nodes, max_bits))
    return _merged(nodes, _across(nodes, max_bits)).select("fp", "low", F.col("grp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``."""
    each = materialise(fingerprints(docs, id_col, text_col, shingle))
    fps = materialise(each.groupBy("fp").agg(F.min("id").alias("low")))
    rooted = components(fps, max_bits)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return each.join(named, "fp").select("id", "fp", "component_id")
