"""Incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of ``min_chars`` code points or more
count. The index has three tables, all in shared storage:

- postings: one row per document and key (a 128-bit digest),
- counts: for each key in ``min_docs`` documents or more, how many hold it and the largest id among them,
- filters: one cuckoo filter per shard of those keys.

``build`` makes an index, ``insert`` adds documents, ``delete`` takes documents out again and ``apply`` rewrites texts:
keys in enough documents lose all lines except in the document with the largest id. Lines ask the filter of their shard
first; only those that may be frequent reach the exact table, whose answer alone decides. ``insert`` and ``delete`` touch
the counts of the batch's own keys only, and a delete restores exactly what an insert did.

Scale: a hot line is one key; its rows are counted map-side, salted on their way through the filter over as many groups
as the postings of its shard ask for, and joined with a skew-splittable join. A filter holds a bounded number of keys, since the number of shards follows the
number of frequent keys. Texts are moved once, to meet the keys they lose.

Defined cases: null or empty text is one empty line. Rows with equal ids are one document. Rows without an id are one
document below all others. Extra columns pass through ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import SPACE, column, packed
from foliospark.operators.shared import materialise, small_side

KEYS_PER_SHARD = 250_000
POSTINGS_PER_SALT = 250_000


class CuckooFilter:
    """16-bit marks in buckets of four; a mark may sit in either of two buckets, so it can be taken out again."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = 1 << max(3, (len(keys) // 3).bit_length())
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def _mark(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") % 65535 + 1

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[:8], "little") & (len(self.table) - 1)

    def insert(self, key: bytes) -> bool:
        """False if the filter is too full; it must then be built anew from the exact table."""
        mark, at = self._mark(key), self._home(key)
        for kick in range(self.KICKS):
            for place in (at, self._other(at, mark)):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    return True
            at = self._other(at, mark)
            slot = kick % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = self._other(at, mark)
        return False

    def delete(self, key: bytes) -> bool:
        """Only for keys that were inserted."""
        mark, at = self._mark(key), self._home(key)
        for place in (at, self._other(at, mark)):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def may_hold(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
        at = (raw[:, :8].copy().view("<u8")[:, 0] & np.uint64(len(self.table) - 1)).astype(np.int64)
        mark = raw[:, 8:10].copy().view("<u2")[:, 0].astype(np.int64) % 65535 + 1
        other = (at ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[other] == mark[:, None]).any(1)


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 40
    min_docs: int = 5


def line_key(line: str, min_chars: int) -> bytes | None:
    """The digest of a line's key, or None if the key is too short to count."""
    key = line.strip(SPACE)
    return hashlib.md5(key.encode().lower(), usedforsecurity=False).digest() if len(key) >= min_chars else None


def _postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {line_key(x, min_chars) for x in text.split("\n") if len(x) >= min_chars} - {None} if text else ()
                keys += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())], ["id", "key"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary")


def _counts(postings: DataFrame, min_docs: int) -> DataFrame:
    once = postings.groupBy("key", "id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _filters(counts: DataFrame, shards: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter.of(table.column("key").to_pylist())
        return pa.table({"shard": [table.column("shard")[0].as_py()], "filter": [made.dump()]},
                        pa.schema([("shard", pa.int32()), ("filter", pa.binary())]))

    return counts.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInArrow(build, "shard int, filter binary")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> LineIndex:
    postings = materialise(_postings(docs, id_col, text_col, min_chars))
    return _indexed(postings, materialise(_counts(postings, min_docs)), min_chars, min_docs)


def _indexed(postings: DataFrame, counts: DataFrame, min_chars: int, min_docs: int) -> LineIndex:
    shards = counts.count() // KEYS_PER_SHARD + 1
    return LineIndex(postings, counts, materialise(_filters(counts, shards)), shards, min_chars, min_docs)


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over new postings, when only ``touched`` keys can have other counts."""
    touched = materialise(touched.select("key").distinct())
    fresh = materialise(_counts(postings.join(touched, "key", "left_semi"), index.min_docs))
    was = index.counts.join(touched, "key", "left_semi")
    counts = materialise(index.counts.join(touched, "key", "left_anti").union(fresh.select(*index.counts.columns)))
    delta = fresh.join(was, "key", "left_anti").select("key", F.lit(True).alias("add")).union(
        was.join(fresh, "key", "left_anti").select("key", F.lit(False).alias("add"))
    ).withColumn("shard", _shard(index.shards))
    schema = pa.schema([("shard", pa.int32()), ("filter", pa.binary())])

    def update(old: pa.Table, new: pa.Table) -> pa.Table:
        held = CuckooFilter.load(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(1024)
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        rows = list(zip(new.column("key").to_pylist(), new.column("add").to_pylist())) if new.num_rows else []
        fits = all([held.delete(k) for k, add in rows if not add]) and all(held.insert(k) for k, add in rows if add)
        return pa.table({"shard": [shard], "filter": [held.dump() if fits else None]}, schema)

    filters = materialise(index.filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(update, "shard int, filter binary"))
    if counts.count() > 2 * KEYS_PER_SHARD * index.shards or not filters.where("filter IS NULL").isEmpty():
        return _indexed(postings, counts, index.min_chars, index.min_docs)  # outgrown: from the exact table
    return LineIndex(postings, counts, filters, index.shards, index.min_chars, index.min_docs)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with more documents; their ids must not be in it yet."""
    added = materialise(_postings(docs, id_col, text_col, index.min_chars))
    return _changed(index, index.postings.union(added), added)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents whose ids are in the one column of ``ids``."""
    gone = ids.toDF("gone")
    match = F.col("id").eqNullSafe(F.col("gone"))
    lost = materialise(index.postings.join(gone, match, "left_semi"))
    return _changed(index, materialise(index.postings.join(gone, match, "left_anti")), lost)


def _maybe_frequent(index: LineIndex, postings: DataFrame) -> DataFrame:
    """Postings whose key passes the filter of its shard.

    Filters are sent ahead of the keys of their shard in one sorted stream, so a task holds one filter and one batch. A shard
    is salted by its own number of postings, so a group holds about ``POSTINGS_PER_SALT`` of them however hot a line is.
    """
    kind = postings.schema["id"].dataType.simpleString()
    sharded = postings.withColumn("shard", _shard(index.shards))
    salts = small_side(sharded.groupBy("shard").agg((F.floor(F.count("*") / POSTINGS_PER_SALT) + 1).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    keys = sharded.join(salts, "shard").select("shard", salt.alias("salt"), F.lit(1).alias("turn"), "id", "key", F.lit(None).cast("binary").alias("filter"))
    ahead = index.filters.join(salts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"),
        F.lit(None).cast(kind).alias("id"), F.lit(None).cast("binary").alias("key"), "filter",
    )
    stream = keys.union(ahead).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "turn")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            place = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            turns, start = batch.column(2).to_pylist(), 0
            while start < len(place):
                if turns[start] == 0:
                    at, held = place[start], CuckooFilter.load(batch.column(5)[start].as_py())
                    start += 1
                    continue
                stop = start
                while stop < len(place) and place[stop] == place[start] and turns[stop]:
                    stop += 1
                if place[start] == at:  # a shard without a filter holds no frequent key
                    part = batch.slice(start, stop - start)
                    hit = held.may_hold(part.column(4).to_pylist())
                    kept = part.filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([kept.column(3), kept.column(4)], ["id", "key"])
                start = stop

    return stream.mapInArrow(probe, f"id {kind}, key binary")


def apply(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, and ``n_lines`` and ``n_dropped`` under ``_n_lines`` and ``_n_dropped``."""
    hits = _maybe_frequent(index, index.postings)
    lost = hits.join(index.counts, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("id").agg(F.collect_set("key").alias("keys")).withColumnRenamed("id", "lost_id")
    rows = docs.select(packed(docs), column(id_col).alias("id"))
    met = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")), "left")
    columns, at = docs.columns, docs.columns.index(text_col)
    met = met.select(*[F.col("_row").getField(c).alias(f"c{i}") for i, c in enumerate(columns)], "keys")
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    least = index.min_chars

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                lines = (text or "").split("\n")
                if keys:
                    gone = set(keys)
                    kept = [x for x in lines if line_key(x, least) not in gone]
                    texts.append("\n".join(kept))
                else:
                    kept = lines
                    texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            out = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             [*[f"c{i}" for i in range(len(columns))], "n", "d"])

    done = met.mapInArrow(rewrite, f"{kinds}, n long, d long")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("n").alias("_n_lines"), F.col("d").alias("_n_dropped"))
