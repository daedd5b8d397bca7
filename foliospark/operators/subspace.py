"""Dense document vectors from a wide sparse space by a randomised range finder.

Texts are bags: one row ``doc_id, slot, tf`` for each document, with arrays of the slots its words are hashed into, of ``SLOTS``, and
how often they do; a slot weighs the more the fewer documents have it. The matrix of all bags is never dense. It is multiplied with a
random matrix that is a hash of the slot, then, to sharpen the range, back and forth with itself. One scan of the bags does both
products: it has the short vector of every slot, and a task adds up the products of its own documents. Entries of the matrix so never
leave their document: words cross a shuffle once, to the document's id, and what a product moves is one array of a vector per slot for
each ``TASK_ENTRIES`` entries. That array, ``SLOTS`` by ``width`` doubles (92 MB) however many documents there are, and matrices of
``width`` by ``width`` reach the driver, which keeps the columns orthonormal between the products and takes the small decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.vectors import l2_normalise
from foliospark.operators.shared import materialise, task_sums

SLOTS, EXTRA, PASSES = 1 << 18, 12, 3
#: Entries of the matrix that a task multiplies at least, and those it has in hand at a time.
TASK_ENTRIES, BLOCK_ENTRIES = 16_000_000, 1 << 20


def slot_of(word: Column, slots: int = SLOTS) -> Column:
    """The first eight hex digits of the word's md5, modulo ``slots``."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Rows ``first`` to ``last`` of a batch of arrays, with the row of each of their elements and the elements themselves."""
    columns = [c for c in batch.columns if pa.types.is_list(c.type)]
    sizes = columns[0].value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    first = 0
    while first < len(sizes):
        begin = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK_ENTRIES, "right")))
        yield first, last, np.repeat(np.arange(last - first), sizes[first:last]), [v[begin:ends[last - 1]] for v in values]
        first = last


def counts(tokens: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bags ``doc_id, slot array<int>, tf array<long>`` of ``tokens(doc_id, tokens)``, by slot; rows of one id are one document."""
    hashed = tokens.where(F.size("tokens") > 0).select("doc_id", F.transform("tokens", lambda w: slot_of(w, slots)).alias("slot"))
    whole = hashed.groupBy("doc_id").agg(F.flatten(F.collect_list("slot")).alias("slot"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, (slot,) in _blocks(batch):
                found, n = np.unique(row * slots + slot, return_counts=True)
                ends = pa.array(np.searchsorted(found, np.arange(last - first + 1) * slots), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((found % slots).astype("int32"), n.astype("int64"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], ["doc_id", "slot", "tf"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(counted, f"doc_id {kind}, slot array<int>, tf array<long>")


def document_shares(counted: DataFrame, n_docs: int) -> DataFrame:
    """``slot, idf``: the log of ``n + 1`` over one more than the documents that have the slot."""
    return counted.select(F.explode("slot").alias("slot")).groupBy("slot").agg(F.log(F.lit(n_docs + 1.0) / (F.count("*") + 1)).alias("idf"))


def weighted(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """``doc_id, slot, tf, weight``, a row an entry; slots that no fitted document has are left out."""
    entries = counted.select("doc_id", F.explode(F.arrays_zip("slot", "tf")).alias("e")).select("doc_id", "e.slot", "e.tf")
    return entries.join(F.broadcast(idf), "slot").select("doc_id", "slot", "tf", (F.col("tf") * F.col("idf")).alias("weight")).where("weight <> 0")


def _table(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    """A table of one row a slot as arrays, by slot."""
    found = rows.select("slot", *columns).toArrow().sort_by("slot")
    return [found.column(c).to_numpy() for c in ("slot", *columns)]


def _at(names: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``slot`` in ``names``, and whether they are there at all."""
    at = np.minimum(np.searchsorted(names, slot), len(names) - 1)
    return at, names[at] == slot


def _products(bags: DataFrame, names: np.ndarray, scale: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With the matrix A of ``bags(doc_id, slot, weight)``, columns times ``scale``: A'A ``right`` and the products of the columns of A ``right``."""
    n, width = right.shape
    sent = bags.sparkSession.sparkContext.broadcast((names, scale, np.ascontiguousarray(right.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        names, scale, right = sent.value
        back, gram = np.zeros((width, n)), np.zeros((width, width))
        for batch in batches:
            for first, last, row, (slot, weight) in _blocks(batch):
                at, _ = _at(names, slot)
                w = weight * scale[at]
                left = np.stack([np.bincount(row, w * x[at], last - first) for x in right])
                gram += left @ left.T
                for j in range(width):
                    back[j] += np.bincount(at, w * left[j][row], n)
        return np.concatenate([back.ravel(), gram.ravel()]) if gram.any() else None

    found = task_sums(bags, run)
    sent.unpersist()
    if found is None:
        return np.zeros((n, width)), np.zeros((width, width))
    return found[:n * width].reshape(width, n).T, found[n * width:].reshape(width, width)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What turns columns with these products into orthonormal ones, by falling length (fewer if their range has fewer)."""
    values, axes = np.linalg.eigh(gram)
    order = np.flatnonzero(values > max(values.max(initial=0), 0) * 1e-13)[::-1]
    return axes[:, order] / np.sqrt(values[order])


def _axes(bags: DataFrame, names: np.ndarray, bits: np.ndarray, scale: np.ndarray, k: int, passes: int, extra: int) -> np.ndarray:
    """The first ``k`` right singular vectors, a row for each of ``names``; ``bits`` of a slot are its row of the random matrix."""
    right = np.where(bits[:, None] >> np.arange(min(k + extra, 62)) & 1, -1.0, 1.0)
    for _ in range(passes + 1):
        if not right.size:
            break
        back, gram = _products(bags, names, scale, right)
        back = back @ _orthonormal(gram)
        right = back @ _orthonormal(back.T @ back)  # by falling singular value
    return right[:, :k]


def _dealt(bags: DataFrame) -> DataFrame:
    """Bags in as many parts as their entries are worth: each sends an array of its own."""
    total = bags.agg(F.sum(F.size("slot"))).first()[0] or 0
    return bags.coalesce(max(bags.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ENTRIES)))


def _random_bits(slots: DataFrame) -> DataFrame:
    return slots.withColumn("bits", F.xxhash64(F.lit("range"), "slot"))


def principal_slots(entries: DataFrame, k: int, passes: int = PASSES, extra: int = EXTRA) -> DataFrame:
    """``slot, axis``: the first ``k`` right singular vectors of ``entries(doc_id, slot, weight)``, or as many as there are."""
    bags = materialise(entries.groupBy("doc_id").agg(F.collect_list("slot").alias("slot"), F.collect_list("weight").alias("weight")))
    names, bits = _table(_random_bits(entries.select("slot").distinct()), "bits")
    axes = _axes(_dealt(bags), names, bits, np.ones(len(names)), k, passes, extra)
    found = pa.table({"slot": pa.array(names), "axis": pa.array(list(axes), pa.list_(pa.float64()))})
    return materialise(entries.sparkSession.createDataFrame(found, f"slot {entries.schema['slot'].dataType.simpleString()}, axis array<double>"))


@dataclass
class WideModel:
    """Slots of a fitted space in rising order, their idf, and their rows of the axes."""

    names: np.ndarray
    idf: np.ndarray
    axes: np.ndarray
    k: int
    slots: int

    def transform(self, tokens: DataFrame) -> DataFrame:
        """``tokens(doc_id, tokens)`` with ``unit``, the unit vector along the axes; zero where no fitted slot is."""
        k, sent = self.k, tokens.sparkSession.sparkContext.broadcast((self.names, self.idf, np.ascontiguousarray(self.axes.T)))

        def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, idf, axes = sent.value
            for batch in batches:
                for first, last, row, (slot, tf) in _blocks(batch):
                    x = np.zeros((last - first, k))  # zero where there are fewer axes
                    if len(names):
                        at, known = _at(names, slot)
                        w = np.where(known, tf * idf[at], 0.0)
                        for j, axis in enumerate(axes):
                            x[:, j] = np.bincount(row, w * axis[at], last - first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

        kind = tokens.schema["doc_id"].dataType.simpleString()
        summed = counts(tokens, self.slots).mapInArrow(along, f"doc_id {kind}, x array<double>")
        own = summed.select(F.col("doc_id").alias("_id"), l2_normalise(F.col("x")).cast("array<double>").alias("_unit"))
        nothing = F.array_repeat(F.lit(0.0), k)
        met = tokens.join(own, F.col("doc_id") == F.col("_id"), "left")
        return met.select(*tokens.columns, array_to_vector(F.coalesce("_unit", nothing)).alias("unit"))


def fit_wide(tokens: DataFrame, k: int, slots: int = SLOTS) -> WideModel:
    """The space of ``tokens(doc_id, tokens)``: the first ``k`` principal axes of their weights, uncentred."""
    counted = materialise(counts(tokens, slots))
    names, idf, bits = _table(_random_bits(document_shares(counted, tokens.count()).where("idf <> 0")), "idf", "bits")
    return WideModel(names, idf, _axes(_dealt(counted), names, bits, idf, k, PASSES, EXTRA), k, slots)
