"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.shared import materialise

#: ASCII white space, as the contracts of the queries name it.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its plain name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "_row") -> Column:
    """All columns of a row in one struct, so that names a caller uses cannot clash with ours."""
    return F.struct(*[column(c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "_row") -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in columns]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_batch(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of a scan; nothing outlives a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node on an edge ``(a, b)`` of longs; the root is the smallest node reachable.

    Alternates the two star contractions: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows. Rounds grow with the logarithm of the longest path, edges never grow beyond their first
    number, and every round is a written table, so no round is computed twice.
    """
    a, b = F.col("a"), F.col("b")
    now = materialise(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = materialise(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
            .union(down.select("a", F.col("m").alias("b"))).distinct()
        )
        now = materialise(small)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    """How many edges there are and a sum over them: both stay the same only when nothing moves any more."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def add_columns(docs: DataFrame, inputs: list[str], added: list[tuple[str, str]],
                fn: Callable[..., list[pa.Array]]) -> DataFrame:
    """``docs`` with further columns that ``fn`` makes from the ``inputs`` of a batch; other columns pass unread."""
    names = docs.columns
    at = [names.index(c) for c in inputs]
    rows = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(names)])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"n{i} {kind}" for i, (_, kind) in enumerate(added)]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = fn(*[batch.column(i) for i in at])
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [k.split(" ", 1)[0] for k in kinds])

    done = by_batch(rows, ", ".join(kinds), one)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[F.col(f"n{i}").alias(c) for i, (c, _) in enumerate(added)])
