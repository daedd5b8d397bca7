"""Shuffling, splitting, filtering and label encoding of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.config import TEXT_MODES
from foliospark.functions import text as T
from foliospark.operators.shared import hash_bucket, hash_key, materialise, running, small_side


def shuffle(df: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """All rows in a seeded random order; a range-partitioned sort."""
    return df.orderBy(hash_key(id_col, seed), id_col)


def split_first_n(df: DataFrame, n1: int, n2: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """The first ``n1`` rows of the shuffled order as ``cluster``, the next ``n2`` as ``class``.

    Counts per hash bucket tell which buckets can hold those rows, so only about n1+n2 rows are
    shuffled, in groups of one bucket each.
    """
    keyed = df.withColumn("_key", hash_key(id_col, seed)).withColumn("_bucket", hash_bucket(F.col("_key")))
    # at most 65,536 buckets exist, so this window and the broadcast below are bounded
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_bucket").count()
        .select("_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
        .where(F.col("_before") < n1 + n2)
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        keyed.join(F.broadcast(offsets), "_bucket")
        .withColumn("position", (F.col("_before") + F.row_number().over(in_bucket) - 1).cast("long"))
        .where(F.col("position") < n1 + n2)
        .withColumn("split", F.when(F.col("position") < n1, "cluster").otherwise("class"))
        .drop("_key", "_bucket", "_before")
    )


def split_sample(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """``cluster`` for the first ``n`` rows of the shuffled order, ``class`` for all others.

    Counts per hash bucket name the one bucket that holds the n-th row; only that bucket's keys are ranked. The rows themselves
    are compared with the key found there and not moved.
    """
    keyed = df.select(hash_key(id_col, seed).alias("_key"), F.col(id_col).alias("_id")).withColumn("_bucket", hash_bucket(F.col("_key")))
    counts = keyed.groupBy("_bucket").count().orderBy("_bucket").collect()  # 65,536 buckets at most
    before = 0
    for bucket, held in counts:
        if before + held > n:
            edge = keyed.where(F.col("_bucket") == bucket).orderBy("_key", "_id").limit(n - before + 1)
            cut = edge.agg(F.max(F.struct("_key", "_id")).alias("cut")).first()["cut"]
            first = F.struct(hash_key(id_col, seed).alias("_key"), F.col(id_col).alias("_id")) < F.struct(F.lit(cut["_key"]).alias("_key"), F.lit(cut["_id"]).alias("_id"))
            return df.withColumn("split", F.when(first, "cluster").otherwise("class"))
        before += held
    return df.withColumn("split", F.lit("cluster"))


def select_text(df: DataFrame, mode: str, *more: Column) -> DataFrame:
    """``doc_id``, the text of one mode and what else the caller wants of the same row."""
    if mode not in TEXT_MODES:
        raise ValueError(f"Unknown text mode: {mode!r}; expected one of {TEXT_MODES}")
    column = {"abstract": "clean", "triples": "triples"}.get(mode, mode)
    if column not in df.columns:
        raise ValueError(f"Column {column!r} is missing; run with_representations first.")
    return df.select("doc_id", as_text(df, column).alias("text"), *more)


def as_text(df: DataFrame, column: str) -> Column:
    """A column as one text; lists of triples read subject, relation, object, and lists of strings item by item."""
    kind = df.schema[column].dataType
    if kind.typeName() != "array":
        return F.col(column).cast("string")
    return T.triples_text(F.col(column)) if kind.elementType.typeName() == "struct" else T.items_text(F.col(column))


def with_representations(df: DataFrame) -> DataFrame:
    """Add ``triples_str``, ``abstract_triples``, ``graph_text`` and ``hybrid``.

    Triples given as structs read subject, relation, object in ``triples_str`` too: a struct has no text form of its own here.
    """
    if "clean" not in df.columns:
        raise ValueError("Column 'clean' is missing.")
    if "triples" not in df.columns:
        df = df.withColumn("triples", F.lit("(unk, unk, unk)"))
    df = df.withColumn("triples_str", F.coalesce(as_text(df, "triples"), F.lit("")))
    if "graph_text" not in df.columns:
        df = df.withColumn("graph_text", F.lit(""))
    clean, triples, graph = F.col("clean"), F.col("triples_str"), F.col("graph_text")
    return df.withColumn("abstract_triples", T.abstract_triples_text(clean, triples)).withColumn(
        "hybrid", T.hybrid_text(clean, triples, graph)
    )


def drop_rare(df: DataFrame, col: str, min_size: int = 2) -> DataFrame:
    """Keep rows whose group has at least ``min_size`` members."""
    keep = df.groupBy(col).count().where(F.col("count") >= min_size).select(col)
    return df.join(small_side(keep), col, "left_semi")


def rare_count(df: DataFrame, col: str, min_size: int = 2) -> DataFrame:
    """How many rows :func:`drop_rare` removes."""
    sizes = df.groupBy(col).count()
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("count") < min_size, F.col("count"))), F.lit(0)).alias("dropped"))


def label_map(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct labels in ascending order, numbered from 0."""
    labels = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return running(labels, [], [col], {"_n": "_one"}).select(col, (F.col("_n") - 1).cast("int").alias(out))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    out = out or f"{col}_enc"
    return df.join(small_side(label_map(df, col, out)), col, "left")


def stratified_split(
    df: DataFrame, label: str, fraction: float = 0.2, id_col: str = "doc_id", seed: int = 42
) -> DataFrame:
    """Add ``split``: ``val`` for ceil(fraction * n) rows, shared out over the labels, else ``train``.

    A null label is a label. Quotas go by largest remainder, ties to the smaller label. Per label the rows with the
    smallest hash keys are taken: whole hash buckets below a cut-off one, and inside that bucket the rows up to a cut key.
    Only (label, key) rows are counted and ranked; the rows of ``df`` are read once more and compared with their label's cut.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    keyed = df.select(name.alias("_name"), F.col(label).alias("_label"), hash_key(id_col, seed).alias("_key"), F.col(id_col).alias("_id"))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_key")))
    sizes = materialise(keyed.groupBy("_name", "_bucket").agg(F.count("*").alias("count"), F.min("_label").alias("_label")))
    per_label = sizes.groupBy("_name").agg(F.sum("count").alias("_n"), F.min("_label").alias("_label"))
    everything = Window.partitionBy()
    total = F.sum("_n").over(everything)
    wanted = F.ceil(F.round(F.lit(fraction) * total, 9))
    share = F.col("_n") * F.col("_wanted") / F.col("_total")
    # one row per class label; a classifier's label set is small by nature
    quotas = (
        per_label.withColumn("_total", total).withColumn("_wanted", wanted)
        .withColumn("_floor", F.floor(share))
        .withColumn("_rest", F.round(share - F.floor(share), 9))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_rest"), "_label")))
        .withColumn("_missing", F.col("_wanted") - F.sum("_floor").over(everything))
        .select("_name", (F.col("_floor") + (F.col("_rank") <= F.col("_missing")).cast("int")).alias("_quota"))
    )
    upto = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        sizes.withColumn("_upto", F.sum("count").over(upto)).join(quotas, "_name")
        .where((F.col("_upto") - F.col("count") < F.col("_quota")) & (F.col("_upto") >= F.col("_quota")))
        .select("_name", "_bucket", (F.col("_quota") - F.col("_upto") + F.col("count")).alias("_left"))
    )
    rank = F.row_number().over(Window.partitionBy("_name").orderBy("_key", "_id"))
    cuts = (
        keyed.join(edges, ["_name", "_bucket"]).withColumn("_rank", rank).where(F.col("_rank") == F.col("_left"))
        .select("_name", F.struct("_key", "_id").alias("_cut"))
    )
    marked = df.withColumn("_name", name).join(small_side(cuts), "_name", "left")
    own = F.struct(hash_key(id_col, seed).alias("_key"), F.col(id_col).alias("_id"))
    taken = F.coalesce(own <= F.col("_cut"), F.lit(False))
    return marked.select(*df.columns, F.when(taken, "val").otherwise("train").alias("split"))
