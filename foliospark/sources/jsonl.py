"""JSON-lines scans with file-wide line numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.shared import small_side

# Fixed value: the key order and duplicate-key rule of the input's own parser (last one wins).
DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


GLOB = re.compile(r"([\[\]{}*?\\])")
#: The head of a file may come through the driver up to this size.
HEAD_BYTES = 1 << 26


def _scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _counted(spark: SparkSession, file: str, limit: int) -> tuple[int, int, int]:
    """Lines found, blocks read and blocks there are in one file; blocks are read in order, in growing numbers, up to ``limit`` lines."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["n"])

    blocks = _scan(spark, file).select("_start").mapInArrow(count, "n long").rdd
    total, seen, done = blocks.getNumPartitions(), 0, 0
    while seen < limit and done < total:
        wave = range(done, min(total, 2 * done + 1))
        seen += sum(r["n"] for r in spark.sparkContext.runJob(blocks, list, list(wave)))
        done = wave.stop
    return seen, done, total


def leading(spark: SparkSession, path: str, limit: int) -> tuple[list[str], str | None, int]:
    """What holds the first ``limit`` lines: files to be read whole, and a file of which only the head is wanted, with how many
    lines of it. Files are counted in name order, the first alone and then as many as the lines so far make likely; later ones are
    listed and never opened."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()  # names only
    files = [(GLOB.sub(r"\\\1", r["path"]), r["length"]) for r in listed]
    whole, seen, used = [], 0, 0
    while seen < limit and len(whole) < len(files):
        first, size = files[len(whole)]
        found, read, blocks = _counted(spark, first, limit - seen)
        if found >= limit - seen and 2 * read <= blocks and (limit - seen) * size * read / blocks / max(1, found) <= HEAD_BYTES:
            return whole, first, limit - seen
        whole.append(first)
        seen, used = seen + found, used + size * read // blocks if blocks else used
        wave: list[str] = []
        while seen < limit and len(whole) + len(wave) < len(files):
            name, size = files[len(whole) + len(wave)]
            if seen + (sum(n for _, n in files[len(whole):len(whole) + len(wave)]) + size) * seen / max(1, used) > limit:
                break  # the file in which the limit is likely to fall is counted by itself
            wave.append(name)
        if wave:
            used += sum(n for _, n in files[len(whole):len(whole) + len(wave)])
            seen += spark.read.text(wave).count()
            whole += wave
    return whole, None, 0


def _head(spark: SparkSession, file: str, n: int) -> DataFrame:
    """The first ``n`` lines of a file; a limited collect reads its blocks in order and stops."""
    lines = _scan(spark, file).limit(n).collect()
    return spark.createDataFrame([(*r, i) for i, r in enumerate(lines)], "raw string, _file string, _start long, _at long")


def numbered_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``line_no, raw`` in file-name order, numbered from 0.

    Two passes: the first counts lines per input block (one row per block of a file), the second
    adds each block's offset to the place of the line inside its block. No sort, no shuffle of text.
    With a ``limit`` both passes see only the files that hold the first lines.
    """
    if limit is None:
        return _numbered(spark, path)
    whole, last, n = leading(spark, path, limit)
    if last is None:
        return _numbered(spark, whole).where(F.col("line_no") < limit) if whole else _numbered(spark, path).limit(0)
    head = _head(spark, last, n).select((F.lit(limit - n) + F.col("_at")).alias("line_no"), "raw", "_file", "_start")
    return _numbered(spark, whole).unionByName(head) if whole else head


def _numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    scan = _scan(spark, paths).withColumn("_mid", F.monotonically_increasing_id())
    # one row per input block, that is per 128 MB of text
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        scan.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
        .select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    return scan.join(small_side(blocks), ["_file", "_start"]).select(
        (F.col("_offset") + F.col("_mid") - F.col("_first")).alias("line_no"), "raw", "_file", "_start"
    )


# Bare non-finite numbers outside strings: the rest of the line must be whole strings and other characters.
NON_FINITE = r'-?(?:NaN|Infinity)(?=(?:[^"\\]++|"(?:[^"\\]++|\\.)*+")*+$)'


def json_value(raw: F.Column) -> F.Column:
    """The line as a variant, null if it is not one JSON value and nothing else.

    A parser that stops after the first value would take a line with more text behind it, so the line is parsed as the one
    item of a list, and of an object where it could close that list itself. The input's own parser also takes the bare
    numbers NaN, Infinity and -Infinity; they read as null here.
    """
    def whole(text: F.Column) -> F.Column:
        items = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        one = F.variant_get(items, "$[0]", "variant")
        alone = F.variant_get(items, "$[1]", "variant").isNull()
        closes = text.rlike(r"\}\s*\]")
        held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
        return F.when(alone & (~closes | held), one)

    odd = raw.rlike("NaN|Infinity")
    return F.coalesce(whole(raw), F.when(odd, whole(F.regexp_replace(raw, NON_FINITE, "null"))))


def _parsed(spark: SparkSession, path: str, limit: int | None, numbered: bool = True) -> DataFrame:
    # read when the plan runs, so it stays set for the session: of equal keys the last one wins
    spark.conf.set(DUPLICATE_KEYS, "true")
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    if numbered or limit is not None:
        lines = numbered_lines(spark, path, limit)
    else:
        lines = spark.read.text(path).select(F.col("value").alias("raw"))
    return lines.withColumn("v", json_value(F.col("raw"))).withColumn(
        "parsed", F.coalesce(is_object, F.lit(False))
    )


def _text_field(name: str) -> F.Column:
    """The field as text: null becomes '', other types their JSON text."""
    return F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit(""))


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records that are JSON objects with both ``abstract`` and ``categories`` keys.

    ``limit`` counts lines read, not rows kept.
    """
    has = [F.variant_get("v", f"$.{k}", "variant").isNotNull() for k in ("abstract", "categories")]
    categories = F.try_variant_get("v", "$.categories", "string")
    return _parsed(spark, path, limit).where(F.col("parsed") & has[0] & has[1]).select(
        F.col("line_no").alias("doc_id"),
        "raw",
        _text_field("abstract").alias("abstract"),
        categories.alias("categories"),
        F.try_variant_get("v", "$.nodes", "array<string>").alias("nodes"),
        F.transform(
            F.try_variant_get("v", "$.edges", "array<array<string>>"),
            lambda e: F.struct(F.get(e, F.lit(0)).alias("src"), F.get(e, F.lit(1)).alias("dst")),
        ).alias("edges"),
    )


def profile_scan(spark: SparkSession, path: str, limit: int | None = None, numbered: bool = True) -> DataFrame:
    """Every line with its parse state and the two fields where they are non-blank strings.

    ``row_index`` numbers the parsed lines. Ranks are taken inside input blocks, and only lengths
    and category text travel, not the whole line. Without ``numbered`` (for counters) lines have no
    numbers and the scan is one pass that moves nothing.
    """

    def usable(name: str) -> F.Column:
        value = F.try_variant_get("v", f"$.{name}", "string")
        kind = F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant"))
        return F.when(F.col("parsed") & (kind == "STRING") & T.is_not_blank(value), value)

    rows = _parsed(spark, path, limit, numbered)
    abstract = usable("abstract")
    narrow = rows.select(
        *(["line_no", "_file", "_start"] if numbered else []), "parsed",
        T.char_count(abstract).alias("abstract_length_chars"),
        F.when(abstract.isNotNull(), T.token_count(abstract)).alias("abstract_length_tokens"),
        usable("categories").alias("categories"),
    )
    if not numbered:
        return narrow
    hit = F.col("parsed").cast("long")
    block = Window.partitionBy("_file", "_start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_file", "_start").agg(F.sum(hit).alias("_n")).select(
        "_file", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    ordinal = F.col("_offset") + F.sum(hit).over(block) - 1
    return narrow.join(offsets, ["_file", "_start"]).withColumn(
        "row_index", F.when(F.col("parsed"), ordinal)
    ).drop("_file", "_start", "_offset")
