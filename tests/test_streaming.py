import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.vectors import l2_normalise
from foliospark.operators.cluster import assign_nearest

ROWS = [(i, t, [float(i), float(i % 3), 1.0]) for i, t in enumerate(["A  b\nc", "", " \t ", "Ünï code", "the (x, y) end", None, "cs.AI math", "z"])]
SCHEMA = "doc_id long, text string, embedding array<double>"


def shaped(df, centroids):
    """The parts that look at one row: cleaning, counting, splitting, unit vectors, assignment to fixed centres."""
    own = df.select(
        "doc_id", T.clean_text(F.col("text")).alias("clean"), T.token_count(F.col("text")).alias("n_tokens"), T.char_count(F.col("text")).alias("n_chars"),
        T.is_not_blank(F.col("text")).alias("filled"), T.top_category(F.col("text")).alias("top"), T.newlines_to_spaces(F.col("text")).alias("line"),
        T.word_list(T.clean_text(F.col("text"))).alias("words"), l2_normalise(F.col("embedding")).alias("embedding"))
    return assign_nearest(own, centroids, "label")


@pytest.mark.parametrize("folders", [1, 2])
def test_a_stream_of_files_gives_what_a_batch_gives(spark, tmp_path, folders):
    centroids = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0]), (2, [0.5, 0.5, 0.5])], "label int, centroid array<double>")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for i in range(folders):
        rows.where(F.col("doc_id") % folders == i).repartition(2).write.parquet(str(tmp_path / "in" / f"part={i}"))
    source = str(tmp_path / "in" / "part=*")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = shaped(stream, centroids).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert order(spark.read.parquet(str(tmp_path / "out"))) == order(shaped(rows, centroids)) and len(ROWS) == spark.read.parquet(str(tmp_path / "out")).count()
