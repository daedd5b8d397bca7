import json

from pyspark.sql import functions as F

from foliospark.operators import profile as P
from foliospark.sources.jsonl import leading, numbered_lines, profile_scan, read_jsonl
from foliospark.sources.sinks import append_results, write_csv, write_json

LINES = [
    '{"abstract":"a b","categories":"cs.AI cs.LG"}', "", '{"categories":"b"}', '{"abstract":"","categories":"hep-th"}',
    '{"abstract":null,"categories":"b"}', '{"abstract":"x","categories":" "}', "{'abstract':'a','categories':'b'}",
    '{"abstract":5,"categories":"b"}', '["abstract","categories"]',
]


def lines_file(tmp_path, lines=LINES):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_loader_keeps_records_with_both_keys(spark, tmp_path):
    rows = {r["doc_id"]: r for r in read_jsonl(spark, lines_file(tmp_path)).collect()}
    assert sorted(rows) == [0, 3, 4, 5, 7]
    assert rows[4]["abstract"] == "" and rows[7]["abstract"] == "5" and rows[0]["abstract"] == "a b"


def test_limit_counts_lines(spark, tmp_path):
    assert read_jsonl(spark, lines_file(tmp_path), 4).count() == 2
    assert profile_scan(spark, lines_file(tmp_path), 2).count() == 2


def test_optional_lists(spark, tmp_path):
    path = lines_file(tmp_path, [json.dumps({"abstract": "a", "categories": "b", "nodes": ["n"], "edges": [["p", "q"]]})])
    row = read_jsonl(spark, path).first()
    assert row["nodes"] == ["n"] and row["edges"][0].asDict() == {"src": "p", "dst": "q"}


def test_profile_counters(spark, tmp_path):
    scan = profile_scan(spark, lines_file(tmp_path))
    got = P.quality_counters(scan).first().asDict()
    assert got == {
        "total_lines_seen": 9, "json_rows_parsed": 6, "have_abstract": 2, "have_categories": 5, "json_parse_error": 3,
        "abstract_missing_or_empty": 4, "categories_missing_or_empty": 1,
    }
    assert {r["line_no"]: r["row_index"] for r in scan.collect()} == {0: 0, 1: None, 2: 1, 3: 2, 4: 3, 5: 4, 6: None, 7: 5, 8: None}
    counts = {r["subcategory"]: r["count"] for r in P.category_counts(scan).collect()}
    assert counts == {"b": 3, "cs.AI": 1, "cs.LG": 1, "hep-th": 1}
    assert {r["top_category"]: r["count"] for r in P.category_counts(scan, "top_category").collect()} == {"b": 3, "cs": 2, "hep-th": 1}
    summary = P.dataset_summary(scan).first()
    assert summary["unique_subcategories"] == 4 and summary["unique_top_categories"] == 3
    assert summary["missing_fields"] == {"json_parse_error": 3, "abstract_missing_or_empty": 4, "categories_missing_or_empty": 1}


def test_numbers_across_files_and_blocks(spark, tmp_path):
    want = []
    for f in range(3):
        lines = [f"line {f} {i}" for i in range(4000 + 700 * f)]
        (tmp_path / f"part-{f}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["line_no"]: r["raw"] for r in numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(want))


def bytes_read(spark, action):
    """The action's result, and the input bytes of all stages it ran."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    result = action()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return result, total() - before


def test_a_limit_reads_only_the_first_files(spark, tmp_path):
    want = []
    for f in range(100):
        lines = [f"{f} {i} " + "x" * 400 for i in range(200)]
        (tmp_path / f"part-{f:03}[1].txt").write_text("\n".join(lines) + "\n")
        want += lines
    size = (tmp_path / "part-000[1].txt").stat().st_size
    for limit, files in ((0, 0), (1, 1), (200, 1), (201, 2), (300, 2), (5000, 25), (20_000, 100), (30_000, 100)):
        whole, last, _ = leading(spark, str(tmp_path), limit)
        assert last is None and len(whole) == files
        rows = numbered_lines(spark, str(tmp_path), limit).collect()
        assert {r["line_no"]: r["raw"] for r in rows} == dict(enumerate(want[:limit])) and len(rows) == min(limit, len(want))
    _, read = bytes_read(spark, lambda: numbered_lines(spark, str(tmp_path), 300).count())
    assert read <= 3 * 2 * size * 1.1  # two files: the limit is found, lines are counted per block, lines are numbered


def test_a_limit_reads_only_the_head_of_a_large_file(spark, tmp_path):
    names = {"a.txt": 150, "b.txt": 40_000, "c.txt": 10}
    want = []
    for name, n in names.items():
        lines = [f"{name} {i} " + "y" * 90 for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        for limit in (100, 150, 151, 4000, 30_000, 40_155, 50_000):
            rows = numbered_lines(spark, str(tmp_path), limit).collect()
            assert {r["line_no"]: r["raw"] for r in rows} == dict(enumerate(want[:limit])) and len(rows) == min(limit, len(want))
        assert leading(spark, str(tmp_path), 4000)[2] == 3850
        _, read = bytes_read(spark, lambda: numbered_lines(spark, str(tmp_path / "b.txt"), 1000).count())
        assert 0 < read < 900_000 < (tmp_path / "b.txt").stat().st_size / 4
        kept = read_jsonl(spark, lines_file(tmp_path / "..", LINES * 9000), 7)
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sinks(spark, tmp_path):
    freq = P.length_frequencies(spark.range(1, 101), F.col("id"))
    write_json(P.length_record(freq), str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("part-*.json")).read_text()
    record = json.loads(text)
    assert record["count"] == 100 and record["median"] == 50.5 and record["percentiles"]["25"] == 25.75
    write_csv(spark.range(2).withColumnRenamed("id", "row_index"), str(tmp_path / "c"))
    assert any(p.read_text().startswith("row_index") for p in (tmp_path / "c").glob("part-*.csv"))
    append_results(spark.range(2), str(tmp_path / "p"))
    append_results(spark.range(3), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_histogram_edges(spark):
    same = P.histogram(P.length_frequencies(spark.range(5), F.lit(7))).collect()
    assert [(r["bin"], r["n"]) for r in same] == [(51, 5)]
    even = P.histogram(P.length_frequencies(spark.range(0, 101), F.col("id")))
    assert {r["bin"]: r["n"] for r in even.collect()}[100] == 2
    area = P.density(P.histogram(P.length_frequencies(spark.range(1000), F.col("id")))).collect()
    step = area[1]["x"] - area[0]["x"]
    assert 0.85 < sum(r["density"] for r in area) * step < 1.0


def test_profile_report(spark, tmp_path):
    from foliospark.plans.dataset_profile import profile_dataset

    paths = profile_dataset(spark, lines_file(tmp_path), str(tmp_path / "out"))
    counts = spark.read.option("header", True).csv(paths["subcategories_counts"]).collect()
    assert [(r["subcategory"], r["count"]) for r in counts][0] == ("b", "3")
    lengths = spark.read.option("header", True).csv(paths["abstract_lengths"])
    assert {tuple(r) for r in lengths.collect()} == {("0", "3", "2"), ("4", "1", "1")}
    stats = spark.read.json(paths["abstract_length_stats"]).first()
    assert (stats["count"], stats["min"], stats["max"], stats["mean"], stats["std"]) == (2, 1, 3, 2.0, 1.0)
