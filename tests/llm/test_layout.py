import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import ann, chat, mixing, sharding
from foliospark.llm.common import n_words


def test_permutations_are_permutations(spark):
    sizes = [1, 2, 3, 5, 7, 16, 17, 30, 99, 1000]
    rows = spark.createDataFrame([(n, x) for n in sizes for x in range(n)], "n long, x long")
    got = rows.select("n", "x", mixing.permuted(F.col("x"), F.col("n"), F.lit(9)).alias("y")).collect()
    for n in sizes:
        own = {r.x: r.y for r in got if r.n == n}
        assert sorted(own.values()) == list(range(n))
        assert n < 30 or sum(abs(own[i + 1] - own[i]) == 1 for i in range(n - 1)) < n / 4


def shared_out(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = {s: weight[s] for s in order if s not in capped}
        share = {s: (total - sum(capped.values())) * w / sum(left.values()) for s, w in left.items()}
        over = {s: 3 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix_meets_its_targets(spark, edges, nothing, prose):
    rows = [(i, prose(40 + i % 300, i), ["x", "y", "é", None, "tiny", "zero"][0 if i % 3 else i % 4]) for i in range(400)] + [(900, prose(70, 1), "tiny"), (901, "", "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, block_words=16, shard_slots=64)
    got = mixing.taken(mixed).join(mixed.sources.select("key", "target", "source_size"), "key").collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = {"~" if s is None else "=" + s: v for s, v in shared_out(sizes).items()}
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    for key, target in want.items():
        own = [r for r in got if r.key == key]
        assert abs(own[0].target - target) < 1e-6 and abs(sum(r.taken for r in own) - target) <= 17
    slots = mixed.slots.collect()
    assert sorted((r.shard, r.slot) for r in slots) == [(i // 64, i % 64) for i in range(len(slots))]
    per = {}
    for r in slots:
        per.setdefault((r.key, r.epoch), []).append(r.block)
    assert all(len(b) == len(set(b)) for b in per.values()) and all(epoch < 3 for _, epoch in per)
    texts = mixing.block_texts(docs, mixed, "doc_id").collect()
    assert len(texts) == len(slots) and sum(len(r.text.split()) for r in texts) == sum(r.taken for r in got)
    again = mixing.taken(mixing.mix(docs.repartition(5), block_words=16, shard_slots=64)).collect()
    assert sorted((r.id, r.taken) for r in again) == sorted((r.id, r.taken) for r in got)
    odd = mixing.taken(mixing.mix(edges)).collect()
    assert len(odd) == edges.count() and all(r.taken <= 3 * r.size for r in odd)
    assert mixing.taken(mixing.mix(nothing)).count() == 0


def test_words_are_counted_by_ascii_blanks(spark):
    rows = spark.createDataFrame([("a\x0bb \x0c c\x85d\xa0e\r\n",), (None,), ("",), (" \t",)], "t string")
    assert [r[0] for r in rows.select(n_words(F.col("t"))).collect()] == [3, 0, 0, 0]


def test_shards_are_cut_from_the_order_of_keys(spark, edges, nothing, prose):
    rnd = random.Random(8)
    rows = [(i, "copy of one text" if i % 3 == 0 else prose(rnd.randint(1, 60), i)) for i in range(900)] + [(None, None), (5000, ""), (5001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:13], 16)
    order = sorted(rows, key=lambda r: (digest(r[1] or ""), digest("" if r[0] is None else str(r[0]))))
    sizes = [len((t or "").encode()) + 8 for _, t in order]
    total, before, want, slots = sum(sizes), 0, {}, {}
    for (i, _), size in zip(order, sizes):
        shard = (2 * before + size) * 24 // (2 * total)
        want[i] = (size, shard, slots.setdefault(shard, 0))
        slots[shard] += 1
        before += size
    got = sharding.shards(docs, range_rows=40).collect()
    assert {r.id: (r.size, r.shard, r.slot) for r in got} == want and len(got) == len(rows)
    assert {r.id: (r.size, r.shard, r.slot) for r in sharding.shards(docs.repartition(7)).collect()} == want
    held = [sum(s for s, shard, _ in want.values() if shard == k) for k in range(24)]
    assert max(held) - min(held) <= 2 * max(sizes)
    odd = sharding.shards(edges, 5).collect()
    for k in range(5):
        own = sorted(r.slot for r in odd if r.shard == k)
        assert own == list(range(len(own)))
    assert len(odd) == edges.count() and sharding.shards(nothing).count() == 0


def test_a_third_of_empty_rows_is_subdivided(spark, prose):
    """Empty texts are a small part of the bytes, and a large one of the rows."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE repeat(concat(md5(cast(id AS string)), ' '), 20) END AS text")
    rows = sharding.records(docs).cache()
    total = rows.agg(F.sum("size")).first()[0]
    groups = sharding.parted(rows, total, 6000, 120).groupBy("range", "part").agg(
        F.count("*").alias("n"), F.sum("size").alias("held"), F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high"))
    found = groups.orderBy("range", "part").collect()
    assert sum(g.n for g in found) == 6000 and all(a.high <= b.low for a, b in zip(found, found[1:]))
    assert max(g.n for g in found) <= 4 * 6000 / 60 and max(g.held for g in found) <= 4 * total / 60


def test_shards_are_written_whole(spark, tmp_path, prose):
    docs = spark.createDataFrame([(i, prose(20, i), "x") for i in range(50)], "doc_id long, text string, size string")
    sharding.write_shards(docs, f"{tmp_path}/out", 3, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.shard for r in back.collect()} == {0, 1, 2}


def test_best_branches_of_a_tree(spark):
    #: tree, node, parent, score, role, text
    rows = [("t", 1, None, 1.0, "user", "q"), ("t", 2, 1, 0.1, "assistant", "bad"), ("t", 3, 1, 0.9, "assistant", "good"),
            ("t", 4, 3, 0.0, "user", "more"), ("t", 5, 4, 0.5, "assistant", "a \\ ### </turn> \\h"), ("t", 6, 4, 0.5, "assistant", "tie"),
            ("u", 1, 99, None, None, None), ("u", 1, 99, None, None, None), ("w", 1, 2, 0.0, "user", "cycle"), ("w", 2, 1, 0.0, "user", "cycle"),
            (None, 1, None, 0.0, "user", "x")]
    rows += [("long", i, i - 1, 0.0, "assistant" if i % 2 else "user\n:", f"turn {i}") for i in range(70)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string").withColumn("_n", F.lit("clash"))
    best = {(r.tree, r.leaf): r for r in chat.formatted(chat.paths(messages.drop("_n"))).withColumn("back", chat.turns_of(F.col("text"))).withColumn(
        "masked", chat.masked_text(F.col("text"), F.col("loss"))).collect()}
    assert set(best) == {("t", 5), ("u", 1), ("long", 69)}
    assert [tuple(t) for t in best["t", 5].back] == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "a \\ ### </turn> \\h")]
    assert best["t", 5].masked == "good" + "a \\ ### </turn> \\h"
    assert [tuple(t) for t in best["u", 1].back] == [("", "")]
    assert [tuple(t) for t in best["long", 69].back] == [("assistant" if i % 2 else "user\n:", f"turn {i}") for i in range(70)]
    two = chat.paths(messages.drop("_n"), keep=2).select("tree", "leaf").distinct().collect()
    assert {(r.tree, r.leaf) for r in two} == {("t", 5), ("t", 6), ("u", 1), ("long", 69)}
    assert chat.formatted(chat.paths(messages.drop("_n").limit(0))).count() == 0


def test_escapes_go_back(spark):
    rnd = random.Random(9)
    parts = ["\\", "#", "##", "###", "</turn>", "</turn", ">", "e", "h", "t", "n", "\n", " ", "é", "\\h", "</"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = rows.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "</turn>" not in r.e and "###" not in r.e for r in got)
    turns = rows.select(F.lit("all").alias("tree"), F.lit(1).alias("leaf"), F.col("i").alias("depth"), F.when(F.col("i") % 2 == 0, "assistant").otherwise(F.col("t")).alias("role"), F.col("t").alias("text"))
    one = chat.formatted(turns).select(chat.turns_of(F.col("text")).alias("b"), chat.masked_text(F.col("text"), F.col("loss")).alias("m")).first()
    assert [tuple(t) for t in one.b] == [("assistant" if i % 2 == 0 else t, t) for i, t in enumerate(texts)]
    assert one.m == "".join(t for i, t in enumerate(texts) if i % 2 == 0 or t == "assistant")


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 48))
    x = np.concatenate([centres[i % 6] * 0.35 + rng.normal(size=(1, 48)) for i in range(900)])
    x[700:] = x[5] + rng.normal(size=(200, 48)) * 1e-3  # a crowd
    x[890:] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 48), (2100, [float("nan")] * 48), (2150, [1.0, None] * 24), (2200, [1.0]), (None, [1.0] * 48)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(base, base.where("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 900, 50):
        near = unit @ unit[q]
        near[q] = -9
        want = np.lexsort((np.arange(900), -np.round(near, 12)))[:5]
        own = sorted((r for r in got if r.query == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and np.allclose([near[r.id] for r in own], [r.score for r in own], atol=1e-12)
        assert all((a.score, -a.id) > (b.score, -b.id) for a, b in zip(own, own[1:]))
        hits += len({*want.tolist()} & {r.id for r in own})
        total += 5
    assert hits / total >= 0.9 and {r.query for r in got} == set(range(0, 900, 50))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 2.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    own = sorted((r.query, r.rank, r.id, round(r.score, 6)) for r in ann.nearest(few, few.where("vec_id % 50 = 0")).collect())
    assert own == [(0, 1, 7, 0.707107), (0, 2, 50, 0.0), (50, 1, 7, 0.707107), (50, 2, 0, 0.0)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_an_id_that_stands_more_than_k_times_is_one_neighbour(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [1.0, 0.1])] * 6 + [(i, [1.0, 0.1 + 0.1 * i]) for i in range(1, 6)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((r.rank, r.id) for r in ann.nearest(base, base.where("vec_id = 0")).collect())
    assert got == [(1, 7), (2, 1), (3, 2), (4, 3), (5, 4)]
