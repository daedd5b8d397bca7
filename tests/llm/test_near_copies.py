import random

from pyspark.sql import functions as F

from foliospark.llm import simhash, spotsigs
from foliospark.llm.common import connected_components


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    found = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        found.add(x)
        for _ in range(rnd.choice((0, 1, 6))):
            for bit in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << bit
            found.add(x)
    centre = rnd.getrandbits(64)  # a dense group
    found |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(30, 40)}
    fps = sorted(simhash._signed(x) for x in found)
    pairs = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = groups(len(fps), pairs)
    got = simhash.components(spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "fp long, low long")).collect()
    roots = {r.low: r.root for r in got}
    assert len(got) == len(fps) and len({(roots[i], want[i]) for i in roots}) == len(set(want)) == len(set(roots.values()))


def test_no_pair_is_met_twice(spark):
    fps = [0, 1, 3, 2**63 - 1, -1, 1 << 40]
    frame = spark.createDataFrame([(x, x, x) for x in fps], "node long, fp long, grp long")
    met = [tuple(sorted((r.a, r.b))) for r in simhash._across(frame, 4).collect()]
    want = {tuple(sorted((a, b))) for a in fps for b in fps if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(met) == len(set(met)) and set(met) == want


def test_star_contraction_reaches_the_smallest_node(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)] + [(-5, 200), (200, -5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    want = groups(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges if a != b])
    assert got == {n: nodes[w] for n, w in zip(nodes, want)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    by = {(r.id, r.fp): r.component_id for r in got}
    assert len(got) == edges.count()
    assert {r.component_id for r in got if r.fp == 0} == {2} and sum(r.fp == 0 for r in got) == 4  # null, null, empty, blank
    assert {c for (i, _), c in by.items() if i in (1, 7)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.simhash(b"one two") != 0 and simhash.simhash(b"A b") == simhash.simhash(b"a  B")


def test_similar_signatures_are_those_of_all_pairs(spark, prose):
    texts = [prose(80, i) for i in range(12)]
    texts += [" ".join(t.split()[:n]) + " tail" for t in texts[:6] for n in (79, 76, 70, 50)] + ["", "!!!", "plain words only"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", spotsigs.signatures(F.col("text")).alias("sigs"))
    sets = {tuple(r.sigs) for r in rows.collect()}
    names = {r.sigs and tuple(r.sigs): r.c for r in rows.select("sigs", F.xxhash64("sigs").alias("c")).collect()}
    want = {tuple(sorted((names[a], names[b]))) for a in sets for b in sets if a != b and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}
    got = [(r.a, r.b) for r in spotsigs.similar(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_signatures(spark):
    rows = spark.createDataFrame([("The quick brown fox. Of mice and men",), ("the QUICK, brown fox of mice and men!",), (None,), ("",), ("?!",)], "text string")
    got = [r.sigs for r in rows.select(spotsigs.signatures(F.col("text")).alias("sigs")).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[3] != got[4] and all(got)
    near = rows.select(spotsigs.likeness(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2), F.lit(3), F.lit(4))).alias("x"),
                       spotsigs.likeness(F.array(F.lit(1)), F.array(*[F.lit(i) for i in range(5)]), 0.5).alias("y")).first()
    assert near.x == 0.5 and near.y == 0.0


def plain_signatures(text, chain=2):
    """What the signatures are hashes of."""
    import re

    anchors = {w for words in spotsigs.ANCHORS.values() for w in words}
    words, found, i = re.sub(r"[\W_]+", " ", (text or "").lower()).split(), set(), 0
    while i < len(words):
        j = i + 1
        if words[i] in anchors:
            while j < len(words) and j <= i + chain and words[j] not in anchors:
                j += 1
        if j > i + 1 or words[i] not in anchors:
            found.add(" ".join(words[i:j]))
        i = j
    return found or {text or ""}


def test_signatures_are_chains_and_the_words_between(spark, prose):
    texts = [prose(n, n) for n in (1, 2, 5, 12, 40, 300)] + ["", None, "?!", "der die das", "no anchor here", "the", "the end", "Of mice; and men, and of the of"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", spotsigs.signatures(F.col("text")).alias("sigs"))
    got = {r.i: set(r.sigs) for r in rows.collect()}
    flat = spark.createDataFrame([(i, s) for i, t in enumerate(texts) for s in plain_signatures(t)], "i long, s string")
    want = {}
    for r in flat.select("i", F.shiftright(F.xxhash64("s"), 32).cast("int").alias("h")).collect():
        want.setdefault(r.i, set()).add(r.h)
    assert got == want


def test_one_chain_less_moves_a_likeness_by_its_share(spark):
    chains = [f"the {x}alpha {x}beta" for x in "bcdfghkl"]
    texts = [" of ".join(chains[:n]) for n in range(1, 9)]
    for whole, less in zip(texts[1:], texts):
        a, b = plain_signatures(whole), plain_signatures(less)
        assert len(a & b) / len(a | b) >= 1 - 2 / len(a)


def test_a_group_of_near_copies_is_not_paired(spark):
    """Hundreds of fingerprints of one group share keys with each other and with few others."""
    rnd, centre = random.Random(9), random.Random(10).getrandbits(64)
    crowd = {centre}
    while len(crowd) < 800:
        x = rnd.choice(sorted(crowd)[:40])
        for bit in rnd.sample(range(64), 2):
            x ^= 1 << bit
        crowd.add(x)
    rows = [(simhash._signed(x), simhash._signed(x), 1) for x in sorted(crowd)]
    far = simhash._signed(centre ^ (1 << 3) ^ (1 << 40))
    rows = [r for r in rows if r[0] != far] + [(far, far, 2)]
    nodes = spark.createDataFrame(rows, "node long, fp long, grp long")
    want = sum((far ^ r[0]) % (1 << 64) and ((far ^ r[0]) & (2**64 - 1)).bit_count() <= 4 for r in rows[:-1])
    met = simhash._across(nodes, 4)
    assert met.count() == want
    alone = simhash._across(nodes.where("grp = 1"), 4)
    assert alone.count() == 0
    assert max(_join_rows(spark, alone), default=0) < 10_000


def _join_rows(spark, df):
    """Rows that each join of the executed plan has made."""
    df.collect()
    plan, found, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name and "numOutputRows" in str(node.metrics().keySet()):
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found
