import base64
import random
import re
import zlib
from math import log2

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from foliospark.llm import bpe, linededup, secrets, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_tokens_are_those_of_the_tokenizer_library(spark, edges, nothing, prose):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(" \n\t\x1c\x85\xa0　 ab'sZ1!́é中\U0001f600") for _ in range(150)) for _ in range(60)]
    texts += ["ab" * 2000 + " " * 900, "a" * 3000, "don't we'll  ", "".join(map(chr, range(1, 0x2000)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(edges.select("doc_id", "text"))
    got = bpe.encode(rows, PATH, public_tokenizers.PATTERN, forms=("tokens", "n_tokens", "ids", "decoded"))
    seen = 0
    for r in got.collect():
        assert r.n_tokens == len(r.tokens) and bytes(r.ids) == b"".join(t.to_bytes(4, "little") for t in r.tokens)
        assert own.decode_bytes(r.tokens) == bytes(r.decoded)
        seen += r.tokens == own.encode_ordinary(bytes(r.decoded).decode())
    assert seen == rows.count()
    assert sorted(bytes(r.decoded) for r in bpe.decode(got, PATH).collect()) == sorted((r.text or "").encode() for r in rows.collect())
    assert bpe.encode(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_replay_takes_words_alone_where_ranks_run_backwards():
    table = bpe.ranks(PATH)
    words = [b"", b"a", *[bytes(random.Random(i).choices(b"abcdeth in", k=40)) for i in range(200)]]
    flat, ends = bpe.replay(b"".join(words), np.array([len(w) for w in words]), table)
    starts = [0, *ends[:-1].tolist()]
    assert [flat[a:b].tolist() for a, b in zip(starts, ends.tolist())] == [table.alone(w) for w in words]


def kept_lines(rows, least=40, often=5):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(space).encode().lower()
    held = {}
    for i, t in rows:
        for x in {key(x) for x in (t or "").split("\n") if len(x.strip(space)) >= least}:
            held.setdefault(x, set()).add(i)
    order = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < often or max(held[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_is_brute_force(edges, nothing):
    done = linededup.apply(linededup.build(edges), edges)
    got = sorted(((r.doc_id, r._n_lines, r._n_dropped, r.text or "") for r in done.collect()), key=str)
    assert got == kept_lines([(r.doc_id, r.text) for r in edges.collect()]) and sum(g[2] for g in got) == 10
    assert done.columns[:-2] == edges.columns
    assert linededup.apply(linededup.build(nothing), nothing).count() == 0


def test_salts_follow_the_postings_of_a_shard(edges, monkeypatch):
    whole = sorted(map(str, linededup.apply(linededup.build(edges), edges).collect()))
    for postings in (1, 3):
        monkeypatch.setattr(linededup, "POSTINGS_PER_SALT", postings)
        assert sorted(map(str, linededup.apply(linededup.build(edges), edges).collect())) == whole


def test_inserts_and_deletes_of_lines_are_reversible(spark):
    rnd = random.Random(4)
    lines = [f"line number {i} that several of the documents share" for i in range(30)]
    docs = spark.createDataFrame([(i, "\n".join(rnd.sample(lines, 12))) for i in range(40)], "doc_id long, text string")
    first, rest = docs.where("doc_id < 25"), docs.where("doc_id >= 25")
    table = lambda x: sorted(map(tuple, x.counts.select("key", "docs", "keeper").collect()))
    one, whole = linededup.build(first), linededup.build(docs)
    grown = linededup.insert(one, rest)
    assert table(grown) == table(whole)
    back = linededup.delete(grown, rest.select("doc_id"))
    assert table(back) == table(one)
    few = linededup.delete(back, docs.where("doc_id >= 5").select("doc_id"))
    assert table(few) == table(linededup.build(docs.where("doc_id < 5")))
    held = [linededup.CuckooFilter.load(r.filter) for r in few.filters.collect()]
    assert all(any(f.may_hold([k])[0] for f in held) for k, _, _ in table(few))
    same = lambda i: sorted(map(tuple, linededup.apply(i, docs).collect()))
    assert same(grown) == same(whole)


def test_cuckoo_filter():
    keys = [zlib.crc32(b"%d" % i).to_bytes(4, "big") * 4 for i in range(3000)]
    held = linededup.CuckooFilter.of(keys[:2000])
    assert held.may_hold(keys[:2000]).all() and held.may_hold(keys[2000:]).mean() < 0.01
    assert all(held.delete(k) for k in keys[:1000]) and held.may_hold(keys[1000:2000]).all()
    assert held.may_hold(keys[:1000]).mean() < 0.02 and linededup.CuckooFilter.load(held.dump()).may_hold(keys[1000:2000]).all()
    assert not held.may_hold([]).size


def test_toxicity_on_held_out_documents(spark, edges, nothing):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    own = toxicity.score(docs.join(labels, "doc_id"), model).where(toxicity.held_out(F.col("doc_id")))
    hit = own.agg(F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.7).cast("int"))).alias("recall"),
                  F.avg(F.when(F.col("toxic") == 0, (F.col("score") >= 0.7).cast("int"))).alias("wrong")).first()
    assert hit.recall > 0.75 and hit.wrong < 0.01
    got = toxicity.score(edges, model, name="own")
    assert got.columns == [*edges.columns, "own"] and got.where("own BETWEEN 0 AND 1").count() == edges.count()
    assert got.where("text IS NULL OR text = ''").select("own").distinct().count() == 1
    assert toxicity.score(nothing, model, name="own").count() == 0
    none = toxicity.fit(nothing, labels.limit(0))
    assert toxicity.score(edges, none, name="own").where("own <> 0").count() == 0
    out = spark.range(50).where(toxicity.held_out(F.col("id"))).collect()
    assert [r.id for r in out] == [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 1]


def test_a_window_without_a_run_in_common_never_gains():
    model = toxicity.fit_texts(["you are a wretch and a knave today my friend"] * 12, [f"we are all good people number {i} here" for i in range(24)])
    plain = toxicity.Model(model.toxic, model.ordinary)
    for word in ("wretch", "knave", "people", "good", "zzzzzzzz", "friend"):
        data = toxicity.CARRIER + toxicity._wide(f" {word} ") + toxicity.TAIL
        saved = len(toxicity.compressor(plain.ordinary).compress(data)) - len(toxicity.compressor(plain.toxic).compress(data))
        assert toxicity.gain(word, plain) % toxicity.WHOLE == saved or toxicity.gain(word, plain) == 0 and saved < toxicity.LEAST


BASE = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def test_base_spans_are_those_of_the_plain_patterns():
    rnd = random.Random(6)
    parts = ["PassWord", "token", "api_key", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCD1234EFGH5678IJ", "0123456789abcdef", "deadbeef", "xyz", "é", "hunter22", "a.b-c"]
    for _ in range(3000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 14)))
        want = sorted([(m.start(), k, m.end()) for k, p, ok in BASE for m in re.finditer(p, text) if ok(m)], key=lambda x: (x[0], secrets.KINDS.index(x[1])))
        assert secrets.base_spans(text) == want


def test_guess_costs():
    bits = secrets.guess_bits
    assert bits("password1") < bits("P4ssword1") < bits("hunter2") < bits("Xk9#mQ2$vL")
    assert bits("qwertyuiop") < bits("qwxrtmuzop") and bits("aaaaaaaaaaaa") < 12 and bits("20240131") < bits("97240861")
    assert bits("abcabcabcabc") < bits("abcxyzqwvmnb") and bits("") == 0.0
    text = 'login pass: password123 and Bearer 9fJ2kLmQ8xZr4TnV, the password is required. token = "abc"'
    found = [text[a:b] for a, _, b in secrets.guess_spans(text, secrets.base_spans(text))]
    assert found == ["9fJ2kLmQ8xZr4TnV"]


def test_secret_edges(spark, edges, nothing):
    got = secrets.scan(edges, name="found")
    assert got.columns == [*edges.columns, "found"] and got.where("size(found) > 0").count() == 0 and got.count() == edges.count()
    assert secrets.scan(nothing, name="found").count() == 0
    one = spark.createDataFrame([("é token=abcdef123",)], "text string")
    assert [tuple(s) for s in secrets.scan(one).first().spans] == [(2, "assign", 17)]


def test_values_of_joined_names_of_two_names_and_after_tabs_are_seen():
    v = "9fJ2kLmQ8xZr4TnV"
    for text in ("AWS_SECRET_ACCESS_KEY={}", "DB_PWD={}", "MYSQL_PWD: {}", "accessKeyId: {}", "login credentials: {}", "secret passphrase: {}",
                 "auth private_key = {}", "pwd\t=\t{}", "pwd => {}", "the login -> '{}'", '"clientSecretV2": "{}"'):
        text = text.format(v)
        base = secrets.base_spans(text)
        spans = base + secrets.guess_spans(text, base)
        assert any(text[a:b].endswith(v) for a, _, b in spans), text
    assert not any(secrets.guess_spans(t, []) for t in (f"secretary: {v}", f"the authors {v}", f"monkeypwd {v}"))


def test_values_of_letters_only_are_judged_by_the_words_of_the_corpus(spark):
    prose = "the password is remembered by the innkeeper and the token is transferable"
    other = "what is transferable is remembered"
    rows = spark.createDataFrame([(prose,)] * 6 + [(other,)] * 6 + [("pwd = qzjxkvbwplmtrhg",)], "text string")
    got = [(r.text, [r.text[s["start"]:s["end"]] for s in r.spans]) for r in secrets.scan(rows).collect()]
    assert got == [(prose, [])] * 6 + [(other, [])] * 6 + [("pwd = qzjxkvbwplmtrhg", ["qzjxkvbwplmtrhg"])]


def test_a_leaked_value_is_a_secret_however_often_it_is_there(spark):
    for times in (1, 5, 500):
        rows = spark.createDataFrame([("db_pwd = qzjxkvbwplmtrhg",)] * times + [(f"some prose of row {i} that repeats",) for i in range(20)], "text string")
        assert secrets.scan(rows).where("size(spans) = 1 AND spans[0].kind = 'guess'").count() == times
    copies = spark.createDataFrame([("we met in the old harbour, db_pwd = qzjxkvbwplmtrhg, and left",)] * 60, "text string")
    assert secrets.scan(copies).where("size(spans) = 1").count() == 60
    assert "qzjxkvbwplmtrhg" not in secrets.corpus_words(copies) and "harbour" in secrets.corpus_words(copies)


def cheapest(value, known, at=0, cache=None):
    """The definition, part by part: what the rest of a value costs, over all parts that may come next."""
    cache = {} if cache is None else cache
    if at == len(value):
        return 0.0
    if at in cache:
        return cache[at]
    steps, low = secrets._steps(), value.lower()
    best = secrets._char_bits(value[at]) + cheapest(value, known, at + 1, cache)
    for end in range(at + 2, len(value) + 1):
        part = low[at:end]
        costs = []
        if len(part) >= 3 and len(set(part)) == 1:
            costs.append(1 + secrets._char_bits(value[at]) + log2(len(part)))
        if len(part) >= 3 and all(p in steps for p in zip(part, part[1:])):
            costs.append(2 + log2(47) + log2(len(part)))
        m = secrets.DATE.match(value, at)
        if m and m.end() == end:
            costs.append(1 + (log2(120) if len(part) <= 4 else log2(120 * 365) + 2))
        if 3 <= len(part) <= secrets.MAX_PART and (bits := secrets._word_bits(value[at:end], known)) is not None:
            costs.append(1 + bits)
        if 2 <= len(part) <= secrets.MAX_PART and at >= len(part) and low[at - len(part):at] == part:
            costs.append(2)
        if costs:
            best = min(best, min(costs) + cheapest(value, known, end, cache))
    cache[at] = best
    return best


def test_guess_cost_is_the_cheapest_of_all_segmentations():
    rnd, known = random.Random(12), secrets.ranked(secrets.WORDS)
    parts = ["password", "Summer", "1999", "2024-01-31", "qwerty", "aaaa", "x", "Z", "7", "-", "dr4gon", "abab", "é", "lkjh", "310124"]
    for _ in range(400):
        value = "".join(rnd.choices(parts, k=rnd.randint(0, 5)))
        assert abs(secrets.guess_bits(value) - cheapest(value, known)) < 1e-9, value
