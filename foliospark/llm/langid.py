"""Language of words and documents by a linear-chain conditional random field.

The words of a text (runs of letters, lower-cased) are a chain, and each has a language. What speaks for a language at a word
is learned for letter runs inside it, for its affixes of up to three letters (both hashed into ``SLOTS``) and for how often
each language's training texts have the word; how readily one language follows another is learned with them. Forward-backward
sums give every word the probability of each language given the whole text, so words of another language inside a text
are told from it. A document's language is the one with the largest mean over its words, and that mean is its score.

Fitting: the lexicon counts the words of all labelled texts. The weights are fitted to at most ``DOCS`` labelled documents a
language, spread evenly by a hash, by full gradients: every step is a Spark job that adds up expected and found features over
the tasks. Training chains are texts of the sample cut into stretches of ``STRETCH`` words that take turns, so that switches are
seen. Scoring reads whole texts in one pass without a shuffle.

Chains of any length are worked through in blocks: the blocks' transfer matrices are multiplied up side by side, a scan over
them brings each block its left and right context, and both passes inside the blocks run side by side again. This is exact.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as all are if no text is labelled. Held-out
rows are never learned from, rows without id are; rows with equal ids each keep their row. Extra columns pass
through; ones named like the new columns are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import add_columns, column
from foliospark.operators.shared import materialise, task_sums

SLOTS, LEXICON, DOCS, STEPS, RATE, RIDGE = 1 << 15, 1 << 16, 300, 20, 0.15, 1e-5
BLOCK, PIECE_CHARS, TOGETHER, STRETCH = 32, 1 << 20, 8, 20
RUNS = re.compile(r"[^\W\d_]+")
BEGIN, END = 2, 3
SPANS = "array<struct<start:int,end:int,lang:string,score:double>>"


@dataclass(frozen=True)
class Weights:
    """``grams`` by slot and language, ``lexicon`` and ``bias`` by language, ``turns`` from one language to the next; in single
    precision, as they are sent to the tasks with every step."""

    grams: np.ndarray
    lexicon: np.ndarray
    bias: np.ndarray
    turns: np.ndarray

    @staticmethod
    def unflat(x: np.ndarray, k: int) -> Weights:
        g, x = SLOTS * k, x.astype(np.float32)
        return Weights(x[:g].reshape(SLOTS, k), x[g:g + k], x[g + k:g + 2 * k], x[g + 2 * k:].reshape(k, k))

    def flat(self) -> np.ndarray:
        return np.concatenate((self.grams.ravel(), self.lexicon, self.bias, self.turns.ravel()))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    counts: np.ndarray  # lexicon slot by language
    weights: Weights | None = None


def words_of(text: str | None) -> list[str]:
    found = RUNS.findall(text.lower()) if text else []
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found if w.isalpha() or any(map(str.isalpha, w))]


def _distinct(words: list[str]) -> tuple[list[str], np.ndarray]:
    coded = pa.array(words, pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def lexicon_slots(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % LEXICON for w in words), np.int64, len(words))


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word, slot)`` of every run of one to three letters and every prefix and suffix of as many, in no order."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    edge = (codes == BEGIN) | (codes == END)
    owners, slots, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        m = max(0, len(codes) - n + 1)
        h = h[:m] * np.uint64(0x100000001B3) + codes[n - 1:]
        inside = word[:m] == word[n - 1:]
        affix = edge[:m] ^ edge[n - 1:]
        inside &= ~edge if n == 1 else (affix if n == 4 else ~(edge[:m] & edge[n - 1:]))
        mixed = (h[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        owners.append(word[:m][inside])
        slots.append((mixed >> np.uint64(48)).astype(np.int64) % SLOTS)
    return np.concatenate(owners), np.concatenate(slots)


class Features:
    """What is known of each distinct word before weights come in."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.n = len(words)
        self.word, self.slot = gram_slots(words)
        self.scale = 1 / np.sqrt(np.maximum(1, np.bincount(self.word, minlength=self.n)))
        held = np.log((counts[lexicon_slots(words)] + 1.0) / (counts.sum(0, dtype=float) + LEXICON))
        self.held = held - held.mean(1, keepdims=True)

    def emissions(self, w: Weights) -> np.ndarray:
        grams = np.stack([np.bincount(self.word, w.grams[self.slot, j], self.n) for j in range(w.grams.shape[1])], 1)
        return grams * self.scale[:, None] + self.held * w.lexicon + w.bias

    def gradient(self, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the emissions with these weights: by gram, lexicon and bias."""
        scaled = by_word * self.scale[:, None]
        grams = np.stack([np.bincount(self.slot, scaled[self.word, j], SLOTS) for j in range(by_word.shape[1])], 1)
        return grams, (by_word * self.held).sum(0), by_word.sum(0)


def _unit(x: np.ndarray, axis: int | tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    total = x.sum(axis, keepdims=True)
    return x / total, total


def forward_backward(emit: np.ndarray, sizes: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For chains of ``sizes`` words one after the other, none of them empty: each word's probabilities, the expected number
    of turns from one language to the next, and the log of the sum over all labellings."""
    k, n = emit.shape[1], len(emit)
    if not n:
        return emit, np.zeros((k, k)), 0.0
    blocks = -(-sizes // BLOCK)
    chain = np.repeat(np.arange(len(sizes)), blocks)
    first_block = np.cumsum(blocks) - blocks
    nth = np.arange(len(chain)) - first_block[chain]
    starts = (np.cumsum(sizes) - sizes)[chain] + nth * BLOCK
    held = np.minimum(BLOCK, sizes[chain] - nth * BLOCK)
    at = starts[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < held[:, None]
    at = np.where(real, at, 0)
    top, most = emit.max(1), turns.max()
    x = np.exp(emit - top[:, None])[at]
    step = np.exp(turns - most)
    begins = nth == 0

    def forth(a: np.ndarray, t: int) -> np.ndarray:
        """One word on from ``a``; a chain's first word follows nothing."""
        moved = a @ step
        if t == 0:
            moved = np.where(begins.reshape(-1, *[1] * (a.ndim - 1)), a, moved)
        return moved * (x[:, t] if a.ndim == 2 else x[:, None, t])

    through = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for t in range(BLOCK):
        moved = forth(through, t)
        through = np.where(real[:, t, None, None], _unit(moved, (1, 2))[0], through)
    left, right = np.full((len(chain), k), 1 / k), np.full((len(chain), k), 1 / k)
    by_size = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max())):
        live = by_size[:np.searchsorted(-blocks[by_size], -j)]
        b = first_block[live] + j
        left[b] = _unit((left[b - 1][:, None] @ through[b - 1])[:, 0], 1)[0]
        e = first_block[live] + blocks[live] - 1 - j
        right[e] = _unit((through[e + 1] @ right[e + 1][:, :, None])[:, :, 0], 1)[0]
    before, ahead = np.empty((BLOCK, len(chain), k)), np.empty((BLOCK, len(chain), k))
    a, total = left, float(top.sum() + most * (n - len(sizes)) + np.log(k) * len(sizes))  # all languages begin alike, with weight one
    for t in range(BLOCK):
        before[t] = a
        moved, size = _unit(forth(a, t), 1)
        total += np.log(size[real[:, t]]).sum()
        a = np.where(real[:, t, None], moved, a)
    b = right
    for t in reversed(range(BLOCK)):
        ahead[t] = b
        came = x[:, t] * b
        moved = came @ step.T
        if t == 0:
            moved = np.where(begins[:, None], came, moved)
        b = np.where(real[:, t, None], _unit(moved, 1)[0], b)
    found, pairs = np.empty((n, k)), np.zeros((k, k))
    for t in range(BLOCK):
        use = real[:, t]
        found[at[use, t]] = _unit(forth(before[t], t)[use] * ahead[t][use], 1)[0]
        if t == 0:
            use = use & ~begins
        joint = before[t][use][:, :, None] * step * (x[use, t] * ahead[t][use])[:, None]
        pairs += _unit(joint, (1, 2))[0].sum(0)
    return found, pairs, total


def pieces(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of texts that are worked on together; a text is never cut."""
    held, chars = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        chars += len(text or "")
        if chars >= PIECE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def marginals(chains: list[list[str]], model: Model) -> list[np.ndarray]:
    """Probabilities of each language for each word of each chain."""
    sizes = np.array([len(c) for c in chains], np.int64)
    words, index = _distinct([w for c in chains for w in c])
    if not len(index):
        return [np.zeros((0, len(model.langs)))] * len(chains)
    emit = Features(words, model.counts).emissions(model.weights)[index]
    found, _, _ = forward_backward(emit, sizes[sizes > 0], model.weights.turns)
    return np.split(found, np.cumsum(sizes)[:-1])


def held_out(doc_id: Column) -> Column:
    """The rows that no fit may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lexicon(rows: DataFrame, langs: tuple[str, ...]) -> np.ndarray:
    """How often each language's texts have a word of each slot, over all rows."""
    number = {lang: j for j, lang in enumerate(langs)}

    def counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        own = np.zeros((LEXICON, len(langs)))
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for piece in pieces(texts):
                by_lang: dict[str, list[str]] = {}
                for i in piece:
                    by_lang.setdefault(of[i], []).extend(words_of(texts[i]))
                for lang, said in by_lang.items():
                    words, index = _distinct(said)
                    np.add.at(own[:, number[lang]], lexicon_slots(words), np.bincount(index, minlength=len(words)))
        return own.ravel()

    total = task_sums(rows.select("text", "lang"), counted)
    return (total if total is not None else np.zeros(LEXICON * len(langs))).reshape(LEXICON, len(langs)).astype(np.float32)


def _sample(rows: DataFrame, counts: dict[str, int], docs: int) -> DataFrame:
    """At most ``docs`` rows a language, the first by a hash; far larger hashes are left out before rows are ranked."""
    place = F.xxhash64(F.lit("sample"), "id", "text")
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 3 * docs / n + 20 / n))])
    near = rows.withColumn("_h", place).where(F.pmod("_h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))
    order = Window.partitionBy("lang").orderBy("_h", "id", "text")
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= docs).select("id", "text", "lang", "_h")


def chained(docs: list[tuple[list[str], int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, labels and lengths of training chains: stretches of a few documents take turns in each."""
    words, labels, sizes = [], [], []
    for i in range(0, len(docs), TOGETHER):
        group = [d for d in docs[i:i + TOGETHER] if d[0]]
        cut = [(j, at, said[at:at + STRETCH + 3 * j], lang) for j, (said, lang) in enumerate(group) for at in range(0, len(said), STRETCH + 3 * j)]
        cut.sort(key=lambda c: (c[1] // (STRETCH + 3 * c[0]), c[0]))
        for _, _, part, lang in cut:
            words += part
            labels += [lang] * len(part)
        if cut:
            sizes.append(sum(len(c[2]) for c in cut))
    return words, np.array(labels, np.int64), np.array(sizes, np.int64)


def log_likelihood(chains: tuple[list[str], np.ndarray, np.ndarray], counts: np.ndarray, w: Weights) -> np.ndarray:
    """Its value and its gradient by all weights, one after the other, and the number of words."""
    said, labels, sizes = chains
    k = len(w.bias)
    words, index = _distinct(said)
    known = Features(words, counts)
    emit = known.emissions(w)[index]
    found, pairs, total = forward_backward(emit, sizes, w.turns)
    by_place = -found
    by_place[np.arange(len(index)), labels] += 1
    by_word = np.stack([np.bincount(index, by_place[:, j], len(words)) for j in range(k)], 1)
    follows = np.ones(len(index), bool)
    follows[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(follows)
    seen = np.bincount(labels[at - 1] * k + labels[at], minlength=k * k).reshape(k, k)
    value = emit[np.arange(len(index)), labels].sum() + (seen * w.turns).sum() - total
    gradient = Weights(*known.gradient(by_word), seen - pairs).flat()
    return np.append(gradient, [value, len(index)])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = DOCS, steps: int = STEPS) -> Model:
    """The model of the labelled documents that are not held out; weights from at most ``most`` documents a language."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = tuple(sorted(counts))
    if not langs:
        return Model((), np.zeros((LEXICON, 0)))
    k, number = len(langs), {lang: j for j, lang in enumerate(langs)}
    lexicon = _lexicon(rows, langs)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # its size is set by LEXICON and the languages
    sample = materialise(_sample(rows, counts, most).repartition(len(langs) * most // 100 + 1, "_h").sortWithinPartitions("_h", "id", "text"))
    x, mean, square = np.zeros(SLOTS * k + 2 * k + k * k), 0.0, 0.0
    for step in range(1, steps + 1):
        w = Weights.unflat(x, k)

        def gradient(batches: Iterator[pa.RecordBatch], w: Weights = w) -> np.ndarray:
            total = np.zeros(SLOTS * k + 2 * k + k * k + 2)
            for batch in batches:
                texts, of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for piece in pieces(texts):
                    chains = chained([(words_of(texts[i]), number[of[i]]) for i in piece])
                    if len(chains[2]):
                        total += log_likelihood(chains, shared.value, w)
            return total

        total = task_sums(sample.select("text", "lang"), gradient)
        if total is None or not total[-1]:
            break
        g = total[:-2] / total[-1] - RIDGE * x
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    shared.destroy()
    return Model(langs, lexicon, Weights.unflat(x, k))


def _without(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[column(c) for c in docs.columns if c not in names])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and its ``score``."""
    def made(column_of_texts: pa.Array) -> list[pa.Array]:
        texts = column_of_texts.to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        for piece in pieces(texts) if model.langs else ():
            for i, p in zip(piece, marginals([words_of(texts[i]) for i in piece], model)):
                if len(p):
                    mean = p.mean(0)
                    j = int(mean.argmax())
                    lang[i], score[i] = model.langs[j], min(1.0, float(mean[j]))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return add_columns(_without(docs, "lang_pred", "score"), [text_col], [("lang_pred", "string"), ("score", "double")], made)


def spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: stretches of words that are likeliest in one language, in code points of the text, end
    exclusive, with the mean probability of their words."""
    def of(text: str | None) -> list[dict]:
        at = [(m.start(), m.end(), m.group().lower()) for m in RUNS.finditer(text or "")]
        at = [(a, b, w) for a, b, word in at if (w := "".join(filter(str.isalpha, word)))]
        if not at or not model.langs:
            return []
        p = marginals([[w for _, _, w in at]], model)[0]
        best = p.argmax(1)
        cut = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(at)]
        return [{"start": at[a][0], "end": at[b - 1][1], "lang": model.langs[best[a]], "score": float(p[a:b, best[a]].mean())} for a, b in zip(cut, cut[1:])]

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))
    return add_columns(_without(docs, "spans"), [text_col], [("spans", SPANS)], lambda texts: [pa.array([of(t.as_py()) for t in texts], kind)])
