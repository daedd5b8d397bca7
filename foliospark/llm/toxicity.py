"""Toxicity by compression distance: one zstandard dictionary of toxic words, one of ordinary words.

A window is a word between blanks. Each window is compressed twice, and the bytes that the toxic dictionary saves over
the ordinary one are its gain. Both dictionaries end in the same carrier, which stands before every window, so that no
block is stored raw and single bytes of gain show. A document's counts of windows per gain go into a logistic curve,
calibrated on labelled documents the dictionaries have not seen.

Fitting: the toxic dictionary is trained on the words of toxic documents that hold letter runs far commoner there (by
likelihood ratio), the ordinary one on words of the other documents. Then, in rounds, words the pair of dictionaries
misjudges are appended to the one they belong to. The fit uses at most ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` labelled
documents, the first by a hash of the id, and leaves out texts over ``FIT_CHARS`` code points; that bounds the driver's
share. Scoring reads whole texts of any length, in one pass without a shuffle.

Defined cases: a null or empty text has no windows and gets the curve's value there. Without labels of both kinds all
documents score 0. Contradicting labels of a document count as toxic; null labels do not count. Rows with equal ids each
keep their row. Extra columns pass through.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import add_columns, column

TOXIC_DOCS, ORDINARY_DOCS, FIT_CHARS = 1200, 2000, 50_000
WINDOW = re.compile(r"[^\W\d_]{1,24}")
CARRIER = bytes([*range(1, 9), 11, 12, *range(14, 28)])
TAIL = bytes(range(28, 32)) * 2
GRAMS = (5, 6)
ROUNDS, A_ROUND = 8, 48
RUN, LEAST, STEP, WHOLE, ONE_MATCH = 10, 6, 2, 1000, 4
TOXIC_BYTES, ORDINARY_BYTES, HARD_BYTES = 1024, 16384, 1 << 16
CACHED = 400_000


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()


@lru_cache(maxsize=8)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = dictionary + CARRIER
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters.from_level(
            19, min_match=6, search_log=10, hash_log=17, chain_log=17, target_length=256, source_size=128, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0),
    )


@lru_cache(maxsize=8)
def _runs(dictionary: bytes) -> frozenset[bytes]:
    return frozenset(dictionary[i:i + RUN] for i in range(len(dictionary) - RUN + 1))


def gain(word: str, model: Model) -> int:
    """Bytes that the toxic dictionary saves on a window over the ordinary one.

    A match costs over four bytes less what it saves, so a window without a run of ``RUN`` bytes from the toxic
    dictionary cannot gain ``LEAST`` bytes; such a window counts as no gain without being compressed. ``WHOLE`` is added
    where one match of the toxic dictionary spans the window.
    """
    data = _wide(f" {word} ")
    if _runs(model.toxic).isdisjoint([data[i:i + RUN] for i in range(0, len(data) - RUN + 1, 2)]):
        return 0
    data = CARRIER + data + TAIL
    ordinary, toxic = len(compressor(model.ordinary).compress(data)), len(compressor(model.toxic).compress(data))
    return ordinary - toxic + WHOLE * (ordinary - toxic >= 2 and toxic <= _empty(model.toxic) + ONE_MATCH)


@lru_cache(maxsize=8)
def _empty(dictionary: bytes) -> int:
    """The length of a window without a word."""
    return len(compressor(dictionary).compress(CARRIER + TAIL))


def _wide(text: str) -> bytes:
    """Two bytes a character: a match costs the same and saves twice as much, so gains are told apart more finely."""
    return text.encode("utf-16-le")


def windows(text: str | None) -> list[str]:
    return WINDOW.findall((text or "").lower())


class Gains(dict):
    """Gains by window, kept for the windows that come again."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = gain(word, self.model)
        return found


@lru_cache(maxsize=2)
def gains(model: Model) -> Gains:
    return Gains(model)


def features(words: list[str], known: Gains) -> list[float]:
    counts = Counter(map(known.__getitem__, words))
    spanned = [sum(n for g, n in counts.items() if g >= WHOLE + least) for least in (2, 4, LEAST)]
    whole = [*map(log, [1 + n for n in spanned]), *[float(n >= 2) for n in spanned[:2]], float(spanned[0] >= 3)]
    partly = [log(1 + sum(n for g, n in counts.items() if LEAST + STEP * i <= g < WHOLE)) for i in range(3)]
    return [1.0, *whole, *partly]


def probability(model: Model, x: list[float]) -> float:
    if not model.weights:
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(np.dot(model.weights, x), -30, 30))))


def _grams(word: str) -> set[str]:
    word = f" {word} "
    return {word, *(word[i:i + n] for n in GRAMS for i in range(len(word) - n + 1))}


def _held(docs: list[list[str]]) -> Counter:
    """In how many documents each letter run is."""
    cache: dict[str, set[str]] = {}
    found = Counter()
    for words in docs:
        own = set()
        for w in set(words):
            if w not in cache:
                cache[w] = _grams(w)
            own |= cache[w]
        found.update(own)
    return found


def _telling(toxic: list[Counter], n: int, ordinary: list[Counter], m: int) -> set[str]:
    """Letter runs that far more of ``n`` toxic than of ``m`` ordinary documents hold."""
    telling = set()
    held = Counter()
    for c in toxic:
        held.update(c)
    for gram, x in held.items():
        if x < 3:
            continue
        y = sum(c.get(gram, 0) for c in ordinary)
        if x / n >= 10 * (y + 0.5) / m:
            expect = (x + y) * n / (n + m)
            ratio = 2 * (x * log(x / expect) + (y * log(y / (x + y - expect)) if y else 0))
            if ratio >= 13:
                telling.add(gram)
    return telling


def _dictionary(words: list[str], size: int) -> bytes:
    samples = [_wide(f" {' '.join(words[i:i + 8])} ") for i in range(0, len(words), 8)]
    try:
        return zstandard.train_dictionary(size, samples, k=128, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-size:]


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _dictionaries(toxic: list[list[str]], ordinary: list[list[str]], telling: set[str]) -> Model:
    """Trained on the words of either side, then mended in rounds with the words they misjudge."""
    counted = Counter(w for doc in toxic for w in doc)
    marked = {w: n for w, n in counted.items() if not telling.isdisjoint(_grams(w))}
    plain = [w for doc in ordinary for w in doc]
    random.Random(7).shuffle(plain)
    alike = set().union(*map(_grams, marked))
    rivals = [w for w in dict.fromkeys(plain) if not alike.isdisjoint(_grams(w))]  # no other word can gain
    base_t = _dictionary([w for doc in toxic for w in doc if w in marked], TOXIC_BYTES)
    base_o = _dictionary(plain[:200_000], ORDINARY_BYTES)
    near: dict[str, None] = {}
    wrong: dict[str, None] = {}

    def made() -> Model:
        """The commonest of the added words stand last, where a match costs least."""
        own = sorted(near, key=lambda w: marked[w])
        return Model(base_t + _wide(f" {' '.join(own)} ")[-HARD_BYTES:], _wide(f" {' '.join(wrong)} ")[-HARD_BYTES:] + base_o)

    model = made()
    for _ in range(ROUNDS):
        missed = sorted((w for w in marked if w not in near and gain(w, model) < WHOLE), key=lambda w: -marked[w])
        again = [w for w in rivals if w not in wrong and gain(w, model) >= LEAST - STEP]
        if not missed and not again:
            break
        near.update(dict.fromkeys(missed[:A_ROUND]))
        wrong.update(dict.fromkeys(again))
        model = made()
    return model


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from all texts; the curve from gains under dictionaries that have not seen the text's third."""
    if not toxic or not ordinary:
        return Model(b"", b"")
    folds = [[[windows(t) for t in texts[k::3]] for k in range(3)] for texts in (toxic, ordinary)]
    held = [[_held(part) for part in side] for side in folds]

    def learned(parts: list[int]) -> Model:
        t, o = [sum((side[k] for k in parts), []) for side in folds]
        telling = _telling([held[0][k] for k in parts], len(t), [held[1][k] for k in parts], len(o))
        return _dictionaries(t, o, telling)

    x, y = [], []
    for k in range(3):
        rest = [i for i in range(3) if i != k]
        if all(any(side[i] for i in rest) for side in folds):
            known = Gains(learned(rest))
            for label, side in ((1.0, folds[0]), (0.0, folds[1])):
                x += [features(words, known) for words in side[k]]
                y += [label] * len(side[k])
    model = learned([0, 1, 2])
    if not x:
        return Model(b"", b"")
    return Model(model.toxic, model.ordinary, _fit_weights(np.array(x), np.array(y)))


def held_out(doc_id: Column) -> Column:
    """The rows that no fit may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """The model of the labelled documents that are not held out."""
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= fit_chars))
    usable = labels.select(column(id_col).alias("id"), column(label_col).alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    texts = {}
    for y, most in ((1, toxic_docs), (0, ordinary_docs)):
        picked = usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)  # so many rows at most
        found = rows.join(F.broadcast(picked), "id").dropDuplicates(["id"]).select("id", "text").toArrow()
        texts[y] = [t for _, t in sorted(zip(found.column("id").to_pylist(), found.column("text").to_pylist()))]
    return fit_texts(texts[1], texts[0])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 under ``name``."""
    def scores(texts: pa.Array) -> list[pa.Array]:
        known = gains(model)
        return [pa.array([probability(model, features(windows(t.as_py()), known)) for t in texts], pa.float64())]

    return add_columns(docs, [text_col], [(name, "double")], scores)
