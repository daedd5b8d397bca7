"""Byte-level BPE by replaying merges over a block of the corpus at once.

Each task takes blocks of documents, splits their texts into the pattern's matches and keeps each distinct match once,
with an inverted index from a merge's rank to the places in those words where its pair stands. Merges are applied in
rank order to all their places at a time; only the neighbours of a merged place get a new pair, and so a new entry in
the index. A word in which a merge brings up a pair of lower rank than its own (possible, though rare, as ranks also
join pairs they were not learned from) is encoded by itself, lowest rank first.

Scale: a block's words, not its text, are what a merge touches, so repeated words cost nothing. Blocks are bounded by
``BLOCK_CHARS`` and independent: no shuffle, no broadcast, nothing to lose with an executor but a block in work. The rank
file is read by each worker from ``vocabulary``, a path that every machine has.

Defined cases: a null or empty text has no tokens and decodes to no bytes. Rows with equal ids each keep their row. A
text longer than a block is a block of its own. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from foliospark.llm.common import by_batch, column

BLOCK_CHARS, OUT_TOKENS = 1 << 22, 100_000
NONE = np.int32(2**31 - 1)
#: White space in the pattern's sense (Unicode White_Space).
BLANK = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A match never runs from the characters of one piece into the next: a piece is a blank with what follows it, or the
#: blanks before that one, or the blanks that end a text.
PIECES = re.compile(f"[{BLANK}]?[^{BLANK}]+|[{BLANK}]+(?=[{BLANK}][^{BLANK}])|[{BLANK}]+")


class Ranks:
    """A rank file as arrays: the bytes of all tokens, where each ends, and the rank of every pair that joins to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(rank.values()) + 1
        tokens = [b""] * self.size
        for token, r in rank.items():
            tokens[r] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([len(t) for t in tokens])
        self.first = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys, joined = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    joined.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.joined = np.array(keys, np.int64)[order], np.array(joined, np.int32)[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NONE)

    def pair(self, a: int, b: int) -> int | None:
        key = a * self.size + b
        at = int(np.searchsorted(self.keys, key))
        return int(self.joined[at]) if at < len(self.keys) and self.keys[at] == key else None

    def alone(self, word: bytes) -> list[int]:
        """One word, lowest rank first, leftmost among equals."""
        token = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pair(token[i], token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if token[i] < 0 or j >= n or self.pair(token[i], token[j]) != r:
                continue
            token[i], token[j] = r, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (q := self.pair(token[x], token[y])) is not None:
                    heapq.heappush(heap, (q, x))
        return [t for t in token if t >= 0]


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def replay(data: bytes, lengths: np.ndarray, table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, which stand one after the other in ``data``, and where each word's tokens end."""
    n, m = len(data), len(lengths)
    if not n:
        return np.zeros(0, np.int32), np.zeros(m, np.int64)
    word = np.repeat(np.arange(m, dtype=np.int32), lengths)
    token = table.first[np.frombuffer(data, np.uint8)]
    right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    starts = np.ones(n, bool)
    starts[1:] = word[1:] != word[:-1]
    left[starts] = -1
    right[np.append(starts[1:], True)] = -1
    pair = np.full(n, NONE, np.int32)  # the rank of the merge that starts at a place
    inner = np.flatnonzero(right >= 0).astype(np.int32)
    pair[inner] = table.of(token[inner], token[right[inner]])
    alive, odd = np.ones(n, bool), np.zeros(m, bool)
    index: dict[int, list[np.ndarray]] = {}

    def add(places: np.ndarray) -> list[int]:
        """File places under their rank; the ranks that had no entry."""
        found = pair[places]
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cut = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        fresh = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(found)]):
            r = int(found[a])
            if r in index:
                index[r].append(places[a:b])
            else:
                index[r] = [places[a:b]]
                fresh.append(r)
        return fresh

    live = inner[pair[inner] != NONE]
    heap = add(live) if len(live) else []
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[alive[at] & (pair[at] == r)]
        if not len(at):
            continue
        if len(lists) == 1:
            at = np.sort(at)
        touching = np.append(False, right[at[:-1]] == at[1:])
        if touching.any():  # of overlapping places every second one, from the left
            begins = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - begins) % 2 == 0]
        gone = right[at]
        after = right[gone]
        token[at] = r
        alive[gone] = False
        pair[gone] = NONE
        right[at] = after
        has = after >= 0
        left[after[has]] = at[has]
        before = left[at]
        touched = np.concatenate((at, before[before >= 0]))
        end = right[touched]
        pair[touched[end < 0]] = NONE
        touched, end = touched[end >= 0], end[end >= 0]
        new = table.of(token[touched], token[end])
        pair[touched] = new
        low = new < r
        if low.any():
            odd[word[touched[low]]] = True
        touched = touched[new != NONE]
        if len(touched):
            for q in add(np.unique(touched)):
                heapq.heappush(heap, q)
    counts = np.bincount(word[alive], minlength=m)
    tokens = token[alive]
    if odd.any():
        ends = np.cumsum(counts)
        at, parts, done = np.cumsum(lengths), [], 0
        for i in np.flatnonzero(odd).tolist():
            own = np.array(table.alone(data[at[i] - lengths[i]:at[i]]), np.int32)
            parts += [tokens[done:ends[i] - counts[i]], own]
            done, counts[i] = ends[i], len(own)
        tokens = np.concatenate([*parts, tokens[done:]])
    return tokens, np.cumsum(counts)


def _gather(flat: np.ndarray, ends: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``pick`` names, one after the other, and where each ends."""
    starts = np.concatenate(([0], ends[:-1]))[pick] if len(ends) else np.zeros(0, np.int64)
    size = ends[pick] - starts if len(pick) else np.zeros(0, np.int64)
    total = np.cumsum(size)
    if not len(pick) or not total[-1]:
        return flat[:0], total
    return flat[np.arange(total[-1]) + np.repeat(starts - (total - size), size)], total


def encode_block(texts: list[str | None], pattern, table: Ranks) -> Iterator[np.ndarray]:
    """The tokens of each text of a block."""
    pieces: dict[str, int] = defaultdict()  # numbers for new keys, in their order
    pieces.default_factory = pieces.__len__
    stream = []
    for text in texts:
        found = PIECES.findall(text) if text else ()
        stream.append(np.fromiter(map(pieces.__getitem__, found), np.int32, len(found)))
    words: dict[str, int] = defaultdict()
    words.default_factory = words.__len__
    made, made_ends = array("i"), array("q")
    for piece in pieces:
        made.extend(map(words.__getitem__, pattern.findall(piece)))
        made_ends.append(len(made))
    del pieces  # the merges need room of their own
    data = "".join(words).encode()
    lengths = np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words))
    del words
    flat, ends = replay(data, lengths, table)
    flat, word_ends = _gather(flat, ends, np.frombuffer(made, np.int32).astype(np.int64) if made else np.zeros(0, np.int64))
    ends = np.concatenate(([0], word_ends))[np.frombuffer(made_ends, np.int64)] if made_ends else np.zeros(0, np.int64)
    for pick in stream:
        yield _gather(flat, ends, pick)[0]


def decode_ids(tokens: np.ndarray, table: Ranks) -> bytes:
    return _gather(table.data, table.ends, tokens)[0].tobytes()


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           forms: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """``id`` and the wanted forms of each text, each match of ``pattern`` encoded by itself.

    ``tokens`` is the array of token ids, ``ids`` the same as little-endian unsigned 32-bit integers, ``n_tokens`` their
    number and ``decoded`` the bytes that the ids decode to; ``ids_sha256`` and ``decoded_sha256`` are hex digests of these.
    """
    kinds = {"tokens": ("array<int>", pa.list_(pa.int32())), "ids": ("binary", pa.binary()),
             "n_tokens": ("long", pa.int64()), "decoded": ("binary", pa.binary()),
             "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    packed = lambda t: t.astype("<u4").tobytes()
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, matcher = ranks(vocabulary), regex.compile(pattern)
        form = {"tokens": lambda t: t, "ids": packed, "n_tokens": len, "decoded": lambda t: decode_ids(t, table),
                "ids_sha256": lambda t: digest(packed(t)), "decoded_sha256": lambda t: digest(decode_ids(t, table))}
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(sizes, dtype=np.int64) // BLOCK_CHARS
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(block)) + 1):
                done, held = 0, [[] for _ in forms]
                part = batch.slice(int(at[0]), len(at)) if len(at) else batch.slice(0, 0)
                ids, waiting = part.column(0), 0
                for n, tokens in enumerate(encode_block(part.column(1).to_pylist(), matcher, table), 1):
                    for name, out in zip(forms, held):
                        out.append(form[name](tokens))
                    waiting += len(tokens)
                    if waiting >= OUT_TOKENS or n == len(part):
                        arrays = [pa.array(out, kinds[name][1]) for name, out in zip(forms, held)]
                        yield pa.RecordBatch.from_arrays([ids.slice(done, n - done), *arrays], ["id", *forms])
                        done, waiting, held = n, 0, [[] for _ in forms]

    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{name} {kinds[name][0]}" for name in forms]])
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``(id, decoded)``: the bytes that the ``tokens`` of each row stand for."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = ranks(vocabulary)
        data = [decode_ids(np.array(x.as_py() or [], np.int32), table) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return by_batch(encoded.select("id", "tokens"), f"id {kind}, decoded binary", one)
