"""Packing by cutting-stock column generation.

Documents become token ids. A document is cut into full sequences and a shorter rest. Rests are
counted in length classes; a linear program over patterns (how many rests of each class share one
sequence) is solved by column generation, where a knapsack dynamic program over the dual prices
finds the next pattern; the rounded patterns are then given to the documents by their rank
within the class.

Null and empty texts hold only the closing id. Equal rows are packed as often as they occur.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encaje.llm.common import by_batch, fields, ranked, strings, to_rows
from encaje.session import written

SEQUENCE = 4096
UNIT = 16  # width of a length class in tokens
CACHE_BYTES = 64 << 20  # of words, and as much again of their cores
ENTRY = 200  # bytes that an entry of a cache needs besides its ids
SPLIT_CHARS = ".,!*%&$#;:?"
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts as little-endian bytes, by a cache of words.

    White space always ends a token of this tokenizer, so a text's ids are those of its words
    in turn. A word that is plain letters and then punctuation is looked up in lower case and without
    the punctuation: both parts are tokenized apart anyway. Caches are emptied when they hold more
    than ``cache_bytes``.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        self.most = cache_bytes // ENTRY
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {"": b""}

    def plain(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in
                self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, cores: list[str]) -> None:
        """Words of letters only: many to a string, cut where a token closes a word."""
        runs = [cores[i:i + 200] for i in range(0, len(cores), 200)]
        encoded = self.tokenizer.encode_batch_fast(
            [" ".join(r) for r in runs], add_special_tokens=False)
        for run, e in zip(runs, encoded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) != len(run):  # never seen; the slow way is always right
                self.cores.update(zip(run, self.plain(run), strict=True))
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(run, ends.tolist(), strict=True):
                self.cores[word] = data[at:end]
                at = end

    def learn(self, words: set[str]) -> None:
        if len(self.words) > self.most:
            self.words = {"": b""}
        if len(self.cores) > self.most:
            self.cores = {"": b""}
        parts, odd = [], []
        for w in words:
            core = w.rstrip(SPLIT_CHARS)
            if core.isalpha() and max(core) < "Ā":
                parts.append((w, core.lower(), w[len(core):]))
            else:
                odd.append(w)
        self.letters([c for c in {p[1] for p in parts} if c not in self.cores])
        tails = [t for t in {p[2] for p in parts} if t not in self.cores]
        self.cores.update(zip(tails, self.plain(tails), strict=True))
        self.words.update((w, self.cores[c] + self.cores[t]) for w, c, t in parts)
        self.words.update(zip(odd, self.plain(odd), strict=True))

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        group, size = [], 0
        for text in batch:
            group.append(text.replace("\n", " ").split(" "))
            size += len(group[-1])
            if size > 200_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[bytes]:
        new = set().union(*group).difference(self.words) if group else set()
        if new:
            if len(self.words) > self.most:
                new = set().union(*group)
            self.learn(new)
        get = self.words.__getitem__
        for words in group:
            yield b"".join(map(get, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS or _ENCODERS[path].most != cache_bytes // ENTRY:
        _ENCODERS[path] = Encoder(path, cache_bytes)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Cut each document into full sequences and a rest; one row per piece."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = fields("start long, length long, ids_crc32 long, doc_tokens long")
    schema.fields.insert(0, docs.schema["doc_id"])
    close, width = np.array([end_id], dtype="<u4").tobytes(), 4 * sequence

    def cut(ids: pa.Array, text: pa.Array) -> Iterator[tuple]:
        made = encoder(path, cache_bytes).encode(strings(text))
        for doc_id, data in zip(ids.to_pylist(), made, strict=True):
            data += close
            for at in range(0, len(data), width):
                part = data[at:at + width]
                yield doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4

    return to_rows(docs, ["doc_id", "text"], schema, cut)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest price; item i has weight i + 1."""
    n = len(prices)
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = min(c, n)
        value = prices[:k] + best[c - 1::-1][:k]
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-12:
            best[c], took[c] = value[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(n, dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= took[c] + 1
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with plain array steps: threaded linear algebra has been seen to stand
    still beside a JVM."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, n:]


def patterns(demand: np.ndarray, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often to use each, for ``demand[i]`` items of i + 1 units.

    Column generation with a revised simplex. Its basis always is a feasible answer, so
    ``rounds`` bounds time only. The fractional answer is rounded down; what is left, less than one
    sequence per pattern of the basis, is placed best-fit by falling length.
    """
    n = len(demand)
    use = np.flatnonzero(demand > 0)
    if not len(use):
        return np.zeros((0, n), dtype=np.int64), np.zeros(0, dtype=np.int64)
    m, need = len(use), demand[use].astype(float)
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = n // (use + 1)
    inverse, x = np.diag(1.0 / np.diag(basis)), need / np.diag(basis)
    for step in range(rounds):
        dual = inverse.sum(axis=0)
        prices = np.zeros(n)
        prices[use] = np.maximum(dual, 0)
        value, pattern = knapsack(prices, n)
        if value <= 1 + 1e-7:
            break
        column = pattern[use].astype(float)
        turn = (inverse * column).sum(axis=1)
        ratio = np.where(turn > 1e-9, x / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * turn, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
        if step % 100 == 99:
            inverse = inverted(basis)
    shape, times = np.zeros((m, n), dtype=np.int64), np.floor(x + 1e-6).astype(np.int64)
    shape[:, use] = np.rint(basis.T).astype(np.int64)
    shape, times = shape[times > 0], times[times > 0]
    left = demand.astype(np.int64) - times @ shape
    while (left < 0).any():  # a pattern may offer more of a class than there is
        left = np.maximum(left, 0)
    rest: list[np.ndarray] = []
    room: list[int] = []
    for i in range(n - 1, -1, -1):
        for _ in range(int(left[i])):
            fits = [(r, k) for k, r in enumerate(room) if r > i]
            if fits:
                k = min(fits)[1]
            else:
                k = len(room)
                room.append(n)
                rest.append(np.zeros(n, dtype=np.int64))
            room[k] -= i + 1
            rest[k][i] += 1
    if rest:
        shape = np.vstack([shape, np.array(rest)])
        times = np.concatenate([times, np.ones(len(rest), dtype=np.int64)])
    return shape, times


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, unit: int = UNIT,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Every piece with its sequence and its place in it.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Only the histogram of
    ``sequence / unit`` length classes reaches the driver. An empty table gives no rows.
    """
    if sequence % unit:
        raise ValueError("sequence must be a multiple of unit")
    cut = written(pieces(docs, path or tokenizer_path(), sequence, end_id, id_col, text_col,
                         cache_bytes), "pieces")
    cut = cut.withColumn("_class", F.floor((F.col("length") + unit - 1) / unit).cast("int") - 1)
    demand = np.zeros(sequence // unit, dtype=np.int64)
    for row in cut.groupBy("_class").count().collect():  # one row per class at most
        demand[row["_class"]] = row["count"]
    shape, times = patterns(demand)
    first = np.concatenate([[0], np.cumsum(times)])[:-1]
    table = []  # per class: first rank, items per sequence, first sequence of each pattern
    for i in range(len(demand)):
        k = np.flatnonzero(shape[:, i]) if len(shape) else np.zeros(0, dtype=np.int64)
        each = shape[k, i] if len(k) else k
        starts = np.concatenate([[0], np.cumsum(each * times[k])])[:-1] if len(k) else k
        table.append((starts, each, first[k] if len(k) else k))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked(cut, ["_class"], columns, int(demand.sum()), "_rank")

    def find(classes: pa.Array, ranks: pa.Array) -> list:
        c, r = classes.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        out = np.zeros(len(c), dtype=np.int64)
        for i in np.unique(c):
            at = np.flatnonzero(c == i)
            starts, each, base = table[i]
            k = np.searchsorted(starts, r[at], side="right") - 1
            out[at] = base[k] + (r[at] - starts[k]) // each[k]
        return [out]

    found = by_batch(placed, ["_class", "_rank"], fields("sequence_id long"), find, keep=columns)
    w = (Window.partitionBy("sequence_id")
         .orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
         .rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("offset", F.sum("length").over(w) - F.col("length"))
