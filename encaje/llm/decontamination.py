"""Benchmark decontamination by an FM-index per shard of training texts.

A shard is one batch of documents in a task. Its words become numbers, of which only those of the
phrases count; runs of them that are shorter than the shortest phrase cannot hold one and are
left out. The index of a shard is the Burrows-Wheeler transform as a wavelet matrix, with every
16th text position sampled. Phrases are searched backward, all at once, by ranks; occurrences are located by
stepping to sampled positions; the spans of a document are merged. No row leaves its partition.

Phrases are windows of 10 consecutive words of an item; a shorter item is one phrase. Null texts have no
words. Items without words are no phrases.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encaje.llm.common import by_batch, fields, fresh, texts
from encaje.session import written

WINDOW = 10
BLOCK_BYTES = 8 << 20  # benchmark text that is broadcast at once
SHARD_SYMBOLS = 4 << 20
SAMPLE = 16
_TABLE = bytearray(range(256))
for _i in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]:
    _TABLE[_i] = 0x20
for _i in range(26):
    _TABLE[0x41 + _i] = 0x61 + _i
FOLD = bytes(_TABLE)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(data: bytes) -> list[bytes]:
    """Lower-cased words of digits, letters and all beyond ASCII."""
    return data.translate(FOLD).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; ``text`` ends with its only smallest symbol."""
    n, k = len(text), 1
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    sorted_ = text[order]
    rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    while rank[order[-1]] < n - 1:
        key = rank * n
        key[:n - k] += rank[k:]
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        k *= 2
    return order


class FMIndex:
    """Count and locate patterns of positive symbols in an array of positive symbols."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.concatenate([np.asarray(text, dtype=np.int64), [0]])
        order = suffix_array(text)
        last = text[order - 1]  # position -1 is the closing 0
        self.n, self.top = len(text), int(text.max())
        self.bits = max(1, self.top.bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = last
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.last = last
        counts = np.bincount(text, minlength=(1 << self.bits) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = (order % sample == 0)
        self.sample_at = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the transform."""
        low, high = np.zeros_like(at), at
        for b in range(self.bits):
            bit = (symbol >> (self.bits - 1 - b)) & 1
            ones = self.ones[b]
            one_low, one_high = ones[low], ones[high]
            low = np.where(bit == 1, self.zeros[b] + one_low, low - one_low)
            high = np.where(bit == 1, self.zeros[b] + one_high, high - one_high)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns, a row each: their ranges."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        known = patterns.max(axis=1) <= self.top
        high[~known] = 0
        live = np.flatnonzero(known)
        for i in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, i]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their rows, by steps to sampled positions."""
        out, at, steps = np.zeros(len(rows), dtype=np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.samples[self.sample_at[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            c = self.last[at]
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """The windows of a block of items, by length, with the items that hold them."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], list[str]] = field(default_factory=dict)
    by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = field(default_factory=dict)

    def add(self, item: str, data: bytes, window: int = WINDOW) -> None:
        ids = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words(data)]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1) if ids else ():
            items = self.windows.setdefault(tuple(ids[i:i + size]), [])
            if not items or items[-1] != item:
                items.append(item)

    def close(self) -> Phrases:
        lengths: dict[int, list] = {}
        for w, items in self.windows.items():
            lengths.setdefault(len(w), []).append((w, items))
        self.by_length = {n: (np.array([w for w, _ in x], dtype=np.int64), [i for _, i in x])
                          for n, x in lengths.items()}
        self.windows = {}
        return self

    def occurrences(self, batch: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """Merged hit spans in words, and the items found, of each document."""
        out: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in batch]
        if not self.by_length:
            return out
        least, get = min(self.by_length), self.numbers.get
        parts, size, begun = [], 0, 0
        for d, doc in enumerate(batch):
            known = np.fromiter((get(w, 0) for w in doc), dtype=np.int64, count=len(doc))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], known > 0, [0]]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= least:
                    parts.append((d, a, known[a:b]))
                    size += b - a + 1
            if size > SHARD_SYMBOLS:
                self._search(parts, size, out)
                parts, size = [], 0
        if parts:
            self._search(parts, size, out)
        return [(merged(spans), items) for spans, items in out]

    def _search(self, parts: list, size: int, out: list) -> None:
        text = np.ones(size, dtype=np.int64)  # 1 parts the runs
        starts = np.zeros(len(parts), dtype=np.int64)
        at = 0
        for i, (_, _, run) in enumerate(parts):
            starts[i] = at
            text[at:at + len(run)] = run
            at += len(run) + 1
        index = FMIndex(text)
        for length, (patterns, items) in self.by_length.items():
            low, high = index.search(patterns)
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            counts = (high - low)[found]
            which = np.repeat(found, counts)
            first = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            place = index.locate(first + np.arange(len(which)))
            run = np.searchsorted(starts, place, side="right") - 1
            for k, r, p in zip(which.tolist(), run.tolist(), (place - starts[run]).tolist(),
                               strict=True):
                d, a, _ = parts[r]
                out[d][0].append((a + p, a + p + length))
                out[d][1].update(items[k])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size: each is one broadcast and one pass."""
    phrases, size = Phrases(), 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"),
                                F.col("text").alias("t")).toLocalIterator():
        data = (row["t"] or "").encode()
        phrases.add(row["i"] or "", data, window)
        size += len(data)
        if size > BLOCK_BYTES:
            yield phrases.close()
            phrases, size = Phrases(), 0
    yield phrases.close()


Found = list[tuple[int, list[tuple[int, int]], set]]  # words, merged spans in words, items


def by_hits(docs: DataFrame, benchmark: DataFrame, schema: T.StructType,
            finish: Callable[[pa.Array, Found], list], keep: list[str], window: int = WINDOW,
            text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every document and the columns that ``finish`` makes of its text
    and its hits.

    Each pass over the texts has one Python step; between the passes of a benchmark of several
    blocks the hits so far are written.
    """
    name = fresh(docs, "_hits")
    kind = fields(f"`{name}` struct<n_words: long, starts: array<long>, ends: array<long>, "
                  "items: array<string>>")
    context, rest = docs.sparkSession.sparkContext, blocks(benchmark, window)
    block, held = next(rest), []
    while True:
        following = next(rest, None)
        shared, last = context.broadcast(block), following is None

        def run(text: pa.Array, *before: pa.Array, shared=shared, last=last) -> list:
            batch = [words(x) for x in texts(text)]
            found = [(len(doc), spans, items) for doc, (spans, items) in zip(
                batch, shared.value.occurrences(batch), strict=True)]
            del batch
            for i, o in enumerate(before[0].to_pylist() if before else ()):
                n, spans, items = found[i]
                found[i] = (n, merged(spans + list(zip(o["starts"], o["ends"], strict=True))),
                            items | set(o["items"]))
            if last:
                return finish(text, found)
            return [[{"n_words": n, "starts": [a for a, _ in spans],
                      "ends": [b for _, b in spans], "items": sorted(items)}
                     for n, spans, items in found]]

        passed = keep if last else list(dict.fromkeys([*keep, text_col]))
        docs = by_batch(docs, [text_col, *held], schema if last else kind, run, keep=passed)
        if last:
            return docs
        docs, block, held = written(docs, "hits"), following, [name]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""

    def digest(_: pa.Array, found: Found) -> list:
        hit = [sum(b - a for a, b in spans) for _, spans, _ in found]
        return [[n for n, _, _ in found], hit, [len(items) for _, _, items in found],
                [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                 for _, _, items in found],
                [h > 0 for h in hit]]

    return by_hits(docs, benchmark, fields(
        "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"),
        digest, ["doc_id"], window)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, given in words; white space around a span is left."""
    if not spans:
        return text
    folded = WORD.finditer(text)
    places = [m.span() for m in folded]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join(parts) + text[at:]


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their columns, benchmark spans cut from ``text``; ``n_chars``, if
    there, follows. Documents of which no word is left are dropped; those without words before stay.
    """
    new, gone = fresh(docs, "_cut"), fresh(docs, "_gone")

    def finish(text: pa.Array, found: Found) -> list:
        return [[cut(t, spans) if t and spans else t
                 for t, (_, spans, _) in zip(text.to_pylist(), found, strict=True)],
                [spans == [(0, n)] for n, spans, _ in found]]

    done = by_hits(docs, benchmark, fields(f"`{new}` string, `{gone}` boolean"), finish,
                   docs.columns, window)
    done = done.where(~F.col(gone)).withColumn("text", F.col(new))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.char_length("text").cast(kind))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
