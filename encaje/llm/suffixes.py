"""Repeated byte strings over the whole corpus, found by suffix sorting of shards.

Every string of 400 bytes holds a chosen gram of 200 bytes, the one with the least hash; equal strings
choose the same. Consecutive strings with the same gram form a segment. Segments meet by the hash of
their gram: alone, nothing repeats; equal segments repeat whole; different segments with the same gram are
sent, each text once, to the gram's shard. There the gram is named by one symbol and the suffixes are
sorted by external induced sorting (:mod:`encaje.llm.induced`); a string repeats if its suffix
shares its whole length with a neighbour. The decisions go back to all occurrences by the hash
of the segment. A gram with very many different segments is decided by counting the hashes of
their strings instead, so no group grows without bound.

Null texts are empty. Documents shorter than the length lose nothing. Copies lose everything.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaje.llm.common import by_batch, fields, texts, to_rows
from encaje.llm.induced import SMALL, repeated_starts
from encaje.session import written

LENGTH = 400
GRAM = 200
CHUNK = 1 << 20
SHARD_SYMBOLS = 2 << 20
HOT_SEGMENTS = 20_000  # different segments of one gram that a shard takes
BROADCAST_BYTES = 128 << 20  # what may be broadcast, by counted rows and list entries
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 40, 1 << 62)) | 1
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on."""
    n = len(data)
    if len(_POWERS[0]) < n + 1:
        _POWERS[:] = [_powers(n + 1, _BASE), _powers(n + 1, pow(_BASE, -1, 1 << 64))]
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _POWERS[0][:n], dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _POWERS[1][:n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def grouped(docs: list[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    """Runs of texts of about ``size`` bytes together."""
    group, held = [], 0
    for d in docs:
        group.append(d)
        held += len(d)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def segments(docs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple]:
    """For each text: gram hashes, first starts, numbers of starts, gram positions in the
    segment, and hashes of the segments' bytes."""
    for group in grouped(docs):
        joined = b"".join(group)
        if len(joined) < length:
            yield from (([], [], [], [], []) for _ in group)
            continue
        h = gram_hashes(np.frombuffer(joined, dtype=np.uint8), gram)
        bits = np.uint64(max(24, len(joined).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        picked = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64),
                              length - gram + 1) & low).astype(np.int64)
        at = 0
        for d in group:
            if len(d) < length:
                at += len(d)
                yield [], [], [], [], []
                continue
            p = picked[at:at + len(d) - length + 1]
            first = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
            count = np.diff(np.append(first, len(p)))
            q = p[first]
            hashes = [hashlib.blake2b(d[i:i + n - 1 + length], digest_size=16).digest()
                      for i, n in zip(first.tolist(), count.tolist(), strict=True)]
            yield (h[q].view(np.int64).tolist(), first.tolist(), count.tolist(),
                   (q - at - first).tolist(), hashes)
            at += len(d)


def row_key() -> Column:
    """128 bits of id and text: rows that share it are repeated rows."""
    return F.unhex(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"),
                                     F.isnull("doc_id").cast("string"), F.col("text"))))


class Shard:
    """Decide the segments of a shard: which starts repeat in another segment."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram

    def text(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """All segments, each gram as one symbol, parted by 1; and where each begins."""
        names: dict[tuple, int] = {}
        parts, begin, at = [], np.zeros(len(rows), dtype=np.int64), 0
        for i, (fp, q, data) in enumerate(zip(rows["fp"], rows["q"], rows["data"],
                                              strict=True)):
            name = names.setdefault((fp, data[q:q + self.gram]), SMALL + len(names))
            left = np.frombuffer(data, np.uint8, q).astype(np.int32) + 2
            right = np.frombuffer(data, np.uint8, offset=q + self.gram).astype(np.int32) + 2
            parts += [left, np.array([name], dtype=np.int32), right, np.ones(1, dtype=np.int32)]
            begin[i] = at
            at += len(left) + len(right) + 2
        return np.concatenate([*parts, np.zeros(1, dtype=np.int32)]), begin

    def decide(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("seg").reset_index(drop=True)
        text, begin = self.text(rows)
        mark = repeated_starts(text, self.length - self.gram + 1)
        out = []
        for seg, b, n in zip(rows["seg"], begin.tolist(), rows["n"].tolist(), strict=True):
            hit = mark[b:b + n]
            if hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
                out.append((seg, edge[::2].tolist(), (edge[1::2] - 1).tolist()))
        return pd.DataFrame(out, columns=["seg", "low", "high"])


def _few(df: DataFrame, size: int) -> DataFrame:
    """Broadcast only if the counted bytes allow it; else Spark shuffles both sides."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _bytes(df: DataFrame, row: int, entry: int, *lists: str) -> int:
    """An upper estimate of a frame's bytes from its rows and the lengths of its lists."""
    entries = sum((F.size(c) for c in lists), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(F.lit(row) + entries * entry), F.lit(0)).alias("b")).first()["b"])


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
          hot: int = HOT_SEGMENTS) -> DataFrame:
    """``_key`` and the list of (low, high) byte ranges to remove, for documents that have any.

    ``docs`` has doc_id, text and ``_key`` of :func:`row_key`.
    """
    found = written(by_batch(
        docs, ["text"],
        fields("fp array<long>, first array<int>, n array<int>, q array<int>, "
               "seg array<binary>"),
        lambda t: list(zip(*segments(texts(t), length, gram))) or [[]] * 5, keep=["_key"]),
        "segments")
    each = found.where(F.size("fp") > 0).select("_key", F.explode(
        F.arrays_zip("fp", "first", "n", "q", "seg")).alias("s")).select("_key", "s.*")
    distinct = written(
        each.groupBy("fp", "seg").agg(
            F.count(F.lit(1)).alias("times"),
            F.min(F.struct("_key", "first", "n", "q")).alias("pick")), "distinct-segments")
    grams = distinct.groupBy("fp").agg(
        F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds"),
        F.min("times").alias("least")).where("all > 1")
    # most grams are alone: those that meet are written, as they are read twice
    known = written(distinct.join(grams, "fp"), "meeting-segments")
    whole = known.where("times > 1").select(
        "seg", F.array(F.lit(0)).alias("low"), F.array(F.col("pick.n") - 1).alias("high"))
    # a gram whose segments all repeat whole needs no sorting
    open_ = written(known.where("kinds > 1 AND least = 1").select(
        "fp", "seg", "times", "kinds", "pick.*"), "open-segments")
    total = open_.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(
        F.sum(F.col("n") + F.lit(length - gram + 2)), F.lit(0)).alias("symbols")).first()
    shards = max(1, math.ceil(total["symbols"] / SHARD_SYMBOLS))
    wanted = open_.groupBy("_key").agg(F.collect_set(
        F.struct("fp", "seg", "times", "kinds", "first", "n", "q")).alias("w"))
    sources = docs.join(_few(wanted, 96 * total["rows"]), "_key")

    def extract(text: pa.Array, lists: pa.Array) -> Iterator[tuple]:
        for data, w in zip(texts(text), lists.to_pylist(), strict=True):
            for s in w:
                yield (s["fp"], s["seg"], s["times"], s["kinds"], s["n"], s["q"],
                       data[s["first"]:s["first"] + s["n"] - 1 + length])

    bodies = written(to_rows(sources, ["text", "w"], fields(
        "fp long, seg binary, times long, kinds long, n int, q int, data binary"), extract),
        "segment-bytes")
    kind = "seg binary, low array<int>, high array<int>"
    decided = (bodies.where(F.col("kinds") <= hot)
               .groupBy(F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard"))
               .applyInPandas(lambda rows: Shard(length, gram).decide(rows), kind))

    def each_string(seg: pa.Array, n: pa.Array, data: pa.Array) -> Iterator[tuple]:
        for s, count, d in zip(seg.to_pylist(), n.to_pylist(), data.to_pylist(), strict=True):
            for i in range(count):
                yield s, i, hashlib.blake2b(d[i:i + length], digest_size=16).digest()

    strings = to_rows(bodies.where(F.col("kinds") > hot).dropDuplicates(["seg"]),
                      ["seg", "n", "data"], fields("seg binary, i int, hash binary"), each_string)
    twice = strings.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counted = strings.join(twice, "hash", "left_semi").groupBy("seg").agg(
        F.sort_array(F.collect_set("i")).alias("low")).select(
            "seg", "low", F.col("low").alias("high"))
    # a segment that occurs once only has ranges from its shard; one that repeats is whole
    single = decided.unionByName(counted).join(
        open_.where("times = 1").select("seg"), "seg", "left_semi")
    marks = written(whole.unionByName(single), "segment-marks")
    ranges = each.select("_key", "seg", "first").join(_few(marks, _bytes(marks, 64, 8, "low", "high")), "seg").select(
        "_key", F.explode(F.arrays_zip("low", "high")).alias("r"), "first").select(
            "_key", F.struct((F.col("first") + F.col("r.low")).alias("low"),
                             (F.col("first") + F.col("r.high") + length).alias("high"))
            .alias("r"))
    return ranges.groupBy("_key").agg(F.collect_set("r").alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_SEGMENTS,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text of every document.

    Removed are all bytes of strings of ``length`` bytes that also start anywhere else. ``spans`` lists the
    removed runs as start:end in bytes, ``text`` is what is left, without the rests of characters that a cut
    parts.
    """
    docs = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("_key", row_key())
    found = written(spans(docs, length, gram, hot), "removals")
    joined = docs.join(_few(found, _bytes(found, 64, 32, "ranges")), "_key", "left")

    def digest(text: pa.Array, ranges: pa.Array) -> list[list]:
        out: list[list] = [[] for _ in range(6)]
        for data, r in zip(texts(text), ranges.to_pylist(), strict=True):
            runs = merged([(x["low"], x["high"]) for x in r]) if r else []
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = [data[a:b] for a, b in zip(edges[::2], edges[1::2])]
            for o, x in zip(out, (len(data), sum(b - a for a, b in runs), len(runs),
                                  hashlib.sha256(b"".join(kept)).hexdigest(),
                                  ",".join(f"{a}:{b}" for a, b in runs),
                                  "".join(k.decode("utf-8", "ignore") for k in kept)), strict=True):
                o.append(x)
        return out

    return by_batch(joined, ["text", "ranges"], fields(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, text string"), digest,
        keep=["doc_id"])
