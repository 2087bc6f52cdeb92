"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of all orders with a uniform share:
``P(w | h) = l0 / (V + 1) + l1 c(w) / N + l2 c(h, w) / c(h) + ...``. The weights depend on how often the
longest known context occurs (buckets of its logarithm). They are learned by expectation-maximisation on
held-out counts: training documents fall into two parts, each part's n-grams are events that are estimated
from the counts of the other part alone (the deleted part), and all training counts are used in the end.

Texts become blocks of local word numbers. Each block asks for the counts of its distinct n-grams; the
requests of a key range meet in one task, so a word that fills a third of the corpus comes once per block. The
answers return to the blocks, which stay in place (a bucketed table). The events of all training tokens are
summed into a bounded grid of ratios per bucket, and only that grid reaches the driver. N-grams are known by
64-bit hashes.

Null text is empty and has one token, the end. A null id counts as an empty id text. Repeated rows are
documents of their own. An empty table gives no rows; without training tokens all words are unknown.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from encaje.llm.common import fields, mix64, release, small_batches, texts
from encaje.session import fresh_path, written

END = b" "  # no word holds white space
START = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)
HELD_OUT = 2
STEPS = 2  # grid cells per doubling of a ratio
CELLS = 512  # grid cells a ratio can fall into


@dataclass(frozen=True)
class Settings:
    """Order of the model and sizes of the work; none of them drops anything."""

    order: int = 2
    block_bytes: int = 4 << 20
    block_rows: int = 1 << 16
    task_keys: int = 1_500_000
    bucket_blocks: int = 4
    iterations: int = 60


# --- numbers in bytes that compress well -------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Bytes of the same weight side by side; high bytes of small numbers become runs of zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


# --- one block --------------------------------------------------------------------------------------

@dataclass
class Block:
    """Documents of a block: ids, part (0, 1; 2 is held out), tokens each, and word number of each token."""

    ids: list
    part: np.ndarray
    lens: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Block:
        """From the first row."""
        def data(name: str) -> pa.Buffer:
            return table[name][0].as_py()

        return cls(table["ids"][0].as_py(), np.frombuffer(data("part"), np.uint8),
                   np.frombuffer(data("lens"), np.int32), unpack(data("tokens"), np.int32),
                   np.frombuffer(data("hashes"), np.uint64))

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.lens) - self.lens

    def levels(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distinct keys, their place for each token) per order; n-grams do not leave a document."""
        sort = np.argsort(self.hashes)
        place = np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        yield self.hashes[sort], place[self.tokens]
        words, first = self.hashes[self.tokens], self.first
        keys = words
        for _ in range(1, order):
            before = np.empty_like(words)
            before[1:] = keys[:-1]
            before[first] = START
            keys = mix64(before * TURN + words)
            yield np.unique(keys, return_inverse=True)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _context(counts: list[np.ndarray], block: Block, docs: np.ndarray) -> list[np.ndarray]:
    """How often the context of each token occurs, per order from the second, in the same parts."""
    out = []
    for level in counts[:-1]:
        before = np.empty_like(level)
        before[1:] = level[:-1]
        before[block.first] = docs
        out.append(before)
    return out


def _estimates(counts: list[np.ndarray], contexts: list[np.ndarray], n: int, v: int):
    """(bucket, estimates of each order from the uniform one) of tokens; all counts from one source."""
    bucket = np.zeros(len(counts[0]), np.int64)
    ratio = [np.full(len(bucket), 1.0 / (v + 1)), counts[0] / max(n, 1)]
    for k, (c, context) in enumerate(zip(counts[1:], contexts), 1):
        known = context > 0
        ratio.append(np.divide(c, context, out=np.zeros(len(c)), where=known))
        bucket[known] = 64 * k + np.log2(context[known]).astype(np.int64)
    return bucket, ratio


# --- on Spark -------------------------------------------------------------------------------------

_REQUEST = "level int, r long, block long, keys binary, a binary, b binary"
_ANSWER = "level int, r long, block long, a binary, b binary, known long"


def blocks_of(docs: DataFrame, id_col: str, text_col: str, held_remainder: int, held_of: int,
              to: Settings) -> DataFrame:
    """One row per block of documents, with word numbers of its own."""
    small_batches(docs.sparkSession)
    draw = F.crc32(F.encode(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "utf-8"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
        F.when(draw % held_of == held_remainder, HELD_OUT).otherwise(
            F.floor(draw / held_of) % 2).cast("int").alias("part"))
    schema = T.StructType([T.StructField("block", T.LongType()),
                           T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))]
                          + fields("part binary, lens binary, tokens binary, hashes binary, a long, b long, "
                                   "docs_a long, docs_b long").fields)
    arrow = to_arrow_schema(schema)

    def made(number: int, ids: list, part: list, held: list[bytes]) -> pa.RecordBatch:
        words, lens = [], np.empty(len(held), np.int32)
        for i, text in enumerate(held):
            found = text.lower().split()
            found.append(END)
            lens[i] = len(found)
            words += found
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        part = np.array(part, np.uint8)
        held.clear()
        n = [int(lens[part == k].sum()) for k in (0, 1)] + [int((part == k).sum()) for k in (0, 1)]
        row = [number, ids, part.tobytes(), lens.tobytes(),
               pack(coded.indices.to_numpy().astype(np.int32)), hashes.tobytes(), *n]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, part, held, size = [], [], [], 0
        for batch in batches:
            for i, text, p in zip(batch.column(0).to_pylist(), texts(batch.column(1)),
                                  batch.column(2).to_pylist()):
                ids.append(i)
                part.append(p)
                held.append(text)
                size += len(text)
                if size >= to.block_bytes or len(ids) >= to.block_rows:
                    yield made(number, ids, part, held)
                    number, ids, part, held, size = number + 1, [], [], [], 0
                    release()
        if ids:
            yield made(number, ids, part, held)

    return rows.mapInArrow(run, schema)


def in_place(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Written below the shared folder in buckets of the key, so that joins on it leave it where it is."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", fresh_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def requests(blocks: DataFrame, ranges: int, to: Settings) -> DataFrame:
    """The distinct n-grams of each block with their counts in both training parts, by key range."""
    arrow = to_arrow_schema(fields(_REQUEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = batch.slice(at_row, 1)
                block, number = Block.of(row), row["block"][0].as_py()
                part = np.repeat(block.part, block.lens)
                for level, (keys, at) in enumerate(block.levels(to.order)):
                    counts = [np.bincount(at[part == k], minlength=len(keys)).astype(np.uint32) for k in (0, 1)]
                    r = _range_of(keys, ranges)
                    starts = np.flatnonzero(np.diff(r, prepend=np.uint64(ranges)))
                    ends = np.append(starts[1:], len(r))
                    rows = [(level, int(r[i]), number, pack_sorted(keys[i:j]),
                             pack(counts[0][i:j]), pack(counts[1][i:j])) for i, j in zip(starts, ends)]
                    for i in range(0, len(rows), 1024):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 1024]), arrow)], schema=arrow)
                del row, block, part, keys, at, counts, rows
                release()

    return blocks.select("block", "ids", "part", "lens", "tokens", "hashes").mapInArrow(run, _REQUEST)


def answers(asked: DataFrame) -> DataFrame:
    """The counts over all blocks for each requested key, in the order of the request; ``known`` is the
    number of keys of a range that occur in training, on one row of the range."""
    arrow = to_arrow_schema(fields(_ANSWER))

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["level", "r", "block"]).to_pylist()
        keys = [unpack_sorted(x.as_py()) for x in table["keys"]]
        sizes = np.array([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        new = np.empty(len(sorted_), bool)
        new[0], new[1:] = True, sorted_[1:] != sorted_[:-1]
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        del keys, sorted_, order
        sums = []
        for name in ("a", "b"):
            each = np.concatenate([unpack(x.as_py(), np.uint32) for x in table[name]])
            sums.append(np.bincount(group, weights=each).astype(np.int64))
        known = int(((sums[0] + sums[1]) > 0).sum())
        out, at = [], 0
        for i, (row, n) in enumerate(zip(rows, sizes)):
            mine = group[at:at + n]
            out.append((row["level"], row["r"], row["block"], pack(sums[0][mine]), pack(sums[1][mine]),
                        known if i == 0 else 0))
            at += n
        made = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        del out, sums, group, rows, each
        release()
        return made

    return asked.groupBy("level", "r").applyInArrow(run, _ANSWER)


def _counts(block: Block, found: pa.Table, order: int) -> list[list[np.ndarray]]:
    """Per part and order the corpus count of each token's n-gram."""
    rows = sorted(found.to_pylist(), key=lambda r: (r["level"], r["r"]))
    out: list[list[np.ndarray]] = [[], []]
    for level, (_, at) in enumerate(block.levels(order)):
        mine = [r for r in rows if r["level"] == level]
        for k, name in enumerate(("a", "b")):
            out[k].append(np.concatenate([unpack(r[name], np.int64) for r in mine])[at])
    return out


def _together(blocks: DataFrame, found: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(fn, schema)


def grid(blocks: DataFrame, found: DataFrame, n: list[int], docs: list[int], v: int, to: Settings) -> DataFrame:
    """Held-out events of both parts, summed in cells of like ratios: (bucket, cell, weight, r1, r2, ...), the
    ratios being estimates over the uniform one. Cells per bucket are bounded by the range of counts."""
    ratios = [f"r{k}" for k in range(1, to.order + 1)]
    spec = "bucket long, cell long, weight double, " + ", ".join(f"{r} double" for r in ratios)
    arrow = to_arrow_schema(fields(spec))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        block = Block.of(left)
        counts = _counts(block, right, to.order)
        part = np.repeat(block.part, block.lens)
        cells: dict[int, np.ndarray] = {}
        for own, other in ((0, 1), (1, 0)):
            bucket, p = _estimates(counts[other], _context(counts[other], block, docs[other]), n[other], v)
            mine = part == own
            if not mine.any():
                continue
            r = np.array([x[mine] / p[0][mine] for x in p[1:]])
            code = bucket[mine]
            for x in r:  # no event of an order is cell 0
                cell = np.zeros(len(x), np.int64)
                cell[x > 0] = np.floor(np.log2(x[x > 0]) * STEPS).astype(np.int64) + CELLS // 2
                code = code * CELLS + cell
            keys, at = np.unique(code, return_inverse=True)
            sums = [np.bincount(at)] + [np.bincount(at, weights=x) for x in r]
            for i, key in enumerate(keys.tolist()):
                cells[key] = cells.get(key, 0) + np.array([s[i] for s in sums], float)
        if not cells:
            return arrow.empty_table()
        columns = [[k // CELLS ** to.order for k in cells], list(cells), *np.array(list(cells.values())).T]
        release()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    events = _together(blocks, found, run, spec)
    return events.groupBy("bucket", "cell").agg(*[F.sum(c).alias(c) for c in ["weight", *ratios]])


def learn(cells: list, order: int, iterations: int) -> dict[int, list[float]]:
    """Mixture weights per bucket by expectation-maximisation over the grid; ``-1`` is for buckets that no
    held-out event fell into."""
    by_bucket: dict[int, list] = {}
    for c in cells:
        by_bucket.setdefault(c["bucket"], []).append(
            (c["weight"], 1.0, *[c[f"r{k}"] / c["weight"] for k in range(1, order + 1)]))
    out = {}
    for bucket, rows in by_bucket.items():
        rows = np.array(sorted(rows))
        weight, ratio = rows[:, 0], rows[:, 1:]
        mix = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(iterations):
            share = ratio * mix
            share /= share.sum(1, keepdims=True)
            mix = weight @ share / weight.sum()
        mix = np.maximum(mix, 1e-9)  # no event is impossible
        top = bucket // 64
        mix[2 + top:] = 0  # orders whose context is unknown say nothing
        out[bucket] = list(mix / mix.sum())
    out[-1] = [1.0 / 2, 1.0 / 2] + [0.0] * (order - 1)
    return out


def weights_of(bucket: np.ndarray, weights: dict[int, list[float]]) -> np.ndarray:
    """The weights of each bucket, or those of the nearest learned bucket of its order."""
    known = np.array(sorted(k for k in weights if k >= 0), np.int64)
    table = {}
    for b in np.unique(bucket).tolist():
        near = known[known // 64 == b // 64]
        table[b] = weights[int(near[np.abs(near - b).argmin()])] if len(near) else weights[-1]
    keys = np.array(sorted(table), np.int64)
    return np.array([table[k] for k in keys.tolist()])[np.searchsorted(keys, bucket)]


def score(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
          held_remainder: int = 2, held_of: int = 7) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Documents whose crc32(id) has the given remainder are scored but not learned from. ``base_score`` is that
    of an add-one unigram model, ``score`` that of the interpolated one, both log10 of the whole text.
    """
    to = settings
    if to.order < 1:
        raise ValueError("the order is at least 1")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).alias("b"),
                    F.count(F.lit(1)).alias("n")).first()
    buckets = min(max(math.ceil((size["b"] / to.block_bytes + size["n"] / to.block_rows) / to.bucket_blocks), 8),
                  50_000)
    blocks = in_place(blocks_of(docs, id_col, text_col, held_remainder, held_of, to), "lm_blocks", "block", buckets)
    total = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("a", "b", "docs_a", "docs_b")]).first()
    n, in_part = [total["a"], total["b"]], [total["docs_a"], total["docs_b"]]
    ranges = max(1, math.ceil((size["b"] / 6 + size["n"]) / to.task_keys))
    found = written(answers(requests(blocks, ranges, to)), "lm-answers")
    v = found.where("level = 0").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"]
    returned = found.select("level", "r", "block", "a", "b")
    weights = learn(grid(blocks, returned, n, in_part, v, to).collect(), to.order, to.iterations)
    id_field = T.StructField(id_col, blocks.schema["ids"].dataType.elementType)
    schema = T.StructType([id_field] + fields(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields)
    arrow, all_n, all_docs, order = to_arrow_schema(schema), sum(n), sum(in_part), to.order

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        block = Block.of(left)
        counts = [x + y for x, y in zip(*_counts(block, right, order))]
        bucket, p = _estimates(counts, _context(counts, block, all_docs), all_n, v)
        mix = weights_of(bucket, weights)
        each = np.log10(sum(mix[:, k] * p[k] for k in range(order + 1)))
        base = np.log10((counts[0] + 1) / (all_n + v + 1))
        summed = [np.add.reduceat(x, block.first) for x in ((counts[0] > 0).astype(np.int64), base, each)]
        del counts, bucket, p, mix, each, base
        release()
        return pa.Table.from_arrays([
            pa.array(block.ids, arrow[0].type), pa.array(block.part == HELD_OUT),
            pa.array(block.lens.astype(np.int64)), pa.array(summed[0]),
            pa.array(np.full(len(block.lens), all_n, np.int64)), pa.array(summed[1]), pa.array(summed[2])],
            schema=arrow)

    kept = blocks.select("block", "ids", "part", "lens", "tokens", "hashes")
    return _together(kept, returned, run, schema)
