"""Vector codes by product quantisation, trained with metric trees of anchors over every part.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. Vectors
are gathered into blocks. For each block and part an anchors hierarchy is built once: anchors take the points
nearest to them, a new anchor is the point farthest from the widest one, anchors are merged middle-out into
a binary tree of balls, and large anchors are parted again by anchors of their own. A ball caches the sum and
the count of its points. An assignment walks all balls of a level at once: a ball inherits the candidate
entries of its parent and drops those that are farther than another one for every point of the ball; a ball
with one candidate left is wholly owned and adds its cached sum. Only points of undecided leaves are
measured one by one. Distances that decide anything are exact integers, so the result does not depend on
blocks or on the cluster.

Rows whose vector is null or holds null or non-finite components are left out. The number of components is
that of the row with the smallest id (null ids are last). Rows of another length, and rows with a component of
65,536 or more in size, keep their place with null code and error; so do all rows if the length is no positive
multiple of the parts. Repeated ids are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from encaje.llm.common import fields
from encaje.session import written

SCALE = 256
LARGEST = 1 << 24
BLOCK = 4096
LEAF = 32


@dataclass(frozen=True)
class Settings:
    """Shape of the codes, and how many passes train the codebooks."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    block: int = BLOCK
    leaf: int = LEAF


# --- anchors hierarchy ------------------------------------------------------------------------

def anchors(points: np.ndarray, many: int) -> list[np.ndarray]:
    """Part points among up to ``many`` anchors; each gets the points that are nearer to it than to others."""
    pivots = [0]
    owner = np.zeros(len(points), np.int64)
    far = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(pivots) < many:
        new = int(far.argmax())
        if far[new] == 0:
            break
        between = np.sqrt(((points[pivots] - points[new]) ** 2).sum(1))
        near = np.flatnonzero(far > between[owner] / 2 - 1e-9)  # others stay with their anchor
        to_new = np.sqrt(((points[near] - points[new]) ** 2).sum(1))
        won = to_new < far[near]
        owner[near[won]], far[near[won]] = len(pivots), to_new[won]
        pivots.append(new)
    return [g for g in (np.flatnonzero(owner == k) for k in range(len(pivots))) if len(g)]


class Tree:
    """Balls of one part of one block; node 0 is the root, children come after their parents."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points, self.leaf = points.astype(np.float64), leaf
        self.balls: list[tuple] = []  # members, left, right, sum, radius
        root = self._grow(np.arange(len(points)))
        at, order, flat = {}, [], []
        stack = [root]
        while stack:
            ball = stack.pop()
            at[ball] = len(flat)
            flat.append(ball)
            members, left, right = self.balls[ball][:3]
            if left >= 0:
                stack += [right, left]
            else:
                order.append(members)
        self.order = np.concatenate(order).astype(np.int32)
        size = {b: len(self.balls[b][0]) for b in flat if self.balls[b][1] < 0}
        count = np.zeros(len(flat), np.int64)
        for ball in reversed(flat):
            _, left, right = self.balls[ball][:3]
            count[at[ball]] = size[ball] if left < 0 else count[at[left]] + count[at[right]]
        start = np.zeros(len(flat), np.int64)
        for ball in flat:
            _, left, right = self.balls[ball][:3]
            if left >= 0:
                start[at[left]] = start[at[ball]]
                start[at[right]] = start[at[ball]] + count[at[left]]
        child = np.array([[at.get(self.balls[b][1], -1), at.get(self.balls[b][2], -1)] for b in flat])
        self.nodes = np.column_stack([start, count, child]).astype(np.int64)
        self.sums = np.array([self.balls[b][3] for b in flat], np.float64)
        self.radius = np.array([self.balls[b][4] for b in flat], np.float64)

    def _ball(self, members, left, right, total, radius) -> int:
        self.balls.append((members, left, right, total, radius * (1 + 1e-9) + 1e-9))
        return len(self.balls) - 1

    def _grow(self, members: np.ndarray) -> int:
        points = self.points[members]
        total = points.sum(0)
        radius = float(np.sqrt(((points - total / len(members)) ** 2).sum(1)).max()) if len(members) else 0.0
        if len(members) <= self.leaf or radius == 0:
            return self._ball(members, -1, -1, total, radius)
        groups = anchors(points, max(2, math.isqrt(len(members))))
        if len(groups) == 1:
            return self._ball(members, -1, -1, total, radius)
        return self._merge([self._grow(members[g]) for g in groups], [len(g) for g in groups])

    def _merge(self, balls: list[int], sizes: list[int]) -> int:
        """Join the two balls whose common ball is smallest, until one is left."""
        total = np.array([self.balls[b][3] for b in balls])
        radius = np.array([self.balls[b][4] for b in balls])
        size, ids = np.array(sizes, np.float64), np.array(balls)
        centre = total / size[:, None]
        apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
        cost = np.maximum((apart + radius[:, None] + radius[None]) / 2,
                          np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(balls) - 1):
            i, j = divmod(int(cost.argmin()), len(cost))
            both, n = total[i] + total[j], size[i] + size[j]
            mid = both / n
            reach = max(np.sqrt(((mid - centre[k]) ** 2).sum()) + radius[k] for k in (i, j))
            ids[i] = self._ball(np.empty(0, np.int64), int(ids[i]), int(ids[j]), both, reach)
            total[i], size[i], centre[i], radius[i] = both, n, mid, self.balls[ids[i]][4]
            cost[j], cost[:, j] = np.inf, np.inf
            live = np.isfinite(cost[i])
            live[j] = False
            row = np.sqrt(((centre - mid) ** 2).sum(1))
            cost[i] = np.where(live, np.maximum((row + radius + radius[i]) / 2, np.maximum(radius, radius[i])),
                               np.inf)
            cost[:, i] = cost[i]
        return int(ids[i]) if len(balls) > 1 else balls[0]


def assign(order: np.ndarray, nodes: np.ndarray, sums: np.ndarray, radius: np.ndarray, points: np.ndarray,
           entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of every point, sum per entry, points per entry): the nearest entry, ties to the lower one."""
    code = np.zeros(len(points), np.int64)
    total = np.zeros(entries.shape, np.float64)
    count = np.zeros(len(entries), np.int64)
    real = entries.astype(np.float64)
    level, left_over = np.array([0]), []
    options = np.ones((1, len(entries)), bool)
    while len(level):
        n = nodes[level, 1]
        centre = sums[level] / n[:, None]
        far = np.sqrt(((centre[:, None] - real[None]) ** 2).sum(2))
        far[~options] = np.inf
        r = radius[level][:, None]
        best = far.min(1, keepdims=True)
        options &= ~(far - r > best + r + 1e-6 * (1 + best + r))
        owned = options.sum(1) == 1
        entry = options.argmax(1)
        np.add.at(total, entry[owned], sums[level[owned]])
        np.add.at(count, entry[owned], n[owned])
        for ball, e in zip(level[owned], entry[owned]):
            start, size = nodes[ball, :2]
            code[order[start:start + size]] = e
        leaf = (nodes[level, 2] < 0) & ~owned
        left_over += list(zip(level[leaf], options[leaf]))
        more = ~owned & ~leaf
        level = nodes[level[more], 2:].ravel()
        options = np.repeat(options[more], 2, axis=0)
    if left_over:
        members = np.concatenate([order[nodes[b, 0]:nodes[b, 0] + nodes[b, 1]] for b, _ in left_over])
        allowed = np.repeat(np.array([o for _, o in left_over]),
                            [nodes[b, 1] for b, _ in left_over], axis=0)
        part = points[members]
        far = np.zeros((len(part), len(entries)), np.int64)
        for k in range(points.shape[1]):
            far += (part[:, k, None] - entries[None, :, k]) ** 2
        far[~allowed] = np.iinfo(np.int64).max
        code[members] = far.argmin(1)
        np.add.at(total, code[members], part)
        np.add.at(count, code[members], 1)
    return code, total, count


# --- on Spark -------------------------------------------------------------------------------------

def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, q): rows with finite vectors, their components as integers."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(vector.isNotNull() & finite).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("q"))


def _codable(dim: int) -> Column:
    return (F.size("q") == dim) & F.forall("q", lambda x: F.abs(x) < LARGEST)


def _blocks(rows: DataFrame, dim: int, to: Settings) -> DataFrame:
    """One row per block: ids, labels, integers and the trees of all parts."""
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("labels", T.ArrayType(label_type)),
                           T.StructField("data", T.BinaryType())])
    arrow, width = to_arrow_schema(schema), dim // to.parts

    def made(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        q = table["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        arrays = {"q": q.astype(np.int32)}
        for p in range(to.parts):
            tree = Tree(q[:, p * width:(p + 1) * width], to.leaf)
            arrays |= {f"o{p}": tree.order, f"n{p}": tree.nodes, f"s{p}": tree.sums, f"r{p}": tree.radius}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return pa.RecordBatch.from_arrays(
            [pa.array([table["id"].to_pylist()], arrow[0].type),
             pa.array([table["label"].to_pylist()], arrow[1].type),
             pa.array([out.getvalue()], arrow[2].type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, to.block - n)
                at, n = at + part.num_rows, n + part.num_rows
                held.append(part)
                if n == to.block:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    return rows.mapInArrow(run, schema)


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as file:
        return {k: file[k] for k in file.files}


def _assigned(arrays: dict[str, np.ndarray], books: list[np.ndarray], p: int):
    width = books[p].shape[1]
    points = arrays["q"][:, p * width:(p + 1) * width].astype(np.int64)
    return points, assign(arrays[f"o{p}"], arrays[f"n{p}"], arrays[f"s{p}"], arrays[f"r{p}"], points, books[p])


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry moves to the floored mean of the parts nearest to it; at most one row per number of
    the codebooks reaches the driver."""
    arrow = to_arrow_schema(fields("part int, entry int, place int, total decimal(38,0), n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                arrays, rows = _load(data.as_py()), []
                for p in range(len(books)):
                    _, (_, total, count) = _assigned(arrays, books, p)
                    rows += [(p, int(e), k, int(total[e, k]), int(count[e]))
                             for e in np.flatnonzero(count) for k in range(total.shape[1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([r[2] for r in rows], pa.int32()),
                     pa.array([r[3] for r in rows], pa.int64()).cast(pa.decimal128(38, 0)),
                     pa.array([r[4] for r in rows], pa.int64())], schema=arrow)

    sums = blocks.select("data").mapInArrow(
        run, "part int, entry int, place int, total decimal(38,0), n long")
    moved = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry", "place").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return moved


def _coded(blocks: DataFrame, books: list[np.ndarray], id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type)]
                          + fields("code string, error long").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, data in zip(*batch.columns):
                arrays = _load(data.as_py())
                codes = np.empty((len(arrays["q"]), len(books)), np.uint8)
                error = np.zeros(len(codes), np.int64)
                for p, book in enumerate(books):
                    points, (code, _, _) = _assigned(arrays, books, p)
                    codes[:, p] = code
                    error += ((points - book[code]) ** 2).sum(1)
                text, wide = codes.tobytes().hex(), 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.as_py(), arrow[0].type), pa.array(labels.as_py(), arrow[1].type),
                     pa.array([text[i * wide:(i + 1) * wide] for i in range(len(codes))]), pa.array(error)],
                    schema=arrow)

    return blocks.mapInArrow(run, schema)


def compress(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of every finite vector, and the codebooks, one array per part."""
    if not 0 < settings.entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    rows = quantised(vectors, id_col, vector_col, label_col)
    first = rows.select("id", F.size("q").alias("n"), F.xxhash64("q").alias("h")).orderBy(
        F.col("id").asc_nulls_last(), "n", "h").first()
    dim = first["n"] if first else 0
    empty = np.zeros((0, 0), np.int64)
    unable = F.lit(None)
    if dim <= 0 or dim % settings.parts:
        return rows.select("id", "label", unable.cast("string").alias("code"),
                           unable.cast("long").alias("error")), [empty] * settings.parts
    good = rows.where(_codable(dim))
    seeds = good.orderBy(F.col("id").asc_nulls_last(), "q").limit(settings.entries).collect()
    start = np.array([r["q"] for r in seeds], np.int64).reshape(-1, dim)
    books = list(np.split(start, settings.parts, axis=1))
    bad = rows.where(~_codable(dim)).select("id", "label", unable.cast("string").alias("code"),
                                            unable.cast("long").alias("error"))
    if not len(start):
        return bad, [empty] * settings.parts
    blocks = written(_blocks(good, dim, settings), "vector-blocks")
    for _ in range(settings.rounds):
        books = _round(blocks, books)
    types = (rows.schema["id"].dataType, rows.schema["label"].dataType)
    return _coded(blocks, books, *types).unionByName(bad), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the error summed over their label; a label with very many rows is summed in
    parts first and meets its rows in a join that can be split."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_l")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l")
