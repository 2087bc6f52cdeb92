"""Prefix trie of conversations by union-find over sorted-neighbour common prefixes.

Every turn is a 128-bit digest. Sequences are cut into segments of ``SEGMENT`` turns; segments whose
sequences agree on all earlier turns form a class, and each class has a small trie of its own, so a
conversation of any length spreads over many bounded rows. Segment rows are range-partitioned and sorted;
the longest common prefix (LCP) of two neighbours is an edge. A partition takes its edges in descending
depth and joins components by union-find: where components meet, their smallest ids part into one winner
and losers, and the meeting depth is the branching node. A loser's path below that depth is its own, so
these events are the whole trie. What a partition cannot decide alone are the edges that are strict minima
seen from its borders: it contracts to the few components between them (at most two per depth), and
these are merged over groups of partitions, level by level.

Odd rows: rows without conv_id belong to no conversation and are left out; null role or text is empty; null
turns come first; turns of equal number are ordered by the digest of role and text; repeated rows are
repeated turns. An empty table has no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from encaje.llm.common import fields, ranked
from encaje.session import written

SEGMENT = 64
ROWS = 16384  # segment rows a task merges
FAN = 128  # contracted partitions a task merges
DIGEST = 32  # hexadecimal characters
IDS = 4096  # ids joined into one string before they are hashed
CLASS = ["s", "x1", "x2"]
ORDER = [*CLASS, "arr", "more"]
EMPTY = hashlib.sha256(b"").hexdigest()

_STATE = ("kind int, c long, s int, depth int, parent long, n0 long, w0 long, z0 long, n long, w long, "
          "z long, at int, ord long, pid long, edge int")
EVENT, ELEMENT, TOP = 0, 1, 2


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, digest, len) of every turn: its place from 0 in its conversation, found by bucket counts, so
    that a conversation of any size is numbered by many tasks."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256),
                    1, DIGEST).alias("digest"), F.length(text).cast("long").alias("len"))
    size = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("turn").cast("double").alias("lo"),
                             F.max("turn").cast("double").alias("hi")).first()
    low, high = size["lo"] or 0.0, size["hi"] or 0.0
    order = F.coalesce((F.col("turn").cast("double") - low) / (high - low + 1), F.lit(0.0))
    return ranked(rows, ["c"], ["turn", "digest", "len"], size["n"], "pos", order).select(
        "c", F.col("pos").cast("long").alias("pos"), "digest", "len")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Sequences that share heads, and (c, total) of all of them: the first ``crc32(c) % most`` turns come
    from conversation ``c - c % every``, the rest are the conversation's own turns after as many."""
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    convs = sizes.select(
        "c", "own", (F.crc32(F.encode(F.col("c").cast("string"), "utf-8")) % most).alias("h"),
        (F.col("c") - F.col("c") % every).alias("base"))
    bases = sizes.where(F.col("c") % every == 0).select(F.col("c").alias("base"), F.col("own").alias("has"))
    convs = written(convs.join(bases, "base", "left").select(
        "c", "own", "h", "base", F.least("h", F.coalesce("has", F.lit(0))).alias("lead")), "heads")
    heads = turns.where((F.col("c") % every == 0) & (F.col("pos") < most - 1)).select(
        F.col("c").alias("base"), "pos", "digest", "len")
    first = convs.join(heads, "base").where("pos < h").select("c", "pos", "digest", "len")
    rest = turns.join(convs.select("c", "h", "lead"), "c").where("pos >= h").select(
        "c", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "len")
    totals = convs.select("c", (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"))
    return first.unionByName(rest), totals


def _digest_pair(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns, F.lit(salt)) for salt in (1, 2)]


def _segments(turns: DataFrame, totals: DataFrame, segment: int) -> DataFrame:
    """(c, s, arr, lens, before, x1, x2): the digests of up to ``segment`` turns, their text lengths,
    the text before them, and the class, a digest of all earlier turns."""
    cut = turns.withColumn("s", F.floor(F.col("pos") / segment).cast("int")).groupBy("c", "s").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "len"))).alias("t"))
    rows = cut.select("c", "s", F.array_join("t.digest", "").alias("arr"), F.col("t.len").alias("lens"))
    bare = totals.where("total = 0").select(
        "c", F.lit(0).alias("s"), F.lit("").alias("arr"), F.array().cast("array<bigint>").alias("lens"))
    rows = rows.unionByName(bare)
    one, two = _digest_pair(F.col("s"), F.col("arr"))
    rows = rows.withColumns({"h1": one, "h2": two, "chars": F.aggregate(
        "lens", F.lit(0).cast("long"), lambda a, b: a + b)})
    earlier = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return rows.withColumns({
        "x1": F.coalesce(F.expr("bit_xor(h1)").over(earlier), zero),
        "x2": F.coalesce(F.expr("bit_xor(h2)").over(earlier), zero),
        "before": F.coalesce(F.sum("chars").over(earlier), zero)})


def _common(a: str, b: str) -> int:
    """How many turns two segments share at their start."""
    n, most = 0, min(len(a), len(b)) // DIGEST
    while n < most and a[n * DIGEST:(n + 1) * DIGEST] == b[n * DIGEST:(n + 1) * DIGEST]:
        n += 1
    return n


def _spines(edges: list[int]) -> list[int]:
    """Places of the edges that are strict minima seen from the left or from the right border."""
    open_, low = set(), None
    for i in range(len(edges)):
        if low is None or edges[i] < low:
            low = edges[i]
            open_.add(i)
    low = None
    for i in reversed(range(len(edges))):
        if low is None or edges[i] < low:
            low = edges[i]
            open_.add(i)
    return sorted(open_)


def _merge(items: list[dict], last: bool) -> Iterator[tuple]:
    """Union-find over a run of neighbouring components, deepest edges first.

    ``items`` carry c, s, own sums (below ``at``), all sums, ``at`` (depth of their last merge) and the edge
    to the next one. Yields the events; if not ``last``, the contracted run too.
    """
    edges = [x["edge"] for x in items[:-1]]
    kept = set() if last else set(_spines(edges))
    root = list(range(len(items)))
    now = list(items)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_depth: dict[int, list[int]] = {}
    for i, depth in enumerate(edges):
        if depth >= 0 and i not in kept:
            by_depth.setdefault(depth, []).append(i)
    for depth in sorted(by_depth, reverse=True):
        met = {find(i) for e in by_depth[depth] for i in (e, e + 1)}
        for e in by_depth[depth]:
            a, b = find(e), find(e + 1)
            if a != b:
                root[max(a, b)] = min(a, b)
        groups: dict[int, list[int]] = {}
        for i in met:
            groups.setdefault(find(i), []).append(i)
        for to, parts in groups.items():
            pre = {i: now[i]["own"] if now[i]["at"] == depth else now[i]["all"] for i in parts}
            win = min(parts, key=lambda i: now[i]["c"])
            for i in parts:
                if i != win:
                    yield (EVENT, now[i]["c"], now[i]["s"], depth, now[win]["c"], *pre[i], *pre[i],
                           depth, None, None, None)
            now[to] = {**now[win], "own": pre[win], "at": depth,
                       "all": tuple(map(sum, zip(*(now[i]["all"] for i in parts))))}
    tops = [i for i in range(len(items)) if root[i] == i]
    cuts = [i for i, depth in enumerate(edges) if depth < 0]
    for k, i in enumerate(tops):
        x, end = now[i], (tops[k + 1] if k + 1 < len(tops) else len(items)) - 1
        done = last or (cuts and i > cuts[0] and end < cuts[-1] + 1)
        if done and x["s"] > 0:
            pre = x["own"] if x["at"] == 0 else x["all"]
            yield (TOP, x["c"], x["s"], 0, None, *pre, *pre, 0, None, None, None)
        elif not done:
            yield (ELEMENT, x["c"], x["s"], None, None, *x["own"], *x["all"], x["at"], items[i]["ord"],
                   None, items[end]["edge"])


def _rows_of(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["ord"])


def _table(rows: list[tuple], pid: int, schema: pa.Schema) -> pa.Table:
    at = schema.names.index("pid")
    columns = list(zip(*((*r[:at], pid, *r[at + 1:]) for r in rows))) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def forest(segments: DataFrame, segment: int = SEGMENT, rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """Events (c, depth, parent, n, w, z) of segment rows (x, s, x1, x2, arr, total, n, w, z).

    ``c`` is not the smallest id at ``depth``, ``parent`` is, and below that depth ``c`` is the smallest of its
    node; the sums go over all members there. Every sequence but the smallest has one event.
    """
    same = segments.withColumn("more", F.col("total") > (F.col("s") + 1) * segment).groupBy(*ORDER).agg(
        F.min("x").alias("c"), *[F.sum(v).alias(v) for v in ("n", "w", "z")])
    same = written(same, "trie-rows")
    parts = max(1, math.ceil(same.count() / rows))
    order = written(
        same.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).select(
            "*", F.monotonically_increasing_id().alias("ord"),
            F.spark_partition_id().cast("long").alias("pid")), "trie-order")
    ends = order.groupBy("pid").agg(F.min(F.struct(*ORDER)).alias("a"), F.max(F.struct(*ORDER)).alias("z"))
    following = F.lead("a").over(Window.orderBy("pid"))  # one row per partition
    here, there = F.col("z.arr"), F.col("b.arr")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.lit(segment)), lambda i:
                             (i * DIGEST <= F.least(F.length(here), F.length(there)))
                             & (here.substr(F.lit(1), i * DIGEST) == there.substr(F.lit(1), i * DIGEST))))
    joined = ends.select("pid", "z", following.alias("b")).select("pid", F.when(
        (F.col("z.s") == F.col("b.s")) & (F.col("z.x1") == F.col("b.x1")) & (F.col("z.x2") == F.col("b.x2")),
        shared).otherwise(-1).cast("int").alias("edge"))
    levels, left = 0, parts
    alone = parts == 1
    schema = to_arrow_schema(fields(_STATE))

    def begin(table: pa.Table) -> pa.Table:
        got = _rows_of(table)
        items = []
        for i, r in enumerate(got):
            if i + 1 == len(got):
                edge = r["edge"]
            else:
                o = got[i + 1]
                edge = _common(r["arr"], o["arr"]) if all(r[k] == o[k] for k in CLASS) else -1
            sums = (r["n"], r["w"], r["z"])
            items.append({"c": r["c"], "s": r["s"], "own": sums, "all": sums, "at": segment + 1,
                          "edge": edge, "ord": r["ord"]})
        return _table(list(_merge(items, alone)), got[0]["pid"], schema)

    state = written(order.join(joined, "pid").groupBy("pid").applyInArrow(begin, _STATE), "trie-state")
    found = state.where(F.col("kind") != ELEMENT)
    while left > 1:
        left, levels = math.ceil(left / fan), levels + 1
        whole = left == 1

        def further(table: pa.Table) -> pa.Table:
            got = _rows_of(table)
            items = [{"c": r["c"], "s": r["s"], "own": (r["n0"], r["w0"], r["z0"]),
                      "all": (r["n"], r["w"], r["z"]), "at": r["at"], "edge": r["edge"], "ord": r["ord"]}
                     for r in got]
            return _table(list(_merge(items, whole)), got[0]["pid"], schema)

        state = written(state.where(F.col("kind") == ELEMENT).withColumn(
            "pid", F.floor(F.col("pid") / fan).cast("long")).groupBy("pid").applyInArrow(further, _STATE),
            "trie-state")
        found = found.unionByName(state.where(F.col("kind") != ELEMENT))
    deep = found.withColumn("depth", F.col("s") * segment + F.col("depth"))
    sums = ["n", "w", "z"]
    real = deep.where(F.col("kind") == EVENT).groupBy("c").agg(F.max_by(
        F.struct("depth", "s", "parent", *sums), F.struct("depth", "s")).alias("e")).select("c", "e.*")
    tops = deep.where(F.col("kind") == TOP).select(
        "c", "depth", (F.col("s") - 1).alias("s"), *[F.col(v).alias(f"{v}_") for v in sums])
    events = written(real.join(tops, ["c", "depth", "s"], "left").select(
        "c", "depth", "parent", *[F.coalesce(f"{v}_", v).alias(v) for v in sums]), "trie-events")
    for _ in range(math.ceil(math.log2(2 * levels + 4))):  # winners that lost at the same depth elsewhere
        up = events.select(F.col("c").alias("parent"), "depth", F.col("parent").alias("up"))
        events = events.join(up, ["parent", "depth"], "left").select(
            "c", "depth", F.coalesce("up", "parent").alias("parent"), *sums)
    return events


def _ends(members: DataFrame, group: list[str], total: int) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each group; ids reach the hashing task as bounded
    strings in order, and are never held together."""
    low, high = members.agg(F.min("c").cast("double"), F.max("c").cast("double")).first()
    order = (F.col("c").cast("double") - (low or 0.0)) / ((high or 0.0) - (low or 0.0) + 1)
    numbered = ranked(members.select(*group, "c"), group, ["c"], total, "at", order)
    strings = numbered.groupBy(*group, F.floor(F.col("at") / IDS).alias("part")).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = T.StructType([strings.schema[g] for g in group] + fields("ends_sha256 string").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            done = []
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield batch_of(done)
        if key is not None:
            yield batch_of([(*key, state.hexdigest())])

    return strings.repartition(*group).sortWithinPartitions(*group, "part").mapInArrow(run, schema)


def nodes(turns: DataFrame, totals: DataFrame, segment: int = SEGMENT, rows: int = ROWS,
          fan: int = FAN) -> DataFrame:
    """All trie nodes of sequences (c, pos, digest, len) with ``totals`` (c, total turns).

    One row per distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.
    """
    cuts = written(_segments(turns, totals, segment), "trie-segments")
    ident = cuts.groupBy("c").agg(F.expr("bit_xor(h1)").alias("f1"), F.expr("bit_xor(h2)").alias("f2"),
                                  F.sum("chars").alias("chars")).join(totals, "c")
    ident = written(ident, "trie-ids")
    group = ["total", "f1", "f2"]
    digests = _ends(ident, group, totals.count())
    seqs = written(ident.groupBy(*group).agg(
        F.min("c").alias("x"), F.count(F.lit(1)).alias("m"), F.max("chars").alias("chars")).join(
        digests, group), "trie-sequences")
    own = seqs.select(F.col("x").alias("c"), "x", "total", "m", "chars")
    segs = cuts.join(own, "c").select("x", *CLASS, "arr", "lens", "before", "total", "m")
    zero = F.lit(0).cast("long")
    first = written(forest(segs.withColumns({"n": zero, "w": zero, "z": zero}), segment, rows, fan).select(
        F.col("c").alias("x"), "depth", "parent"), "trie-parents")
    start = written(seqs.join(first, "x", "left").withColumn(
        "r", F.coalesce(F.col("depth") + 1, F.lit(0))), "trie-starts")
    kids = start.where("r <= total AND depth IS NOT NULL").groupBy("parent", "depth").agg(
        F.count(F.lit(1)).alias("n_kids"))
    at = F.greatest(F.col("r") - 1, F.lit(0))
    head = start.where("r <= total").select(
        "x", F.floor(at / segment).cast("int").alias("s"), (at % segment).alias("i"))
    lead = cuts.select(F.col("c").alias("x"), "s", "before", "lens").join(head, ["x", "s"]).select(
        "x", (F.col("before") + F.aggregate(F.slice("lens", 1, F.col("i").cast("int")), zero,
                                            lambda a, b: a + b)).alias("lead"))
    weights = start.join(lead, "x", "left").join(kids.select(
        F.col("parent").alias("x"), F.col("depth").alias("total"), "n_kids"), ["x", "total"], "left").select(
        "x", F.col("m").alias("n"),
        F.when((F.col("r") <= F.col("total")) & F.col("n_kids").isNull(), 1).otherwise(0).cast("long").alias("w"),
        ((F.col("m") - 1) * F.col("chars") + F.coalesce("lead", "chars")).alias("z"))
    weights = written(weights, "trie-weights")
    events = forest(segs.join(weights, "x"), segment, rows, fan)
    met = events.join(start.select(F.col("x").alias("c"), "r", "total"), "c").groupBy(
        F.col("parent").alias("x"), "depth").agg(
        F.sum("n").alias("n_"), F.sum("w").alias("w_"), F.sum("z").alias("z_"),
        F.sum(F.when(F.col("r") <= F.col("total"), 1).otherwise(0)).alias("k_"))
    sums = F.transform(F.sequence(F.lit(0), F.size("lens") - 1), lambda i: F.aggregate(
        F.slice("lens", F.lit(1), i), zero, lambda a, b: a + b))
    info = start.join(weights.select("x", "w"), "x").select("x", "r", "total", "m", "chars", "w", "parent")
    below = cuts.where(F.size("lens") > 0).select(
        F.col("c").alias("x"), "s", "before", F.posexplode(sums).alias("i", "part")).select(
        "x", "s", (F.col("s") * segment + F.col("i") + 1).cast("int").alias("depth"),
        (F.col("before") + F.col("part")).alias("text_before"))
    top = info.where("r = 0").select(
        "x", F.lit(0).alias("s"), F.lit(0).alias("depth"), zero.alias("text_before"))
    made = below.join(info.select("x", "r"), "x").where("depth >= r").drop("r").unionByName(top)
    made = written(made.join(met, ["x", "depth"], "left").fillna(0, ["n_", "w_", "z_", "k_"]), "trie-nodes")
    after = Window.partitionBy("x", "s").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("x").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    carried = made.groupBy("x", "s").agg(*[F.sum(f"{v}_").alias(f"{v}_") for v in "nwz"]).select(
        "x", "s", *[F.coalesce(F.sum(f"{v}_").over(later), zero).alias(f"{v}_later") for v in "nwz"])
    summed = made.withColumns({f"{v}_sum": F.sum(f"{v}_").over(after) for v in "nwz"}).join(
        carried, ["x", "s"]).join(info, "x")
    n = F.col("m") + F.col("n_sum") + F.col("n_later")
    stop = start.select(
        F.when(F.col("r") <= F.col("total"), F.col("x")).otherwise(F.col("parent")).alias("x"),
        F.col("total").cast("int").alias("depth"), "ends_sha256")
    return summed.join(stop, ["x", "depth"], "left").select(
        F.col("x").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("r"), F.col("x")).otherwise(F.col("parent")).alias("parent_conv_id"),
        n.alias("n_convs"),
        (F.col("k_") + F.when(F.col("depth") < F.col("total"), 1).otherwise(0)).cast("long").alias("n_children"),
        (F.col("w") + F.col("w_sum") + F.col("w_later")).alias("n_leaves"),
        (F.col("z_sum") + F.col("z_later") + (F.col("m") - 1) * F.col("chars")
         - (n - 1) * F.col("text_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_nodes(conversations: DataFrame, rebuild: bool = True, segment: int = SEGMENT, rows: int = ROWS,
                 fan: int = FAN) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text), of rebuilt conversations or as they stand."""
    turns = written(placed_turns(conversations), "trie-turns")
    if rebuild:
        made, totals = rebuilt(turns)
        made = written(made, "trie-rebuilt")
    else:
        made, totals = turns, turns.groupBy("c").agg(F.count(F.lit(1)).alias("total"))
    return nodes(made, totals, segment, rows, fan)
