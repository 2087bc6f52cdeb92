"""Near duplicates by circulant MinHash, banding and exact verification.

A text is the set of its 5-word shingles, as 64-bit hashes. One permutation spreads the shingles over a
circle, a second one, shifted by k places, ranks them for coordinate k: two permutations give all
120 coordinates. Five coordinates make a band; 24 bands miss a pair of similarity 0.85 with
probability 8e-7. Texts with equal sets are one class from the start. Classes that share a band meet
for verification on their full sets:

1. Each class goes to the least class it shares a band with. A group walks breadth-first over its
   members, comparing each only with those not reached yet, so a group of copies costs few
   comparisons. Large groups are split over tasks; the least class goes along to each.
2. What bands still hold together but links do not, is compared completely: in each such band all
   members outside its largest component meet all members, block by block.

The components of the confirmed links then give the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaje.llm.common import SALTS, by_batch, fields, mix64, spread_join, texts
from encaje.llm.components import components
from encaje.session import written

SHINGLE = 5
BANDS, ROWS = 24, 5
PERCENT = 85
GROUP = 512  # classes that one task compares at once
BLOCK = 256
BROADCAST_ROWS = 1_000_000  # ids that may be broadcast after counting
HOT = 1024  # classes in a band from which its rows are dealt into parts
CACHE_WORDS = 150_000
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(8)
_FACTORS = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.permutation(1 << 16)[:BANDS * ROWS].astype(np.uint32) * np.uint32(40503)
_WORDS: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, by a cache of the worker."""
    new = set(words).difference(_WORDS)
    if new:
        if len(_WORDS) > CACHE_WORDS:
            _WORDS.clear()
            new = set(words)
        _WORDS.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one, none if it has no word."""
    words = data.translate(FOLD).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(words)
    k = min(size, len(w))
    total = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += w[i:len(w) - k + 1 + i] * _FACTORS[i]
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The coordinates of each set, none of them empty, a row each."""
    out = np.empty((len(sets), BANDS * ROWS), dtype=np.uint32)
    at = 0
    while at < len(sets):
        upto, size = at, 0
        while upto < len(sets) and (size == 0 or size + len(sets[upto]) <= 50_000):
            size += len(sets[upto])
            upto += 1
        part = sets[at:upto]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
        circle = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)  # first permutation
        y, t = np.empty_like(circle), np.empty_like(circle)
        for k in range(BANDS * ROWS):
            np.add(circle, _SHIFTS[k], out=y)  # the second one, shifted
            np.right_shift(y, 16, out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            np.right_shift(y, 13, out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0xC2B2AE35), out=y)
            out[at:upto, k] = np.minimum.reduceat(y, starts)
        at = upto
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    c = coordinates.reshape(len(coordinates), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = np.broadcast_to(key, (len(coordinates), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * _FACTORS[8] + c[:, :, r])
    return key.view(np.int64)


def describe(text: pa.Array) -> list[list]:
    """n_shingles, two 64-bit hashes of the set, band keys; keys are null without shingles."""
    out: list[list] = [[], [], [], []]
    data = texts(text)
    sets = [shingles(d) for d in data]
    full = [i for i, s in enumerate(sets) if len(s)]
    keys = band_keys(signatures([sets[i] for i in full])) if full else np.zeros((0, BANDS))
    bands: list = [None] * len(sets)
    for i, k in zip(full, keys.tolist(), strict=True):
        bands[i] = k
    for s in sets:
        for o, x in zip(out, (len(s), *hashes(s))):
            o.append(x)
    out[3] = bands
    return out


def hashes(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(found.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that share so many shingles are linked."""
    return 100 * shared >= percent * (a + b - shared)


class Sets:
    """Sets of a group as one array of shingle numbers."""

    def __init__(self, column: list[bytes]) -> None:
        parts = [np.frombuffer(x, dtype=np.uint64) for x in column]
        self.size = np.array([len(p) for p in parts])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        _, self.codes = np.unique(np.concatenate(parts), return_inverse=True)
        self.mask = np.zeros(int(self.codes.max()) + 1, dtype=bool)

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """Shingles that set ``one`` shares with each of the others, in order of position."""
        own = self.codes[self.start[one]:self.start[one + 1]]
        self.mask[own] = True
        size = self.size[others]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.repeat(self.start[others] - first, size) + np.arange(size.sum())
        out = np.add.reduceat(self.mask[self.codes[at]].astype(np.int64), first)
        self.mask[own] = False
        return out

    def similar(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of the others that are linked to ``one``; unlike sizes are not compared."""
        size, own = self.size[others], self.size[one]
        others = others[(100 * np.minimum(size, own) >= percent * np.maximum(size, own))]
        if not len(others):
            return others
        return others[linked(self.size[one], self.size[others], self.shared(one, others),
                             percent)]


def walk(ids: list, sets: Sets, percent: int) -> Iterator[tuple]:
    """Links that hold the components of a group together, found breadth-first."""
    left = np.arange(len(ids))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = sets.similar(one, left, percent)
            if len(near):
                left = np.setdiff1d(left, near, assume_unique=True)
                queue += near.tolist()
                for x in near.tolist():
                    yield ids[one], ids[x]


def sets_of(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """id and set, as bytes, of the wanted classes (id, doc_id, h1, h2), each from the text of one of its
    documents; another text under the same doc_id has other hashes and is left out."""
    if rows <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted.select("doc_id", "id", "h1", "h2"), "doc_id")

    def run(text: pa.Array) -> list[list]:
        out: list[list] = [[], [], [], []]
        for s in map(shingles, texts(text)):
            for o, x in zip(out, (s.tobytes(), len(s), *hashes(s)), strict=True):
                o.append(x)
        return out

    made = by_batch(found, ["text"], fields("set binary, n long, s1 long, s2 long"), run,
                    keep=["id", "h1", "h2"])
    return made.where("h1 = s1 AND h2 = s2").select("id", "set", "n").dropDuplicates(["id"])


def _walk_groups(pairs: DataFrame, percent: int) -> DataFrame:
    """Links of groups (lead, part) with id and set."""
    kind = pairs.schema["id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame(list(walk(rows["id"].tolist(), Sets(rows["set"].tolist()), percent)),
                            columns=["a", "b"])

    return pairs.groupBy("lead", "part").applyInPandas(run, f"a {kind}, b {kind}")


def _rest_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a band: each member outside the band's largest
    component against all members, in blocks.

    ``members``: key, id, component.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    bands = sizes.groupBy("key").agg(
        F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("most"))
    rows = spread_join(members, bands, ["key"], "id").join(sets, "id").select(
        "key", "id", "component", "set",
        (F.col("component") != F.col("most.component")).alias("outside"),
        F.ceil(F.col("all") / GROUP).cast("long").alias("blocks"),
        F.ceil((F.col("all") - F.col("most.c")) / BLOCK).cast("long").alias("strips"))
    every = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1))
                        .alias("strip"), F.lit(False).alias("asks"),
                        F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    asking = rows.where("outside").select(
        "*", F.pmod(F.xxhash64("id", F.lit(1)), F.col("strips")).alias("strip"),
        F.lit(True).alias("asks"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    kind = members.schema["id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, sets_ = set(), Sets(rows["set"].tolist())
        ids, comp = rows["id"].to_numpy(), rows["component"].to_numpy()
        asks = rows["asks"].to_numpy(dtype=bool)
        targets = np.flatnonzero(~asks)
        for one in np.flatnonzero(asks).tolist():
            others = targets[comp[targets] != comp[one]]
            for x in sets_.similar(one, others, percent).tolist():
                out.add((ids[one], ids[x]))
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    return every.unionByName(asking).groupBy("key", "strip", "block").applyInPandas(
        run, f"a {kind}, b {kind}")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members with their component so far; an id without links is its own."""
    return members.drop("component").join(found, "id", "left").select(
        *[c for c in members.columns if c != "component"],
        F.coalesce("component", "id").alias("component"))


def classes(described: DataFrame) -> DataFrame:
    """Texts with equal sets (id, h1, h2, doc_id, bands). ``doc_id`` is the least of the class and its id; if
    texts of one document make several classes, all but the first have a hash as id."""
    found = described.where(F.col("bands").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    first = found.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("_first"))
    kind = described.schema["doc_id"].dataType
    other = F.xxhash64("h1", "h2").try_cast(kind)
    return found.join(first, "doc_id").select(
        F.when(F.struct("h1", "h2") == F.col("_first"), F.col("doc_id")).otherwise(
            F.coalesce(other, F.col("doc_id"))).alias("id"), "h1", "h2", "doc_id", "bands")


def bands_of(reps: DataFrame) -> DataFrame:
    """key, id and lead of all classes that share a band; bands with the same members count once.

    The rows of a hot band are dealt into parts. Hot are bands with over a ten-thousandth of all classes,
    so there are 240,000 at most, 2 MB to broadcast, whatever the size of the table.
    """
    each = reps.select("id", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min("id").alias("lead"), F.max("id").alias("last"),
        F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")).where("c > 1")
    once = written(shared.groupBy("c", "lead", "last", "x", "y").agg(F.min("key").alias("key"))
                   .select("key", "lead", "c"), "shared-bands")
    hot = F.col("c") > max(HOT, reps.count() // 10_000)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = each.join(F.broadcast(once.where(hot).select("key", F.lit(True).alias("hot"))), "key", "left")
    sides = once.select("key", "lead", F.explode(
        F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return dealt.select("key", "id", salt.alias("salt")).join(sides, ["key", "salt"]).select(
        "key", "id", "lead")


def links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component) of all classes that are linked with another."""
    members = written(bands_of(reps), "bands")
    lead = members.groupBy("id").agg(F.min("lead").alias("lead"))
    lead = written(lead.withColumn("lead", F.least("lead", "id")), "leads")
    rows = lead.count()
    sets = written(sets_of(docs, reps.join(lead.select("id"), "id", "left_semi"), rows), "sets")
    parts = lead.groupBy("lead").agg(
        F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("parts"))
    placed = spread_join(lead, parts, ["lead"], "id").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")))
    first = parts.select(
        "lead", F.col("lead").alias("id"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    together = placed.select("lead", "id", "part").unionByName(first).distinct().join(
        sets.select("id", "set"), "id")
    found = written(_walk_groups(together, percent), "links-1")
    now = written(components(found), "components-1")
    # bands with several components whose members did not all meet in one group
    open_ = _labelled(members.join(placed.select("id", F.col("lead").alias("l"), "part"), "id")
                      .select("key", "id", "l", "part"), now)
    unsettled = open_.groupBy("key").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"),
        F.min(F.struct("l", "part")).alias("g0"), F.max(F.struct("l", "part")).alias("g1"),
    ).where("c0 <> c1 AND g0 <> g1").select("key")
    rest = written(spread_join(open_, unsettled.withColumn("open", F.lit(True)), ["key"], "id").where("open")
                   .select("key", "id", "component"), "unsettled")
    more = written(_rest_pairs(rest, sets.select("id", "set"), percent), "links-2")
    if more.isEmpty():
        return now
    return components(found.unionByName(more))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Null, empty and blank texts are linked with nothing. Rows with equal ids are one document.
    A null id is linked with nothing, has no component and is kept.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    described = written(by_batch(
        docs, ["text"], fields("n_shingles long, h1 long, h2 long, bands array<long>"), describe,
        keep=["doc_id"]), "signatures")
    reps = written(classes(described), "classes")
    found = links(docs, reps, percent)
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = described.select("doc_id", "n_shingles", F.when(known, F.col("h1")).alias("h1"),
                            F.when(known, F.col("h2")).alias("h2"))
    placed = _labelled(reps.select("h1", "h2", "id", "doc_id"), found)
    # texts of one document tie their classes together
    several = rows.where("h1 IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where(
        "lo <> hi").select("doc_id")
    if several.isEmpty():  # then a class id is its least document, and a component the least of those
        final = placed.select("h1", "h2", F.col("component").alias("component_id"))
    else:
        own = written(spread_join(
            rows.join(several, "doc_id", "left_semi").where("h1 IS NOT NULL"),
            reps.select("h1", "h2", "id"), ["h1", "h2"], "doc_id").select("doc_id", "id").distinct(), "tied")
        tied = own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select(
            "a", F.col("id").alias("b"))
        found = written(components(found.select(F.col("id").alias("a"), F.col("component").alias("b"))
                                   .unionByName(tied)), "components-2")
        placed = _labelled(placed, found)
        least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        final = spread_join(placed, least, ["component"], "id").select("h1", "h2", "component_id")
    return spread_join(rows, final, ["h1", "h2"], "doc_id").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True))
        .alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with their columns, one of each component; of rows with one id that stays whose
    columns have the least hash. Texts are shuffled only if an id is repeated."""
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return left
    repeated = left.join(again.select("doc_id"), "doc_id", "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = repeated.groupBy(F.col("doc_id").alias("_id")).agg(
        F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")
    return left.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(one)
