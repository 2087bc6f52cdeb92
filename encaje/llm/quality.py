"""Quality rules: an isolation forest on rule statistics, its threshold set by labelled rows.

A row's statistics are ratios, so long and short documents are judged alike. Random splits part rare
rows early: a short mean path is a high anomaly score. Labelled rows steer it twice: splits prefer the
ratios that part good rows from bad ones, and the threshold is the score with the best balance of bad
rows caught against good rows lost.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encaje.llm.common import by_batch, fields, fresh, texts
from encaje.session import written

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
POINTS = b".,;:!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_digits", "n_points"]
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
SCORE_PLACES = 1 << 20  # of scores from 0 to 1 that are told apart when labelled rows are counted


@dataclass(frozen=True)
class Settings:
    """All labelled rows calibrate the forest. ``good_loss`` sets the limit where no labelled bad row passes the
    base rules."""

    trees: int = 100
    rows_per_tree: int = 256
    good_loss: float = 0.002
    least_weight: float = 0.05
    seed: int = 5
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, inside, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside += i + 3 - max(i, upto)
            upto = i + 3
    return inside


def without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def statistics(text: pa.Array) -> list[list[int]]:
    """The rule statistics of a batch, a list per name in ``COUNTS``; null text has none."""
    rows = []
    for data in texts(text):
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        rows.append((
            len(words), len(data.decode()) - without(data, SPACE), without(data, SYMBOLS),
            len(lines) - len(set(lines)), repeated(words), len(lines), without(data, UPPER),
            without(data, DIGITS), without(data, POINTS)))
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in COUNTS]


def base_failed(settings: Settings = Settings()) -> Column:
    return ((F.col("n_words") < settings.min_words)
            | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words")))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the statistics; a text without words has zeros."""
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.column_stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_points"] / words])


def mean_depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


def balance(counted: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All places in order, and for each the share of good rows up to it less that of bad rows."""
    counted = counted.sort_values("place")
    good, bad = (np.cumsum(counted[c].to_numpy(np.int64)) for c in ("good", "bad"))
    return counted["place"].to_numpy(np.int64), good / max(good[-1:].sum(), 1) - bad / max(bad[-1:].sum(), 1)


def weights(counted: pd.DataFrame, settings: Settings) -> np.ndarray | None:
    """How often to split by each feature: the square of how well it parts the labels alone."""
    if not counted["good"].any() or not counted["bad"].any():
        return None
    parts = [np.abs(balance(rows)[1]).max() for _, rows in counted.groupby("feature")]
    return np.maximum(parts, settings.least_weight) ** 2


def limit_of(counted: pd.DataFrame, settings: Settings) -> float:
    """The score above which rows go, by the counted scores of labelled rows."""
    if not counted["good"].any():
        return float("inf")
    at, gain = balance(counted)
    if counted["bad"].any():
        best = len(gain) - 1 - int(gain[::-1].argmax())  # of equal ones that which keeps most
        if gain[best] > 0:
            return float(at[best] + 1 + at[best + 1]) / 2 / SCORE_PLACES
    kept = np.cumsum(counted.sort_values("place")["good"].to_numpy(np.int64))
    last = int(np.ceil((1 - settings.good_loss) * (kept[-1] - 1)))
    return float(at[np.searchsorted(kept, last, side="right")] + 1) / SCORE_PLACES


def places(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of values from 0 up: exponent and the first 12 binary digits."""
    return np.ascontiguousarray(values, float).view(np.int64) >> 40


def count_labels(placed: DataFrame, *by: str) -> pd.DataFrame:
    """Good and bad rows of every place. Places are bounded in number, whatever the rows."""
    return placed.groupBy(*by, "place").agg(
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("quality") == 0).alias("bad")).toPandas()


class Forest:
    """Isolation trees as flat arrays; features are split by in proportion to ``weight``."""

    def __init__(self, samples: list[np.ndarray], settings: Settings,
                 weight: np.ndarray | None = None) -> None:
        """``samples`` has the rows of each tree."""
        samples = [r for r in samples if len(r)]
        width = samples[0].shape[1] if samples else 0
        self.weight = np.ones(width) if weight is None else weight
        rng = np.random.default_rng(settings.seed)
        size = max((len(r) for r in samples), default=0)
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (self.depth + 1)
        trees = max(1, len(samples))
        self.feature = np.full((trees, nodes), -1, dtype=np.int16)
        self.cut = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        self.norm = max(float(mean_depth(np.array(size))), 1e-9)
        for t, rows in enumerate(samples):
            self._grow(t, 1, 0, rows, rng)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray,
              rng: np.random.Generator) -> None:
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(open_):
            self.length[t, node] = depth + float(mean_depth(np.array(len(rows))))
            return
        share = self.weight[open_]
        f = int(rng.choice(open_, p=share / share.sum()))
        cut = rng.uniform(low[f], high[f])
        left = rows[:, f] < cut
        if left.all() or not left.any():
            left = rows[:, f] <= low[f]
            cut = np.nextafter(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        self._grow(t, 2 * node, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 1, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1."""
        total, at_rows = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.ones(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                right = rows[at_rows, np.maximum(f, 0)] >= self.cut[t, node]
                node = np.where(f < 0, node, 2 * node + right)
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


@dataclass
class Model:
    forest: Forest
    limit: float

    def anomaly(self, *columns: pa.Array) -> np.ndarray:
        return self.forest.score(features(
            {k: c.to_numpy(zero_copy_only=False) for k, c in zip(COUNTS, columns, strict=True)}))


def tree_rows(passing: DataFrame, settings: Settings) -> list[np.ndarray]:
    """The rows of each tree, drawn without replacement from all passing rows by a seeded hash of the tree and
    the row: whatever the size of the table, every row can be drawn for every tree.

    A row's hash decides alone whether it can be among a tree's first ``rows_per_tree``: the share that
    is let through leaves twice as many on average and is cut after, so few rows are shuffled.
    """
    n = passing.count()
    share = min(1.0, 2.0 * settings.rows_per_tree / max(n, 1))
    draw = F.pmod(F.xxhash64(F.col("tree"), *COUNTS, "doc_id", F.lit(settings.seed)), F.lit(1 << 52))
    trees = F.array_compact(F.transform(
        F.sequence(F.lit(0), F.lit(settings.trees - 1)),
        lambda t: F.when(F.pmod(F.xxhash64(t, *COUNTS, "doc_id", F.lit(settings.seed)), F.lit(1 << 52))
                         < F.lit(int(share * (1 << 52))), t)))
    drawn = passing.withColumn("tree", F.explode(trees)).withColumn("draw", draw)
    cut = Window.partitionBy("tree").orderBy("draw", "doc_id", *COUNTS)
    rows = drawn.withColumn("n", F.row_number().over(cut)).where(
        F.col("n") <= settings.rows_per_tree).select("tree", "n", *COUNTS).toPandas()
    rows = rows.sort_values(["tree", "n"])
    return [features(g) for _, g in rows.groupby("tree")]


def fit(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit trees on rows drawn from all that pass the base rules; all labelled rows set weights and limit.

    ``stats`` has doc_id and the statistics, ``labels`` doc_id and quality (1 good, 0 bad). Without
    labelled good rows nothing is rejected by the forest.
    """
    passing = stats.where(~base_failed(settings))
    labelled = written(labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
                       .join(passing, "doc_id").select("quality", *COUNTS), "quality-labelled")

    def table(columns: tuple[pa.Array, ...]) -> np.ndarray:
        return features({k: c.to_numpy(zero_copy_only=False) for k, c in zip(COUNTS, columns, strict=True)})

    placed = by_batch(labelled, COUNTS, fields("at array<bigint>"),
                      lambda *c: [places(table(c)).tolist()], keep=["quality"])
    weight = weights(count_labels(placed.select(
        "quality", F.posexplode("at").alias("feature", "place")), "feature"), settings)
    forest = Forest(tree_rows(passing, settings), settings, weight)
    scored = by_batch(labelled, COUNTS, fields("place bigint"), lambda *c: [
        np.floor(forest.score(table(c)) * SCORE_PLACES).astype(np.int64).tolist()], keep=["quality"])
    return Model(forest, limit_of(count_labels(scored), settings))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every document, in one pass over the texts."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return by_batch(docs, ["text"], fields(SCHEMA), statistics, keep=["doc_id"])


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Statistics, base_failed, anomaly and kept of every document."""
    stats = written(describe(docs), "quality")
    model = fit(stats, labels, settings)
    scored = by_batch(stats, COUNTS, fields("anomaly double"),
                      lambda *c: [model.anomaly(*c)], keep=["doc_id", *COUNTS])
    return (scored.withColumn("base_failed", base_failed(settings))
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= model.limit)))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that pass, with their columns; the order of rows is free."""
    model = fit(written(describe(docs), "quality"), labels, settings)
    flag = fresh(docs, "_kept")

    def verdict(text: pa.Array) -> list:
        columns = [pa.array(c, pa.int64()) for c in statistics(text)]
        words, again = (columns[i].to_numpy() for i in (0, 4))
        failed = (words < settings.min_words) | (
            100 * again > settings.max_repeat_percent * words)
        return [pa.array(~failed & (model.anomaly(*columns) <= model.limit), pa.bool_())]

    return (by_batch(docs, ["text"], fields(f"`{flag}` boolean"), verdict, keep=docs.columns)
            .where(F.col(flag)).drop(flag))
