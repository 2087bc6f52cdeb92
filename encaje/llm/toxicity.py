"""Toxicity as ordinal regression: cumulative links with shared weights over sparse words.

``P(severity > k) = sigmoid(w.x - t_k)``: one weight per word for all thresholds, and thresholds that
rise. The words are those whose presence differs most between labelled toxic and clean rows. Grades of
labelled rows are 0 for clean; toxic rows are parted at the median share of telling words into
1 and 2. A row's result is its expected severity, from 0 to 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaje.llm.common import bounded_sample, by_batch, fields, texts, to_rows
from encaje.session import written

_TABLE = bytearray(range(256))
for _i in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
    _TABLE[_i] = 0x20
for _i in range(26):
    _TABLE[0x41 + _i] = 0x61 + _i
FOLD = bytes(_TABLE)


@dataclass(frozen=True)
class Settings:
    """``label_rows`` bounds the labelled rows that fit the model, ``words`` its vocabulary. A word counts
    only if its chi-squared statistic reaches ``least_chi2``: others would fit noise."""

    label_rows: int = 20_000
    words: int = 1024
    least_chi2: float = 12.0
    grades: int = 3
    penalty: float = 1e-4
    rounds: int = 400


def words(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def presence(text: pa.Array, toxic: pa.Array) -> Iterator[tuple]:
    """Rows per word of a batch, by label; counted here so that few rows are shuffled."""
    counts: dict[tuple, int] = {}
    for data, t in zip(texts(text), toxic.to_pylist(), strict=True):
        for w in set(words(data)):
            counts[w, t] = counts.get((w, t), 0) + 1
    for (w, t), n in counts.items():
        yield w.decode(errors="replace"), n if t else 0, 0 if t else n


class Ordinal:
    """The fitted model: weights by word, rising thresholds."""

    def __init__(self, vocabulary: list[str], grades: int) -> None:
        self.numbers = {w.encode(): i for i, w in enumerate(vocabulary)}
        self.weights = np.zeros(len(vocabulary))
        self.thresholds = np.arange(grades - 1, dtype=float) + 3.0

    def find(self, data: bytes) -> tuple[list[int], int, int]:
        """Vocabulary words present, how many words are of the vocabulary's toxic part, words."""
        listed = words(data)
        get = self.numbers.get
        hit = [i for i in map(get, listed) if i is not None]
        return sorted(set(hit)), len(hit), len(listed)

    def above(self, total: np.ndarray) -> np.ndarray:
        """P(severity > k), a column per threshold."""
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds[None, :], -40, 40)))

    def totals(self, rows: list[list[int]]) -> np.ndarray:
        size = np.array([len(r) for r in rows])
        at = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(size.sum()))
        return np.bincount(np.repeat(np.arange(len(rows)), size), self.weights[at],
                           len(rows)) if len(at) else np.zeros(len(rows))

    def fit(self, rows: list[list[int]], grades: np.ndarray, settings: Settings) -> None:
        """Maximum likelihood with a ridge penalty, by gradient steps with momentum (Adam).

        Each grade weighs the same in sum as the clean rows' share allows: rare grades count more.
        """
        n, k = len(rows), settings.grades
        size = np.array([len(r) for r in rows])
        at = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(size.sum()))
        row = np.repeat(np.arange(n), size)
        seen = np.bincount(grades, minlength=k)
        weight = (1 / np.sqrt(np.maximum(seen, 1)))[grades]
        weight /= weight.sum()
        gaps = np.concatenate([[3.0], np.zeros(k - 2)])  # first threshold, log gaps
        theta = np.concatenate([self.weights, gaps])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, settings.rounds + 1):
            w, g = theta[:-(k - 1)], theta[-(k - 1):]
            t = np.concatenate([[g[0]], g[0] + np.cumsum(np.exp(g[1:]))])
            total = np.bincount(row, w[at], n)
            s = 1 / (1 + np.exp(-np.clip(total[:, None] - t[None, :], -40, 40)))
            up = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
            d = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
            i = np.arange(n)
            p = np.maximum(up[i, grades] - up[i, grades + 1], 1e-12)
            d_total = weight * (d[i, grades] - d[i, grades + 1]) / p
            d_t = np.zeros((n, k + 1))
            d_t[i, grades] -= weight * d[i, grades] / p
            d_t[i, grades + 1] += weight * d[i, grades + 1] / p
            by_t = d_t.sum(axis=0)[1:k]
            grad_w = np.bincount(at, d_total[row], len(w)) - settings.penalty * w
            grad_g = np.concatenate([[by_t.sum()], [by_t[j:].sum() * np.exp(g[j])
                                                    for j in range(1, k - 1)]])
            grad = np.concatenate([grad_w, grad_g])
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad ** 2
            theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (
                np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        self.weights = theta[:-(k - 1)]
        g = theta[-(k - 1):]
        self.thresholds = np.concatenate([[g[0]], g[0] + np.cumsum(np.exp(g[1:]))])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Ordinal:
    """Fit on a bounded sample of labelled rows. Without both labels nothing counts as toxic."""
    known = bounded_sample(
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic")), F.col("doc_id"), settings.label_rows)
    rows = written(docs.where("text IS NOT NULL").select("doc_id", "text")
                   .join(F.broadcast(known), "doc_id"), "labelled")
    size = rows.groupBy("toxic").count().collect()
    count = {bool(r["toxic"]): r["count"] for r in size}
    if len(count) < 2:
        return Ordinal([], settings.grades)
    pos, neg = count[True], count[False]
    seen = to_rows(rows, ["text", "toxic"], fields("word string, pos long, neg long"), presence)
    seen = seen.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    gap = F.col("pos") / pos - F.col("neg") / neg
    share = (F.col("pos") + F.col("neg")) / (pos + neg)
    scale = pos * neg / (pos + neg)
    best = seen.where("pos + neg > 1").select(
        "word", (gap * gap * scale / (share * (1 - share) + 1e-9)).alias("score"),
        (gap > 0).alias("up")).where(F.col("score") >= settings.least_chi2).orderBy(F.desc("score"), "word").limit(settings.words).collect()
    model = Ordinal([r["word"] for r in best], settings.grades)
    if not best:
        return model
    strong = best[0]["score"] / 10  # words that tell nearly as much as the best
    telling = {i for i, r in enumerate(best) if r["up"] and r["score"] >= strong}

    def features(text: pa.Array) -> list[list]:
        out: list[list] = [[], []]
        for data in texts(text):
            listed = words(data)
            hit = [i for i in map(model.numbers.get, listed) if i is not None]
            out[0].append(sorted(set(hit)))
            out[1].append(sum(i in telling for i in hit) / max(len(listed), 1))
        return out

    sample = by_batch(rows, ["text"], fields("at array<int>, share double"), features,
                      keep=["toxic"]).limit(settings.label_rows).collect()
    toxic = np.array([bool(r["toxic"]) for r in sample])
    shares = np.array([r["share"] for r in sample])
    cuts = np.quantile(shares[toxic], np.arange(1, settings.grades - 1) / (settings.grades - 1))
    grades = np.where(toxic, 1 + np.searchsorted(cuts, shares, side="right"), 0)
    model.fit([r["at"] for r in sample], grades, settings)
    return model


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade (the most likely one), toxic (p_toxic at least
    one half) of every document. A null text is empty: what the thresholds alone give.
    """
    model = fit(docs, labels, settings)

    def run(text: pa.Array) -> list:
        above = model.above(model.totals([model.find(d)[0] for d in texts(text)]))
        up = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        grade = np.argmax(up[:, :-1] - up[:, 1:], axis=1).astype(np.int32)
        return [above.sum(axis=1), above[:, 0], grade, above[:, 0] >= 0.5]

    return by_batch(docs, ["text"], fields(
        "expected_severity double, p_toxic double, grade int, toxic boolean"), run,
        keep=["doc_id"])
