"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood.

The patterns find assigned secrets, access keys and long hexadecimal strings. The values they find are
the labelled samples of random strings. All other words are samples of ordinary text; of the long ones
among them each distinct string counts once, so copies of a secret that no pattern knows teach little.
Random strings have one model for each alphabet, and a string is judged by the smallest alphabet
that holds it. A long string that touches no pattern's span is reported as ``markov`` if its
log-likelihood ratio exceeds the log odds of the two kinds and, per character, a limit set on
held-out strings. Counts are taken over all documents.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaje.llm.common import by_batch, fields, fresh, strings, to_rows
from encaje.session import written

KINDS = ("assign", "access", "hex", "markov")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: a longer run is taken from its start
STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16  # length of strings that the models judge
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1  # code 0: the start of a string, and every other byte
CODES = np.zeros(256, dtype=np.int64)
CODES[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(1, N)
TYPES = np.array([0] + [1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4
                        for c in ALPHABET])
CLASSES = ("0123456789abcdef", "0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
           "0123456789abcdefghijklmnopqrstuvwxyz", ALPHABET[:62], ALPHABET)
WITHIN = np.array([[c in x for c in "\0" + ALPHABET] for x in CLASSES])
BACKOFF = 0.2  # share of character types in the ordinary model, and of even chances and repeats in them
TAIL = 0.001  # share of held-out ordinary strings below the low end
BINS = 1000  # scores per character are counted in hundredths from -BINS to BINS, those beyond at the ends

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the first two patterns and of the secret values in them; too short ones go."""
    found: list[Span] = []
    values = []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                found.append((m.start(), 1, m.end()))
                values.append(m.span())
    return found, values


def long_strings(text: str) -> Iterator[tuple[int, int]]:
    """Strings of the alphabet that the models judge."""
    words = text.split()
    if words and max(map(len, words)) >= LEAST:
        for m in STRING.finditer(text):
            yield m.span()


def scan(text: str) -> tuple[list[Span], list[tuple[int, str, int]]]:
    """Base spans, and (start, string, label) samples: the secrets found have label 1, long
    strings that touch no span have label 0."""
    found, values = base_spans(text)
    longs = list(long_strings(text))
    if longs:  # a run of 24 hexadecimal digits always lies in one of them
        runs = [m.span() for m in HEX.finditer(text)]
        found += [(a, 2, b) for a, b in runs]
        values += runs
    found.sort()
    out = [(a, text[a:b], 1) for a, b in sorted(set(values)) if text[a:b].isascii()
           and b - a >= LEAST and "." not in text[a:b]]
    out += [(a, text[a:b], 0) for a, b in longs
            if not any(s[0] < b and s[2] > a for s in found)]
    return found, out


def encoded(string: str) -> np.ndarray:
    return CODES[np.frombuffer(string.encode(), dtype=np.uint8)]


def fold_of(string: str) -> int:
    return zlib.crc32(string.encode()) % 2


def class_of(codes: np.ndarray) -> int:
    """The smallest alphabet that holds the string."""
    return int(WITHIN[:, codes].all(axis=1).argmax())


def steps(codes: np.ndarray) -> np.ndarray:
    """Numbers of the steps from character to character; a run of characters starts from 0."""
    return (np.concatenate([[0], codes[:-1]]) * N + codes)[codes > 0]


def ordinary(counts: np.ndarray) -> np.ndarray:
    """Log probability of each step in ordinary text: the counted steps, mixed with steps between
    types of character (upper, lower, digit, mark) and repeated characters, which also know words
    of unseen parts and lines of dashes."""
    c = counts.reshape(N, N) + 1e-9
    c[:, 0] = 0
    kind = np.eye(5)[TYPES]
    moves = kind.T @ c @ kind
    moves[:, 0] = 0
    moves /= moves.sum(axis=1, keepdims=True)
    moves[:, 1:] = (1 - BACKOFF) * moves[:, 1:] + BACKOFF / 4
    seen = c.sum(axis=0) + 1.0
    seen[0] = 0
    share = (1 - BACKOFF) * seen / np.maximum((kind.T @ seen)[TYPES], 1) + BACKOFF / kind.sum(axis=0)[TYPES]
    share[0] = 0
    typed = (1 - BACKOFF) * moves[TYPES][:, TYPES] * share + BACKOFF * np.eye(N)
    p = (1 - BACKOFF) * c / c.sum(axis=1, keepdims=True) + BACKOFF * typed
    p[:, 0] = 1
    return np.log(p).ravel()


def random_of(counts: np.ndarray, k: int) -> np.ndarray:
    """Log probability of each step in random strings over alphabet ``k``, one step of each kind added."""
    c = (counts.reshape(N, N) + 1.0) * WITHIN[k]
    p = c / c.sum(axis=1, keepdims=True)
    return np.log(np.where(WITHIN[k], p, 1.0)).ravel()


@dataclass
class Markov:
    """Log-likelihood ratio of random to ordinary by fold, alphabet and step; what it must pass in
    all (the log odds) and per character. No string is judged by models that learned from it."""

    ratio: np.ndarray
    odds: float = 0.0
    limit: float = np.inf

    def score(self, string: str) -> float:
        codes = encoded(string)
        return float(self.ratio[fold_of(string), class_of(codes)][steps(codes)].sum())

    def secret(self, string: str) -> bool:
        return self.score(string) > max(self.odds, self.limit * len(string))

    def spans(self, found: list[Span], longs: list[tuple[int, str, int]]) -> list[Span]:
        """All spans: those of the patterns, and the strings that look random."""
        more = [(a, 3, a + len(s)) for a, s, label in longs if not label and self.secret(s)]
        return sorted(found + more)


def train(counts: np.ndarray) -> Markov:
    """``counts``: steps by fold and kind; kind 0 is ordinary text, kind k + 1 random strings of
    alphabet k. Each fold gets the models of the other one."""
    return Markov(np.stack([
        [random_of(c[k + 1], k) - plain for k in range(len(CLASSES))]
        for c in counts[::-1] for plain in [ordinary(c[0])]]))


def limits_of(scores: np.ndarray) -> tuple[float, float]:
    """Log odds, and the limit per character, from counts of held-out scores by label (0 ordinary,
    1 random) and bin.

    Ordinary scores are taken to reach as far above their median as below it: the upper end itself
    may hold secrets that no pattern knows. The limit is midway between that end and the median
    of random strings, as values found by patterns are not all random. Without random strings
    nothing passes; where most long ordinary strings are unknown secrets, they pass for ordinary.
    """
    n = scores.sum(axis=1)
    if not n[1]:
        return 0.0, np.inf

    def at(label: int, share: float) -> float:
        below = np.cumsum(scores[label])
        return (int(np.searchsorted(below, n[label] * share, side="right")) - BINS) / 100

    end = 2 * at(0, 0.5) - at(0, TAIL) if n[0] else 0.0
    return float(np.log((n[0] + 1) / (n[1] + 1))), max((end + at(1, 0.5)) / 2, end, 0.0)


LISTS = ("starts array<long>, kinds array<int>, ends array<long>, "
         "l_starts array<long>, l_strings array<string>, l_labels array<int>")


def _lists(text: pa.Array) -> list[list]:
    out: list[list] = [[] for _ in range(6)]
    for t in strings(text):
        found, longs = scan(t)
        for i in range(3):
            out[i].append([s[i] for s in found])
            out[3 + i].append([s[i] for s in longs])
    return out


def _words(text: pa.Array) -> Iterator[tuple]:
    """Steps of all words of ordinary text that are not long strings."""
    parts = []
    for t in strings(text):
        found, longs = scan(t)
        cut = found + [(a, 3, a + len(s)) for a, s, label in longs if not label]
        parts.append(masked(t, cut, " "))
    codes = CODES[np.frombuffer("\n".join(parts).encode(), dtype=np.uint8)]
    counts = np.bincount(steps(codes), minlength=N * N) if codes.size else np.zeros(N * N, dtype=int)
    for step in np.flatnonzero(counts).tolist():
        yield step, int(counts[step])


def _strings(strings_: pa.Array, labels: pa.Array) -> Iterator[tuple]:
    """Steps of distinct long strings by fold and kind."""
    counts = np.zeros((2, len(CLASSES) + 1, N * N), dtype=np.int64)
    for s, label in zip(strings_.to_pylist(), labels.to_pylist(), strict=True):
        codes = encoded(s)
        np.add.at(counts[fold_of(s), label * (1 + class_of(codes))], steps(codes), 1)
    for fold, kind, step in np.argwhere(counts).tolist():
        yield fold, kind, step, int(counts[fold, kind, step])


def fit(docs: DataFrame, scanned: DataFrame) -> Markov:
    """Train from all texts and their scanned strings.

    Long strings are dealt into two folds by a hash, and each is scored by the models of the other
    one, for the limit as for the verdict. At most a row per fold, kind and step and a row per
    label and bin of scores reach the driver.
    """
    each = written(scanned.select(F.explode(F.arrays_zip("l_strings", "l_labels")).alias("s")).groupBy(
        F.col("s.l_strings").alias("string")).agg(F.max("s.l_labels").alias("label")), "distinct-strings")
    counts = np.zeros((2, len(CLASSES) + 1, N * N))
    rows = to_rows(each, ["string", "label"], fields("fold int, kind int, step int, n long"),
                   _strings).groupBy("fold", "kind", "step").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        counts[r["fold"], r["kind"], r["step"]] = r["n"]
    words = to_rows(docs, ["text"], fields("step int, n long"), _words)
    for r in words.groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[:, 0, r["step"]] += r["n"]
    model = train(counts)

    def score(strings_: pa.Array, labels: pa.Array) -> Iterator[tuple]:
        for s, label in zip(strings_.to_pylist(), labels.to_pylist(), strict=True):
            yield label, int(np.clip(np.floor(100 * model.score(s) / len(s)), -BINS, BINS))

    scores = np.zeros((2, 2 * BINS + 1))
    for r in to_rows(each, ["string", "label"], fields("label int, bin int"), score).groupBy(
            "label", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        scores[r["label"], r["bin"] + BINS] = r["n"]
    model.odds, model.limit = limits_of(scores)
    return model


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over all texts: base spans and long strings of each document, written."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return written(by_batch(docs, ["text"], fields(LISTS), _lists, keep=["doc_id"]), "strings")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document.

    Null and empty texts have no spans. Rows with equal ids stay apart.
    """
    scanned = prepare(docs, id_col, text_col)
    model = fit(docs.select(F.col(f"`{text_col}`").alias("text")), scanned)

    def digest(*columns: pa.Array) -> list[list]:
        out: list[list] = [[] for _ in range(6)]
        for starts, kinds, ends, a, s, label in zip(*[c.to_pylist() for c in columns],
                                                    strict=True):
            found = list(zip(starts, kinds, ends, strict=True))
            spans = model.spans(found, list(zip(a, s, label, strict=True)))
            for i in range(3):
                out[i].append(sum(x[1] == i for x in found))
            out[3].append(hashlib.sha256(joined(found).encode()).hexdigest())
            out[4].append(joined(spans))
            out[5].append(len(spans) - len(found))
        return out

    return by_batch(
        scanned, ["starts", "kinds", "ends", "l_starts", "l_strings", "l_labels"],
        fields("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
               "n_markov long"), digest, keep=["doc_id"])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with each maximal run of spans replaced by the mask."""
    parts, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with their columns, every secret in ``text`` replaced by the mask.

    ``n_chars``, if there, follows the new text. Null stays null.
    """
    model = fit(docs, prepare(docs))
    name = fresh(docs, "_clean")

    def clean(text: pa.Array) -> list[list]:
        out = []
        for t in text.to_pylist():
            spans = model.spans(*scan(t)) if t else []
            out.append(masked(t, spans, mask) if spans else t)
        return [out]

    done = by_batch(docs, ["text"], fields(f"`{name}` string"), clean, keep=docs.columns)
    done = done.withColumn("text", F.col(name)).drop(name)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.char_length("text").cast(kind))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
