"""Settings with the defaults a user gets without asking."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Vocabulary:
    """How a term list is fitted."""

    max_terms: int = 5000
    max_ngram: int = 2
    min_df: int = 2
    max_df: float = 0.9


@dataclass(frozen=True)
class Forest:
    """Random forest parameters; all of them are honoured."""

    trees: int = 100
    depth: int = 10
    min_leaf: int = 2
    subset: str = "sqrt"
    seed: int = 42
    added_trees: int = 10


@dataclass(frozen=True)
class Settings:
    """Everything tunable in one place."""

    seed: int = 42
    train_ratio: float = 0.8
    validation_ratio: float = 0.1
    fit_rows: int | None = None
    recommend_from: int | None = None
    recommend_top: int = 5
    block_rows: int = 8192
    block_words: int = 2_000_000
    broadcast_rows: int = 200_000
    vocabulary: Vocabulary = Vocabulary()
    forest: Forest = Forest()


DEFAULTS = Settings()
