"""Scores as text, band and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaje import lexicon


def match_score(probability: Column) -> Column:
    """Probability as a percentage."""
    return probability * F.lit(100.0)


def rounded_score(score: Column) -> Column:
    """Two decimals, half up, computed in doubles."""
    return F.floor(score * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def score_text(score: Column) -> Column:
    return F.format_string("%.2f%%", rounded_score(score))


def match_band(score: Column) -> Column:
    """Band of the rounded score."""
    shown = rounded_score(score)
    out = None
    for name, floor in lexicon.BANDS:
        out = F.when(shown >= floor, name) if out is None else out.when(shown >= floor, name)
    return out.otherwise(lexicon.LOWEST_BAND)


def match_advice(score: Column) -> Column:
    best = lexicon.BANDS[0][0]
    return F.when(match_band(score) == best, lexicon.ADVICE[True]).otherwise(lexicon.ADVICE[False])
