"""Match probabilities: unfitted cosine, TF-IDF cosine, and the columns around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaje import lexicon
from encaje.functions.present import match_score
from encaje.functions.text import words
from encaje.functions.vectors import cosine, dot, square_norm, term_counts


def word_vectors(records: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """``id, terms, square``: word counts of each text and their squared length."""
    counted = records.select(id_column, term_counts(words(F.col(text))).alias("terms"))
    return counted.withColumn("square", square_norm(F.col("terms")))


def attach_sides(pairs: DataFrame, cv_side: DataFrame, job_side: DataFrame,
                 how: str = "left") -> DataFrame:
    """Join both sides, columns prefixed ``cv_`` and ``job_``; by default all pairs are kept.

    Every id has one row on its side, so a popular id only makes the pair side
    of the join heavy, which adaptive execution splits.
    """
    def prefixed(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])

    return (pairs.join(prefixed(cv_side, "cv_id", "cv"), "cv_id", how)
            .join(prefixed(job_side, "job_id", "job"), "job_id", how))


def used_only(side: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows of one side that some pair asks for; apply before any text work."""
    return side.join(pairs.select(key), key, "left_semi")


def unfitted_columns(sides: DataFrame) -> DataFrame:
    """Probability and error of joined word vectors."""
    failed = F.col("cv_terms").isNull() | F.col("job_terms").isNull()
    empty = (F.size("cv_terms") == 0) & (F.size("job_terms") == 0)
    similarity = cosine(dot(F.col("cv_terms"), F.col("job_terms")),
                        F.col("cv_square"), F.col("job_square"))
    return (sides
            .withColumn("match_probability",
                        F.when(failed | empty, F.lit(0.0)).otherwise(similarity))
            .withColumn("error", F.when(failed, lexicon.PAIR_ERROR)
                        .when(empty, lexicon.EMPTY_ERROR)))


def with_score(df: DataFrame) -> DataFrame:
    """Add ``match_score`` in percent."""
    return df.withColumn("match_score", match_score(F.col("match_probability")))


def similarity_class(probability: Column) -> Column:
    """1 if strictly above one half."""
    return (probability > 0.5).cast("int")


def logits(probability: Column) -> Column:
    return F.array(F.lit(1.0) - probability, probability)


def single_class_probability(similarity: Column) -> Column:
    """Similarity moved into the middle of the range, away from certainty."""
    return F.lit(0.3) + similarity * F.lit(0.4)


def tfidf_similarity() -> Column:
    """Cosine of two unit vectors over one shared vocabulary."""
    return dot(F.col("cv_vector"), F.col("job_vector"), "idx", "w", F.lit(0.0))


def score_unfitted(pairs: DataFrame, cv_recs: DataFrame, job_recs: DataFrame) -> DataFrame:
    """Cosine of word counts for listed pairs; failed pairs stay with 0 and an error."""
    sides = attach_sides(pairs, word_vectors(cv_recs, "cv_id"), word_vectors(job_recs, "job_id"))
    scored = with_score(unfitted_columns(sides))
    return scored.select(*pairs.columns, "match_probability", "match_score", "error")
