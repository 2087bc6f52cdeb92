"""Term counts, vocabularies and TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from encaje.functions.text import let, ngrams, words
from encaje.functions.vectors import entries, term_counts
from encaje.session import written
from encaje.settings import DEFAULTS, Vocabulary

_WORDS_FOR_EACH_TERM = 4  # frequent words that may be sent to all tasks, for each term of the vocabulary


def small(df: DataFrame, rows: int, limit: int = DEFAULTS.broadcast_rows) -> DataFrame:
    """Broadcast ``df`` if its known bound on rows is small, else leave the choice to Spark."""
    return F.broadcast(df) if rows <= limit else df


def document_terms(docs: DataFrame, id_column: str, text: str = "text",
                   longest: int = DEFAULTS.vocabulary.max_ngram) -> DataFrame:
    """``id, terms``: the n-gram counts of each document, made inside its row."""
    tokens = ngrams(words(F.col(text)), longest) if longest > 1 else words(F.col(text))
    return docs.select(id_column, term_counts(tokens).alias("terms"))


def fit_vocabulary(doc_terms: DataFrame, params: Vocabulary = DEFAULTS.vocabulary,
                   times: str | None = None) -> DataFrame:
    """``idx, term, df, total, idf`` of the most frequent terms.

    ``times`` names a count of how often each document occurs in the fit set,
    so that a document used by many samples is read once. The term counts are
    read twice; see :func:`_most_frequent`.
    """
    often = F.lit(1).cast("bigint") if times is None else F.col(times).cast("bigint")
    counted = doc_terms.select(often.alias("times"), "terms")
    each = entries(counted, "terms", "times")
    gram = F.contains(F.col("t.term"), F.lit(" "))  # no word holds a blank
    ends = [F.substring_index("t.term", " ", at) for at in (1, -1)]
    return _most_frequent(counted, each.where(~gram),
                          lambda known: each.where(gram & known(ends[0]) & known(ends[1])), params)


def fit_text_vocabulary(docs: DataFrame, text: str = "text",
                        params: Vocabulary = DEFAULTS.vocabulary) -> DataFrame:
    """The same, of texts; only n-grams of frequent words are made at all."""
    counted = docs.select(F.lit(1).cast("bigint").alias("times"), words(F.col(text)).alias("tokens"))

    def each(tokens: Column) -> DataFrame:
        return entries(counted, term_counts(tokens), "times")

    def longer(known: Callable[[Column], Column]) -> DataFrame:
        frequent = F.transform("tokens", lambda w: F.when(known(w), w))
        return each(ngrams(frequent, params.max_ngram, 2))

    return _most_frequent(counted, each(F.col("tokens")), longer if params.max_ngram > 1 else None, params)


def _totals(each: DataFrame, params: Vocabulary) -> DataFrame:
    """``term, df, total``. A partial aggregate: a word of every document shuffles one row per task."""
    return (each.groupBy(F.col("t.term").alias("term"))
            .agg(F.sum("times").alias("df"), F.sum(F.col("times") * F.col("t.n")).alias("total"))
            .where(F.col("df") >= params.min_df))


def _most_frequent(counted: DataFrame, single: DataFrame, longer: Callable | None,
                   params: Vocabulary) -> DataFrame:
    """The vocabulary of the counts of words, ``single``, and of n-grams, which ``longer`` makes of frequent words.

    An n-gram occurs at most as often as each of its words. So once ``max_terms`` words are known to occur
    ``least`` times, no n-gram with a rarer word can be chosen, and those, nearly all there are,
    are never shuffled. Where too many words reach ``least``, the n-grams of all words are counted.
    """
    docs = counted.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("docs")).first()["docs"]
    single = written(_totals(single, params), "words")

    def allowed(df: DataFrame) -> DataFrame:
        return df.where(F.col("df") <= F.lit(docs) * F.lit(float(params.max_df)))

    def best(df: DataFrame) -> DataFrame:
        return df.orderBy(F.desc("total"), "term").limit(params.max_terms)

    terms = allowed(single)
    if longer is not None:
        last = best(terms).agg(F.count("*").alias("rows"), F.min("total").alias("least")).first()
        least = last["least"] if last["rows"] == params.max_terms else 0
        most = _WORDS_FOR_EACH_TERM * params.max_terms
        frequent = [r["term"] for r in single.where(F.col("total") >= least).select("term").limit(most + 1).collect()]
        known = (lambda w: w.isin(frequent)) if len(frequent) <= most else (lambda w: F.lit(True))
        terms = terms.where(F.col("total") >= least).unionByName(allowed(_totals(longer(known), params)))
    # At most max_terms rows from here on.
    return best(terms).select(
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "term", "df", "total",
        smooth_idf(F.lit(docs), F.col("df")).alias("idf"))


def smooth_idf(docs: Column, df: Column) -> Column:
    return F.log((docs + 1).cast("double") / (df + 1).cast("double")) + 1.0


def sublinear(n: Column) -> Column:
    return F.log(n.cast("double")) + 1.0


def tfidf_vectors(doc_terms: DataFrame, vocabulary: DataFrame, id_column: str,
                  max_terms: int = DEFAULTS.vocabulary.max_terms) -> DataFrame:
    """``id, vector`` with ``vector array<struct<idx, w>>``, sorted, of length 1.

    Terms outside the vocabulary are dropped before the only shuffle, which is
    by document. A document without known terms keeps an empty vector; for that
    its first term stays, without an entry.
    """
    terms = doc_terms.select(id_column, F.posexplode_outer("terms").alias("_at", "t")).select(
        id_column, "_at", F.col("t.term").alias("term"), F.col("t.n").alias("n"))
    known = terms.join(small(vocabulary.select("term", "idx", "idf"), max_terms), "term", "left").where(
        F.col("idx").isNotNull() | (F.coalesce("_at", F.lit(0)) == 0))
    entry = F.when(F.col("idx").isNotNull(), F.struct(
        F.col("idx"), (sublinear(F.col("n")) * F.col("idf")).alias("w")))
    return (known.groupBy(id_column).agg(F.sort_array(F.collect_list(entry)).alias("_v"))
            .select(id_column, unit_length(F.col("_v")).alias("vector")))


def unit_length(vector: Column) -> Column:
    """Divide by the Euclidean length; an empty vector stays empty."""
    square = F.aggregate(vector, F.lit(0.0), lambda acc, t: acc + t["w"] * t["w"])
    return let(F.sqrt(square), lambda length: F.transform(
        vector, lambda t: F.struct(t["idx"].alias("idx"), (t["w"] / length).alias("w"))))


def packed(vector: Column, size: int) -> Column:
    """The same vector as a sparse ML vector.

    No built-in makes a sparse vector from arrays, but the JSON reader accepts
    the vector type, in the struct form it is stored in, without leaving the JVM.
    """
    stored = F.to_json(F.struct(F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), vector["idx"].alias("indices"),
        vector["w"].alias("values")).alias("v")))
    return F.from_json(stored, StructType([StructField("v", VectorUDT())]))["v"]


def with_times(doc_terms: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """The documents that samples use, with how many samples use each."""
    return doc_terms.join(samples.groupBy(key).agg(F.count("*").alias("times")), key)


def fit_both(samples: DataFrame, cv_terms: DataFrame, job_terms: DataFrame,
             params: Vocabulary = DEFAULTS.vocabulary) -> tuple[DataFrame, DataFrame]:
    """One vocabulary for each side, fitted on the documents of the samples.

    ``cv_terms`` and ``job_terms`` are the n-gram counts of the records.
    """
    return (fit_vocabulary(with_times(cv_terms, samples, "cv_id"), params, "times"),
            fit_vocabulary(with_times(job_terms, samples, "job_id"), params, "times"))
