"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encaje.functions import present
from encaje.functions import text as T
from encaje.functions.vectors import entries
from encaje.operators import (
    applications as A, evaluate as E, features as FE, matching as M, model as MO,
    ranking as RK, records as R, scoring as S)
from encaje.plans.views import Inputs
from encaje.session import fresh_path, written
from encaje.settings import DEFAULTS
from encaje.sources import corpora, models, prepared, sinks
from encaje.streaming import recommend as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The one candidate and the one posting of the one-to-many queries.
ONE_CV, ONE_JOB = "cv1", "job1"

SAMPLE_ROWS = 100  # of the two sampling queries; below the size of their tables


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register under the function's name; the inputs are built from the folder."""
    QUERIES[fn.__name__] = lambda spark, folder: fn(Inputs(spark, folder))
    return fn


def _six(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _list(c: Column, name: str) -> Column:
    """A list as one text, null staying null."""
    return F.when(c.isNotNull(), F.array_join(c, "|")).alias(name)


# --- sources ----------------------------------------------------------------


@query
def applications_scan(d: Inputs) -> DataFrame:
    path = fresh_path(d.spark, "applications")
    d.applications.write.parquet(path)
    return corpora.read_applications(d.spark, path)


@query
def cv_scan(d: Inputs) -> DataFrame:
    path = fresh_path(d.spark, "cvs")
    d.cvs.write.parquet(path)
    return corpora.read_cvs(d.spark, path)


@query
def job_scan(d: Inputs) -> DataFrame:
    path = fresh_path(d.spark, "jobs")
    d.jobs.write.parquet(path)
    return corpora.read_jobs(d.spark, path, A.ids_in_use(A.renamed(d.applications), "job_id"))


@query
def pairs_scan(d: Inputs) -> DataFrame:
    path = fresh_path(d.spark, "pairs")
    d.pairs.write.option("header", True).csv(path)
    return corpora.read_pairs(d.spark, path)


@query
def page_concat(d: Inputs) -> DataFrame:
    return corpora.concat_pages(d.cv_pages)


@query
def job_lookup(d: Inputs) -> DataFrame:
    return corpora.lookup_jobs(A.renamed(d.applications), d.job_priority, d.jobs)


@query
def predictions_sink(d: Inputs) -> DataFrame:
    path = fresh_path(d.spark, "predictions")
    sinks.write_predictions(M.score_pairs(d.pairs, d.cvs, d.jobs), path)
    return sinks.read_predictions(d.spark, path).select(
        "cv_id", "job_id", _six("match_probability"), _six("match_score"), "error")


# --- applications -----------------------------------------------------------


@query
def applications_renamed(d: Inputs) -> DataFrame:
    return A.renamed(d.applications)


@query
def ids_in_use(d: Inputs) -> DataFrame:
    renamed = A.renamed(d.applications)
    sides = [A.ids_in_use(renamed, c).select(F.lit(c).alias("side"), F.col(c).alias("id"))
             for c in ("cv_id", "job_id")]
    return sides[0].unionByName(sides[1])


@query
def status_label(d: Inputs) -> DataFrame:
    return A.add_label(d.applications).select("applicationId", "applicationStatus", "label")


@query
def valid_applications(d: Inputs) -> DataFrame:
    return A.valid_applications(A.renamed(d.applications), d.cvs, d.jobs)


@query
def valid_count(d: Inputs) -> DataFrame:
    valid = A.valid_applications(A.renamed(d.applications), d.cvs, d.jobs)
    return valid.agg(F.count("*").alias("valid"))


def _status(d: Inputs) -> DataFrame:
    renamed = A.renamed(d.applications)
    cvs = A.process_status(A.ids_in_use(renamed, "cv_id"), d.cvs, "cv_id")
    jobs = A.process_status(A.ids_in_use(renamed, "job_id"), d.jobs, "job_id")
    return (cvs.select(F.lit("cv").alias("corpus"), F.col("cv_id").alias("id"), "success")
            .unionByName(jobs.select(F.lit("job").alias("corpus"), F.col("job_id").alias("id"),
                                     "success")))


@query
def process_status(d: Inputs) -> DataFrame:
    return _status(d).withColumn("success", F.col("success").cast("int"))


@query
def process_counts(d: Inputs) -> DataFrame:
    return _status(d).groupBy("corpus").agg(
        F.count_if("success").alias("succeeded"), F.count("*").alias("total"))


@query
def missing_ids(d: Inputs) -> DataFrame:
    renamed = A.renamed(d.applications)
    cvs = A.missing_ids(A.ids_in_use(renamed, "cv_id"), d.cvs, "cv_id")
    jobs = A.missing_ids(A.ids_in_use(renamed, "job_id"), d.jobs, "job_id")
    return (cvs.select(F.lit("cv").alias("corpus"), F.col("cv_id").alias("id"))
            .unionByName(jobs.select(F.lit("job").alias("corpus"), F.col("job_id").alias("id"))))


def _samples(d: Inputs) -> DataFrame:
    renamed = A.renamed(d.applications)
    cvs = S.used_only(d.cvs, renamed, "cv_id")
    jobs = S.used_only(d.jobs, renamed, "job_id")
    return A.training_samples(renamed, R.cv_records(cvs), R.job_records(jobs))


@query
def training_samples(d: Inputs) -> DataFrame:
    return _samples(d)


@query
def split_80_10_10(d: Inputs) -> DataFrame:
    return A.split(d.applications, "applicationId").select("applicationId", "split")


@query
def sample_jobs(d: Inputs) -> DataFrame:
    return A.sample_rows(d.jobs.select("job_id"), "job_id", SAMPLE_ROWS)


@query
def fit_sample(d: Inputs) -> DataFrame:
    train = A.split(d.applications, "applicationId").where("split = 'train'")
    return A.sample_rows(train.select("applicationId", "candidateId", "jobId"),
                         "applicationId", SAMPLE_ROWS)


# --- cleaning ---------------------------------------------------------------


def _cleaning(name: str, step: Callable[[Column], Column]) -> None:
    def run(d: Inputs) -> DataFrame:
        return d.documents.select("doc_id", step(F.col("text")).alias("text"))

    run.__name__ = name
    query(run)


for _name in ("clean_lower", "clean_email", "clean_url", "clean_phone", "clean_space",
              "clean_chars"):
    _cleaning(_name, getattr(T, _name))
_cleaning("clean_documents", T.clean)


@query
def clean_pages(d: Inputs) -> DataFrame:
    return R.job_tokens(d.pages.withColumnRenamed("page_id", "job_id")).select(
        F.col("job_id").alias("page_id"), T.clean(F.col("full_text")).alias("text"))


# --- candidate records ------------------------------------------------------


def _sections(d: Inputs) -> DataFrame:
    cleaned = d.cvs.select("cv_id", T.clean(F.col("raw_text")).alias("raw_text"))
    return R.add_cv_sections(cleaned)


@query
def cv_sections(d: Inputs) -> DataFrame:
    return _sections(d).select("cv_id", "sections.*")


def _cv_keyword_query(section: str) -> None:
    def run(d: Inputs) -> DataFrame:
        found = R.keyword_list(F.col(f"sections.{section}"), R.lexicon.CV_KEYWORDS[section])
        return _sections(d).select("cv_id", _list(found, "keywords"))

    run.__name__ = f"cv_kw_{section}"
    query(run)


for _name in R.lexicon.CV_KEYWORDS:
    _cv_keyword_query(_name)


def _keywords_flat(names) -> list[Column]:
    return [_list(F.col(f"keywords.{n}"), f"kw_{n}") for n in names]


@query
def cv_keywords(d: Inputs) -> DataFrame:
    return R.cv_records(d.cvs).select("cv_id", *_keywords_flat(R.lexicon.CV_KEYWORDS))


@query
def cv_weighted_text(d: Inputs) -> DataFrame:
    return R.cv_records(d.cvs).select("cv_id", "text")


@query
def cv_records(d: Inputs) -> DataFrame:
    return R.cv_records(d.cvs).select(
        "cv_id", "text", "raw_text", "sections.*", *_keywords_flat(R.lexicon.CV_KEYWORDS),
        F.col("success").cast("int").alias("success"))


@query
def cv_process_summary(d: Inputs) -> DataFrame:
    ids = A.ids_in_use(A.renamed(d.applications), "cv_id")
    return R.process_summary(ids, R.cv_records(d.cvs), "cv_id", "cv")


# --- posting records --------------------------------------------------------


@query
def html_text(d: Inputs) -> DataFrame:
    return R.job_tokens(d.jobs).select("job_id", "full_text")


def _job_field_query(name: str) -> None:
    def run(d: Inputs) -> DataFrame:
        return R.found_job_fields(d.jobs, [name]).select("job_id", name)

    run.__name__ = f"job_{name}"
    query(run)


for _name in R.lexicon.JOB_ELEMENTS:
    _job_field_query(_name)


@query
def job_skills(d: Inputs) -> DataFrame:
    return R.raw_job_fields(d.jobs).select("job_id", "skills")


@query
def job_experience(d: Inputs) -> DataFrame:
    return R.raw_job_fields(d.jobs).select("job_id", "experience")


@query
def job_education(d: Inputs) -> DataFrame:
    return R.raw_job_fields(d.jobs).select("job_id", "education")


@query
def job_fields_clean(d: Inputs) -> DataFrame:
    return R.clean_job_fields(R.raw_job_fields(d.jobs)).drop("full_text")


_JOB_KEYWORDS = ["title", "skills", "experience", "education"]


def _job_keyword_query(name: str) -> None:
    def run(d: Inputs) -> DataFrame:
        cleaned = R.clean_job_fields(R.raw_job_fields(d.jobs))
        return cleaned.select("job_id", R.job_keywords("").getField(name).alias("k")).select(
            "job_id", _list(F.col("k"), "keywords"))

    run.__name__ = f"job_kw_{name}"
    query(run)


for _name in _JOB_KEYWORDS:
    _job_keyword_query(_name)


@query
def job_weighted_text(d: Inputs) -> DataFrame:
    return R.job_records(d.jobs).select("job_id", "text")


@query
def job_records(d: Inputs) -> DataFrame:
    return R.job_records(d.jobs).select(
        "job_id", "text", "raw_text", "fields.*", *_keywords_flat(_JOB_KEYWORDS),
        F.col("success").cast("int").alias("success"))


@query
def job_process_summary(d: Inputs) -> DataFrame:
    ids = A.ids_in_use(A.renamed(d.applications), "job_id")
    return R.process_summary(ids, R.job_records(d.jobs), "job_id", "job")


# --- features ---------------------------------------------------------------


@query
def tokens(d: Inputs) -> DataFrame:
    return d.documents.select("doc_id", _list(T.words(F.col("text")), "tokens"))


@query
def ngrams(d: Inputs) -> DataFrame:
    return d.documents.select("doc_id", _list(T.ngrams(T.words(F.col("text"))), "ngrams"))


@query
def vocabulary(d: Inputs) -> DataFrame:
    return FE.fit_text_vocabulary(d.documents).select("idx", "term", "df", "total")


@query
def idf(d: Inputs) -> DataFrame:
    return FE.fit_text_vocabulary(d.documents).select("term", _six("idf"))


@query
def tf_sublinear(d: Inputs) -> DataFrame:
    counts = FE.document_terms(d.documents, "doc_id", longest=1)
    return entries(counts, "terms", "doc_id").select(
        "doc_id", F.col("t.term").alias("term"),
        F.round(FE.sublinear(F.col("t.n")), 6).alias("tf"))


@query
def tfidf(d: Inputs) -> DataFrame:
    terms = FE.document_terms(d.documents, "doc_id")
    vocab = written(FE.fit_text_vocabulary(d.documents), "terms")
    weights = entries(FE.tfidf_vectors(terms, vocab, "doc_id"), "vector", "doc_id")
    return weights.select("doc_id", F.col("t.idx").alias("idx"), F.col("t.w").alias("w")).join(
        FE.small(vocab.select("idx", "term"), DEFAULTS.vocabulary.max_terms), "idx").select(
        "doc_id", "term", F.round("w", 6).alias("weight"))


def _labelled(d: Inputs) -> DataFrame:
    """Valid, labelled applications without texts, with their part of the split."""
    placed = A.split(d.applications, "applicationId")
    return A.valid_applications(A.renamed(placed), d.cvs, d.jobs).withColumnRenamed(
        "applicationId", "application_id")


def _parts(d: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, and the terms of both sides' records, each made once."""
    samples = written(_labelled(d), "samples")
    cvs = MO.term_side(R.cv_records(S.used_only(d.cvs, samples, "cv_id")), samples, "cv_id")
    jobs = MO.term_side(R.job_records(S.used_only(d.jobs, samples, "job_id")), samples, "job_id")
    return samples, written(cvs, "cv-terms"), written(jobs, "job-terms")


def _fit_set(samples: DataFrame) -> DataFrame:
    return A.sample_rows(samples, "application_id", DEFAULTS.fit_rows)


@query
def fit_vectorizers(d: Inputs) -> DataFrame:
    samples, cvs, jobs = _parts(d)
    sides = FE.fit_both(_fit_set(samples), cvs, jobs)
    out = [s.select(F.lit(n).alias("side"), "idx", "term", "df", "total", _six("idf"))
           for s, n in zip(sides, ("cv", "job"))]
    return out[0].unionByName(out[1])


@query
def pair_features(d: Inputs) -> DataFrame:
    samples, cvs, jobs = _parts(d)
    cv_words, job_words = (written(v, "terms") for v in FE.fit_both(_fit_set(samples), cvs, jobs))
    slim = samples.select("application_id", "cv_id", "job_id", "label")
    made = MO.pair_features(slim, cvs, jobs, cv_words, job_words)
    size = DEFAULTS.vocabulary.max_terms
    values = made.withColumn("v", vector_to_array("features"))
    sides = {"cv": F.slice("v", 1, size), "job": F.slice("v", size + 1, size)}

    def total(part: Column) -> Column:
        return F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), 6)

    return values.select(
        "application_id", "label",
        *[total(c).alias(f"{n}_sum") for n, c in sides.items()],
        *[F.size(F.filter(c, lambda x: x != 0)).alias(f"{n}_terms") for n, c in sides.items()])


# --- model ------------------------------------------------------------------


@query
def class_weights(d: Inputs) -> DataFrame:
    labelled = A.valid_applications(A.renamed(d.applications), d.cvs, d.jobs)
    return E.class_weights(labelled).select("label", _six("weight"))


def _training(d: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled samples with their part, and the texts of both sides' records."""
    samples = written(_labelled(d), "samples")
    cvs = R.cv_records(S.used_only(d.cvs, samples, "cv_id")).select("cv_id", "text")
    jobs = R.job_records(S.used_only(d.jobs, samples, "job_id")).select("job_id", "text")
    return samples, written(cvs, "cv-records"), written(jobs, "job-records")


def _forest_checks(d: Inputs, batches: int = 1) -> tuple[MO.MatchModel, DataFrame]:
    """A forest fitted on the training part, and all samples with their scores and what holds for them: the
    probability is one, class and score follow from it, and a walk of the node table finds it too."""
    samples, cvs, jobs = _parts(d)
    keys = ["application_id", "cv_id", "job_id", "label", "split"]
    model = MO.fit_terms(samples.where("split = 'train'"), cvs, jobs, batches=batches)
    scored = model.score_terms(samples.select(*keys), cvs, jobs)
    walked = model.walk_terms(samples.select("application_id", "cv_id", "job_id"), cvs, jobs).select(
        "application_id", "walk")
    p = F.col("match_probability")
    return model, written(scored.join(walked, "application_id").select(
        *keys, p, "class", p.between(0, 1).alias("in_range"),
        (F.col("class") == (p > 0.5).cast("int")).alias("class_right"),
        (F.abs(F.col("match_score") - 100 * p) < 1e-9).alias("score_right"),
        (F.abs(F.col("walk") - p) < 1e-9).alias("walk_right")), "scored")


_HOLDS = ["in_range", "class_right", "score_right", "walk_right"]


def _trained(d: Inputs, batches: int) -> DataFrame:
    model, scored = _forest_checks(d, batches)
    rows = scored.groupBy("split").agg(
        F.count("*").alias("rows"), *[F.count_if(c).alias(c) for c in _HOLDS])
    names = ("accuracy", "precision", "recall", "f1", "auc")
    sound = sum((F.col(c).between(0, 1).cast("int") for c in names), F.lit(0))
    return rows.join(E.metrics(scored, ["split"]), "split").select(
        "split", "rows", *_HOLDS, sound.alias("metrics_in_range"),
        F.lit(sum(f.getNumTrees for f in model.forests)).alias("trees"))


@query
def train_forest(d: Inputs) -> DataFrame:
    return _trained(d, 1)


@query
def train_forest_batched(d: Inputs) -> DataFrame:
    return _trained(d, 3)


@query
def score_forest(d: Inputs) -> DataFrame:
    return _forest_checks(d)[1].select("application_id", "cv_id", "job_id", "label", *_HOLDS)


@query
def recommend_all_forest(d: Inputs) -> DataFrame:
    """The best postings of every sampled candidate by a forest, each checked by a walk of its trees."""
    samples, cvs, jobs = _parts(d)
    model = MO.fit_terms(samples.where("split = 'train'"), cvs, jobs)
    found = written(M.recommend_vectors(
        *(written(model.term_words(t, k), "vectors") for t, k in ((cvs, "cv_id"), (jobs, "job_id"))),
        model=model), "answers")
    p = F.col("match_probability")
    return model.walk_terms(found, cvs, jobs).select(
        "cv_id", "rank", p.between(0, 1).alias("in_range"),
        (F.abs(F.col("match_score") - 100 * p) < 1e-9).alias("score_right"),
        (F.abs(F.col("walk") - p) < 1e-8).alias("walk_right"))


def _sample_scores(model: MO.MatchModel, samples: DataFrame, cvs: DataFrame,
                   jobs: DataFrame) -> DataFrame:
    return model.score(samples.select("application_id", "cv_id", "job_id", "label", "split"),
                       cvs, jobs)


@query
def model_roundtrip(d: Inputs) -> DataFrame:
    samples, cvs, jobs = _training(d)
    model = MO.fit_model(samples.where("split = 'train'"), cvs, jobs)
    path = fresh_path(d.spark, "model")
    models.save_model(model, path, d.spark)
    loaded = models.load_or_default(path, d.spark)
    before = _sample_scores(model, samples, cvs, jobs).select(
        "application_id", F.col("match_probability").alias("p"))
    after = _sample_scores(loaded, samples, cvs, jobs).select(
        "application_id", "match_probability")
    same = F.count_if(F.abs(F.col("p") - F.col("match_probability")) < 1e-12)
    return before.join(after, "application_id").agg(
        F.count("*").alias("pairs"), same.alias("same_scores"))


@query
def tfidf_cosine(d: Inputs) -> DataFrame:
    samples, cvs, jobs = _parts(d)
    terms = written(MO.fit_shared(_fit_set(samples), cvs, jobs), "terms")
    sides = S.attach_sides(
        samples.select("application_id", "cv_id", "job_id"),
        MO.side_vectors(cvs, terms, "cv_id"), MO.side_vectors(jobs, terms, "job_id"))
    return sides.select("application_id", "cv_id", "job_id",
                        F.round(S.tfidf_similarity(), 6).alias("similarity"))


@query
def score_single_class(d: Inputs) -> DataFrame:
    samples, cvs, jobs = _training(d)
    model = MO.fit_model(samples.withColumn("label", F.lit(0)), cvs, jobs)
    scored = model.score(samples.select("application_id", "cv_id", "job_id"), cvs, jobs)
    return scored.select("application_id", "cv_id", "job_id", "class", _six("match_probability"),
                         _six("match_score"))


# --- evaluation -------------------------------------------------------------


def _metric_query(name: str) -> None:
    def run(d: Inputs) -> DataFrame:
        if name == "auc":
            return E.auc(d.scored).select(_six("auc"))
        return d.scored.agg(getattr(E, name)().alias(name)).select(_six(name))

    run.__name__ = f"eval_{name}"
    query(run)


for _name in ("accuracy", "precision", "recall", "f1", "auc"):
    _metric_query(_name)


@query
def eval_by_split(d: Inputs) -> DataFrame:
    """All metrics of each part of the split in one pass, over the scores of real pairs."""
    samples, cvs, jobs = _training(d)
    scored = S.score_unfitted(samples.select("application_id", "cv_id", "job_id", "label", "split"),
                              cvs, jobs)
    # rounded, so that ties do not hang on the last bit
    ready = scored.withColumn("match_probability", F.round("match_probability", 9)).withColumn(
        "class", S.similarity_class(F.col("match_probability")))
    return E.metrics(ready, ["split"]).select(
        "split", *[_six(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


# --- scoring and matching ---------------------------------------------------


def _pair_scores(d: Inputs) -> DataFrame:
    return M.score_pairs(d.pairs, d.cvs, d.jobs)


@query
def score_unfitted(d: Inputs) -> DataFrame:
    model = models.load_or_default(fresh_path(d.spark, "no-model"), d.spark)
    return M.score_pairs(d.pairs, d.cvs, d.jobs, model).select(
        "cv_id", "job_id", "class", _six("match_probability"), "error")


@query
def score_pairs(d: Inputs) -> DataFrame:
    return _pair_scores(d).select("cv_id", "job_id", _six("match_probability"),
                                  _six("match_score"), "error")


@query
def similarity(d: Inputs) -> DataFrame:
    return _pair_scores(d).select("cv_id", "job_id", _six("match_probability"))


@query
def logits(d: Inputs) -> DataFrame:
    both = _pair_scores(d).withColumn("logits", S.logits(F.col("match_probability")))
    return both.select("cv_id", "job_id", F.round(F.col("logits")[0], 6).alias("logit_0"),
                       F.round(F.col("logits")[1], 6).alias("logit_1"))


@query
def batch_summary(d: Inputs) -> DataFrame:
    return E.batch_summary(_pair_scores(d)).select("pairs", _six("mean_score"))


@query
def score_text(d: Inputs) -> DataFrame:
    return _pair_scores(d).select(
        "cv_id", "job_id", present.score_text(F.col("match_score")).alias("score_text"))


@query
def match_band(d: Inputs) -> DataFrame:
    score = F.col("match_score")
    return _pair_scores(d).select(
        "cv_id", "job_id", present.match_band(score).alias("band"),
        present.match_advice(score).alias("advice"))


@query
def compare_pair(d: Inputs) -> DataFrame:
    return M.compare_pair(_pair_scores(d))


@query
def rank_matches(d: Inputs) -> DataFrame:
    scored = _pair_scores(d).where("error IS NULL")
    ranked = RK.best_first(scored, ["job_id"], "cv_id", None)
    return ranked.select("job_id", "cv_id", _six("match_probability"), "rank")


def _matches(df: DataFrame) -> DataFrame:
    return df.select("cv_id", "job_id", _six("match_probability"), _six("match_score"), "rank")


@query
def topk_jobs_for_cv(d: Inputs) -> DataFrame:
    ids = A.ids_in_use(A.renamed(d.applications), "job_id")
    return _matches(M.match_jobs(ONE_CV, d.cvs, d.jobs, ids, k=10))


@query
def topk_cvs_for_job(d: Inputs) -> DataFrame:
    ids = A.ids_in_use(A.renamed(d.applications), "cv_id")
    return _matches(M.match_cvs(ONE_JOB, d.jobs, d.cvs, ids, k=10))


def _prepared(d: Inputs) -> tuple[str, str]:
    """Both corpora prepared: first without every seventh document, then brought up to date."""
    paths = []
    for corpus, key in ((d.cvs, "cv_id"), (d.jobs, "job_id")):
        path = fresh_path(d.spark, "prepared")
        prepared.refresh(corpus.where(F.crc32(F.encode(key, "utf-8")) % 7 != 0), path, key)
        prepared.refresh(corpus, path, key)
        paths.append(path)
    return paths[0], paths[1]


@query
def topk_jobs_prepared(d: Inputs) -> DataFrame:
    cvs, jobs = _prepared(d)
    ids = A.ids_in_use(A.renamed(d.applications), "job_id")
    return _matches(M.match_vectors(prepared.lookup(d.spark, cvs, [ONE_CV]), prepared.load(d.spark, jobs),
                                    "cv_id", "job_id", 10, ids))


@query
def topk_cvs_prepared(d: Inputs) -> DataFrame:
    cvs, jobs = _prepared(d)
    ids = A.ids_in_use(A.renamed(d.applications), "cv_id")
    return _matches(M.match_vectors(prepared.lookup(d.spark, jobs, [ONE_JOB]), prepared.load(d.spark, cvs),
                                    "job_id", "cv_id", 10, ids))


@query
def recommend_jobs(d: Inputs) -> DataFrame:
    return _matches(M.recommend_jobs(ONE_CV, d.cvs, d.jobs))


@query
def recommend_all(d: Inputs) -> DataFrame:
    return _matches(M.recommend_all(R.cv_records(d.cvs), R.job_records(d.jobs)))


@query
def recommend_all_single_class(d: Inputs) -> DataFrame:
    samples, cvs, jobs = _training(d)
    model = MO.fit_model(samples.withColumn("label", F.lit(0)), cvs, jobs)
    return _matches(M.recommend_all(cvs, jobs, model=model))


@query
def stream_recommend(d: Inputs) -> DataFrame:
    arriving, out, state = (fresh_path(d.spark, n) for n in ("arriving", "answers", "state"))
    d.cvs.write.parquet(arriving)
    running = stream.stream_recommend(
        stream.arriving_cvs(d.spark, arriving), R.job_records(d.jobs), out, state)
    running.awaitTermination()
    return _matches(stream.read_answers(d.spark, out))
