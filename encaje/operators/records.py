"""Candidate and posting records: cleaned text, sections or fields, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaje import lexicon
from encaje.functions import html as H
from encaje.functions import text as T

JOB_FIELDS = ["title", "company", "location", "description", "requirements",
              "responsibilities", "benefits", "skills", "experience", "education"]


def add_cv_sections(df: DataFrame, text: str = "raw_text",
                    sections: dict = lexicon.CV_SECTIONS,
                    word_boundary: bool = False) -> DataFrame:
    """Add a struct ``sections``; ``other`` holds the text that has none of them."""
    names = list(sections)
    found = df.withColumn("_s", F.struct(*[
        T.section(F.col(text), heads, stops, word_boundary).alias(name)
        for name, (heads, stops) in sections.items()]))
    empty = F.concat(*[F.col(f"_s.{n}") for n in names]) == ""
    return found.withColumn("sections", F.struct(
        *[F.col(f"_s.{n}").alias(n) for n in names],
        F.when(empty, F.col(text)).otherwise("").alias("other"))).drop("_s")


def keyword_list(text: Column, patterns: list[str]) -> Column:
    """Keywords of a section; null where the section is empty."""
    return F.when(text != "", T.find_all(text, patterns))


def cv_keywords(sections: str = "sections", patterns: dict = lexicon.CV_KEYWORDS) -> Column:
    """Struct of keyword lists by section; absent sections are null."""
    return F.struct(*[keyword_list(F.col(f"{sections}.{name}"), found).alias(name)
                      for name, found in patterns.items()])


def cv_weighted_text(sections: str = "sections", keywords: str = "keywords") -> Column:
    return T.weighted(
        [(F.col(f"{sections}.{name}"), times) for name, times in lexicon.CV_WEIGHTS],
        [F.col(f"{keywords}.{name}") for name in lexicon.CV_KEYWORDS])


def cv_records(cvs: DataFrame) -> DataFrame:
    """``cv_id, text, raw_text, sections, keywords, success`` for every row read.

    Unreadable text (null) counts as empty text; only a missing row is a failure.
    """
    cleaned = cvs.select("cv_id", T.clean(F.coalesce("raw_text", F.lit(""))).alias("raw_text"))
    return (add_cv_sections(cleaned)
            .withColumn("keywords", cv_keywords())
            .select("cv_id", cv_weighted_text().alias("text"), "raw_text", "sections",
                    "keywords", F.lit(True).alias("success")))


def job_tokens(jobs: DataFrame) -> DataFrame:
    """``job_id, tokens, full_text``."""
    return (jobs.select("job_id", H.html_tokens(F.coalesce("html", F.lit(""))).alias("tokens"))
            .withColumn("full_text", H.text_of(F.col("tokens"))))


def job_field_by_text(name: str, text: Column) -> Column:
    """One of the first seven fields, read from the text of the page."""
    if name in lexicon.JOB_LINES:
        return T.first_of(text, lexicon.JOB_LINES[name])
    return T.section(text, *lexicon.JOB_SECTIONS[name])


def found_job_fields(jobs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``job_id, full_text`` and the named fields: markup first, else the text."""
    names = names or list(lexicon.JOB_ELEMENTS)
    wanted = [lexicon.JOB_ELEMENTS[n] for n in names]
    marked = job_tokens(jobs).select(
        "job_id", "full_text", H.element_texts(F.col("tokens"), wanted).alias("_marked"))
    return marked.select("job_id", "full_text", *[
        F.coalesce(F.get("_marked", F.lit(i)), job_field_by_text(n, F.col("full_text"))).alias(n)
        for i, n in enumerate(names)])


def raw_job_fields(jobs: DataFrame) -> DataFrame:
    """``job_id`` and the eleven fields as found, not yet cleaned."""
    phrases = T.find_all(F.col("requirements"), [lexicon.JOB_SKILL_PHRASE])
    return found_job_fields(jobs).select(
        "job_id", *lexicon.JOB_ELEMENTS,
        F.array_join(phrases, " ").alias("skills"),
        T.first_match(F.col("full_text"), lexicon.JOB_EXPERIENCE).alias("experience"),
        T.first_match(F.col("full_text"), lexicon.JOB_EDUCATION).alias("education"),
        "full_text")


def clean_job_fields(raw: DataFrame) -> DataFrame:
    """Clean every field but ``full_text``, whose cleaned form is ``raw_text``."""
    return raw.select("job_id", *[T.clean(F.col(n)).alias(n) for n in JOB_FIELDS],
                      "full_text", T.clean(F.col("full_text")).alias("raw_text"))


def job_skill_keywords(requirements: Column, description: Column, skills: Column) -> Column:
    """Distinct skill words of the three fields, in order."""
    patterns = [*lexicon.JOB_SKILL_PATTERNS, lexicon.TECHNOLOGIES]
    found = F.concat(T.find_all(requirements, patterns), T.find_all(description, patterns),
                     T.find_all(skills, [lexicon.TOKEN]))
    return F.sort_array(F.array_distinct(found))


def job_keywords(fields: str = "fields") -> Column:
    """Struct of keyword lists; only ``skills`` is never null."""
    def f(name: str) -> Column:
        return F.col(f"{fields}.{name}" if fields else name)

    return F.struct(
        keyword_list(f("title"), [lexicon.TOKEN]).alias("title"),
        job_skill_keywords(f("requirements"), f("description"), f("skills")).alias("skills"),
        keyword_list(f("experience"), [lexicon.JOB_YEARS]).alias("experience"),
        keyword_list(f("education"), [lexicon.JOB_DEGREE]).alias("education"))


def job_weighted_text(fields: str = "fields", keywords: str = "keywords") -> Column:
    return T.weighted(
        [(F.col(f"{fields}.{name}"), times) for name, times in lexicon.JOB_WEIGHTS],
        [F.col(f"{keywords}.{name}") for name in ("title", "skills", "experience", "education")])


def job_records(jobs: DataFrame) -> DataFrame:
    """``job_id, text, raw_text, fields, keywords, success`` for every row read."""
    cleaned = clean_job_fields(raw_job_fields(jobs)).select(
        "job_id", "raw_text",
        F.struct(*JOB_FIELDS, "full_text").alias("fields"))
    return (cleaned.withColumn("keywords", job_keywords())
            .select("job_id", job_weighted_text().alias("text"), "raw_text", "fields",
                    "keywords", F.lit(True).alias("success")))


def process_counts(status: DataFrame, what: str) -> DataFrame:
    """Successes and total of a record or status table, as one row."""
    return status.agg(
        F.count_if("success").alias("succeeded"), F.count("*").alias("total")
    ).select(F.lit(what).alias("corpus"), "succeeded", "total")


def process_summary(ids: DataFrame, records: DataFrame, id_column: str, what: str) -> DataFrame:
    """Successes and total of the requested ids, records with text and their characters, as one row."""
    found = ids.select(id_column).join(records.select(id_column, "text", "success"), id_column, "left")
    return found.agg(
        F.count_if("success").alias("succeeded"), F.count("*").alias("total"),
        F.count_if(F.col("text") != "").alias("with_text"),
        F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("text_chars"),
    ).select(F.lit(what).alias("corpus"), "succeeded", "total", "with_text", "text_chars")
