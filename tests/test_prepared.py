"""A prepared corpus against records made from the raw one."""

import os

import pytest
from pyspark.sql import functions as F

from encaje.operators import matching as M
from encaje.operators import records
from encaje.operators.scoring import word_vectors
from encaje.sources import prepared

COLUMNS = ["cv_id", "text", "square"]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "cv_id string, raw_text string")


def rows_of(df):
    return sorted(map(repr, df.select(*COLUMNS, F.to_json("terms")).collect()))


def wanted(df):
    recs = records.cv_records(df.where("cv_id IS NOT NULL"))
    return word_vectors(recs, "cv_id").join(recs.select("cv_id", "text"), "cv_id").dropDuplicates(COLUMNS)


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "cvs")
    rows = [(f"c{i}", f"EXPERIENCIA python sql nivel{i} HABILIDADES spark {i % 3}") for i in range(40)]
    assert prepared.refresh(corpus(spark, rows + [("e", None), (None, "lost")]), path, "cv_id", 8) == 41
    return path


def folders(path):
    return {v: set(os.listdir(f"{path}/data/{v}")) for v in os.listdir(f"{path}/data")}


def test_refresh_touches_changed_buckets_only(spark, path):
    rows = [(f"c{i}", f"EXPERIENCIA python sql nivel{i} HABILIDADES spark {i % 3}") for i in range(40)]
    before = folders(path)
    assert prepared.refresh(corpus(spark, rows + [("e", None)]), path, "cv_id") == 0
    assert folders(path) == before
    rows[3] = ("c3", "PERFIL java")
    now = corpus(spark, rows[:39] + [("e", None), ("new|1", "sql")])  # one changed, one gone, one new
    assert prepared.refresh(now, path, "cv_id") == 3
    added = set(folders(path)) - set(before)
    assert len(added) == 1 and len([b for b in folders(path)[added.pop()] if b.startswith("bucket")]) <= 3
    assert rows_of(prepared.load(spark, path)) == rows_of(wanted(now))
    found = prepared.lookup(spark, path, ["c3", "c39", "c5", None])
    assert {r["cv_id"] for r in found.collect()} == {"c3", "c5"}
    assert len(found.inputFiles()) <= 3


def test_a_broken_refresh_changes_nothing(spark, path):
    before = rows_of(prepared.load(spark, path))

    def broken(_):
        raise OSError("disk full")

    with pytest.raises(OSError):
        prepared.refresh(corpus(spark, [("c1", "other")]), path, "cv_id", make=broken)
    assert rows_of(prepared.load(spark, path)) == before
    with pytest.raises(ValueError):
        prepared.load(spark, path + "-none")


def test_matches_from_prepared_vectors_equal_those_from_texts(spark, path, tmp_path):
    jobs = spark.createDataFrame([(f"j{i}", f"<p>Puesto: uno. Requisitos python {'sql' * (i % 2)} nivel{i}</p>")
                                  for i in range(12)], "job_id string, html string")
    prepared.refresh(jobs, str(tmp_path / "jobs"), "job_id", 4)
    cvs = corpus(spark, [("c7", "EXPERIENCIA python sql nivel7 HABILIDADES spark 1")])
    want = M.match_jobs("c7", cvs, jobs, k=5)
    got = M.match_vectors(prepared.lookup(spark, path, ["c7"]),
                          prepared.load(spark, str(tmp_path / "jobs")), "cv_id", "job_id", 5)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    some = M.match_vectors(prepared.lookup(spark, path, ["c7"]),
                           prepared.load(spark, str(tmp_path / "jobs")), "cv_id", "job_id", None, ["j3", "j1"])
    assert {r["job_id"] for r in some.collect()} == {"j1", "j3"}


def test_old_rows_go_with_one_move_of_the_rows(spark):
    """Rows hold texts: beside the small touched ids, only one exchange by bucket is planned."""
    kind = "cv_id string, digest string, text string, terms array<struct<term:string,n:bigint>>, square bigint"
    fresh = spark.createDataFrame([("a", "2", "new", [], 0), ("a", "2", "new", [], 0)], kind)
    stored = spark.createDataFrame([("a", "1", "old", [], 0), ("b", "1", "kept", [], 0), ("b", "1", "kept", [], 0),
                                    ("c", "1", "gone", [], 0)], kind)
    touched = spark.createDataFrame([("a", 0), ("c", 0)], "cv_id string, bucket int")
    rows = prepared._without_old(fresh, stored, touched, "cv_id", 8)
    assert sorted((r["cv_id"], r["text"]) for r in rows.collect()) == [
        ("a", "new"), ("a", "new"), ("b", "kept"), ("b", "kept")]
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
