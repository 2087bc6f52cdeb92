import random

import pytest
from pyspark.sql import functions as F

from encaje.operators import applications as A
from encaje.operators import evaluate as E
from encaje.operators import ranking as RK
from encaje.sources import corpora, sinks


def test_labels(spark):
    rows = [("HIRED", 1), ("accepted", 1), ("Matched", 1), ("REJECTED", 0), ("Not_Matched", 0),
            ("PENDING", 0), ("otro", 0), (None, 0)]
    df = spark.createDataFrame(rows, "applicationStatus string, wanted int")
    assert A.add_label(df).where("label <> wanted").count() == 0
    assert "label" not in A.add_label(df.drop("applicationStatus")).columns
    number = df.select(F.lit(1).alias("applicationStatus"))
    assert A.add_label(number).first()["label"] == 0


@pytest.mark.parametrize("n, sizes", [(10, (8, 1, 1)), (399, (319, 39, 41)), (1, (0, 0, 1)),
                                      (20000, (16000, 2000, 2000))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id").cast("string").alias("key"))
    parts = A.split(df, "key")
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert tuple(counts.get(p, 0) for p in ("train", "validation", "test")) == sizes
    assert parts.select("key").distinct().count() == n


def test_split_is_the_ranking_by_hash(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"))
    rows = A.split(df, "key").withColumn("h", A.shuffle_key(42, "key")).orderBy("h", "key").collect()
    assert [r["split"] for r in rows] == ["train"] * 400 + ["validation"] * 50 + ["test"] * 50


def test_split_with_one_key_in_a_third_of_the_rows(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("key"))
    counts = {r["split"]: r["count"] for r in A.split(df, "key").groupBy("split").count().collect()}
    assert counts == {"train": 720, "validation": 90, "test": 90}


def test_sample(spark):
    df = spark.range(2500).select(F.col("id").cast("string").alias("k"))
    first = {r["k"] for r in A.sample_rows(df, "k", 1000).collect()}
    assert len(first) == 1000
    assert first == {r["k"] for r in A.sample_rows(df.repartition(7), "k", 1000).collect()}
    assert A.sample_rows(df, "k", None).count() == 2500
    assert A.sample_rows(df, "k", 5000).count() == 2500


def test_rank_all_with_a_hot_group_and_ties(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)
                                                      ).alias("g"),
        F.format_string("%05d", "id").alias("tie"),
        (F.floor(F.col("id") / 500) / 10).alias("match_probability"))
    got = RK.best_first(df, ["g"], "tie", None)
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append((-r["match_probability"], r["tie"]))
    wanted = {(g, tie): i + 1 for g, rows in groups.items()
              for i, (_, tie) in enumerate(sorted(rows))}
    assert {(r["g"], r["tie"]): r["rank"] for r in got.collect()} == wanted
    top = RK.best_first(df, ["g"], "tie", 2)
    assert {(r["g"], r["tie"]): r["rank"] for r in top.collect()} == {
        k: v for k, v in wanted.items() if v <= 2}
    assert RK.best_first(df, ["g"], "tie", 0).count() == 0


def auc_by_pairs(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics(spark):
    rows = [(i % 3 == 0, (i * 7 % 5) / 5) for i in range(60)]
    df = spark.createDataFrame([(int(y), int(p > 0.5), p) for y, p in rows],
                               "label int, class int, match_probability double")
    m = E.metrics(df).first()
    tp = sum(y and p > 0.5 for y, p in rows)
    predicted, actual = sum(p > 0.5 for _, p in rows), sum(y for y, _ in rows)
    assert m["auc"] == pytest.approx(auc_by_pairs(rows))
    assert m["precision"] == pytest.approx(tp / predicted)
    assert m["recall"] == pytest.approx(tp / actual)
    assert m["f1"] == pytest.approx(2 * tp / (predicted + actual))
    none = df.withColumn("class", F.lit(0)).withColumn("label", F.lit(0))
    m = E.metrics(none).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"], m["auc"]) == (1, 0, 0, 0, 0.5)


def test_files_and_pairs(spark, tmp_path):
    (tmp_path / "a.b.html").write_text("<p>ñ\nx</p>", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    jobs = corpora.read_jobs(spark, str(tmp_path), layout="files").collect()
    assert [(r["job_id"], r["html"]) for r in jobs] == [("a.b", "<p>ñ\nx</p>")]
    cvs = corpora.read_cvs(spark, str(tmp_path), layout="files").collect()
    assert [(r["cv_id"], r["raw_text"]) for r in cvs] == [("c", "no")]
    csv = tmp_path / "pairs.csv"
    csv.write_text("x,job_id,cv_id\n1,7,3\n")
    assert [tuple(r) for r in corpora.read_pairs(spark, str(csv)).collect()] == [("3", "7")]
    csv.write_text("job_id\n7\n")
    with pytest.raises(ValueError, match="cv_id"):
        corpora.read_pairs(spark, str(csv))


def test_pages_in_order(spark):
    df = spark.createDataFrame([("a", 2, "dos"), ("a", 10, "diez"), ("a", 1, "uno"), ("b", 1, None)],
                               "id string, page_no int, text string")
    out = {r["id"]: r["raw_text"] for r in corpora.concat_pages(df).collect()}
    assert out == {"a": "unodosdiez", "b": ""}


def test_predictions_round_trip(spark, tmp_path):
    rows = [("c", "j", 0.1 + 0.2, 30.000000000000004, 'an "error", quoted'), ("d", "k", 0.0, 0.0, None)]
    df = spark.createDataFrame(
        rows, "cv_id string, job_id string, match_probability double, match_score double, error string")
    sinks.write_predictions(df, str(tmp_path / "out"))
    back = sinks.read_predictions(spark, str(tmp_path / "out")).select(*df.columns).collect()
    assert sorted(tuple(r) for r in back) == sorted(rows)


def test_null_keys_keep_exact_shares_and_spread(spark):
    rows = [(None if i % 3 == 0 else f"a{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, n int")
    got = A.split(df, "id")
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"train": 2400, "validation": 300, "test": 300}
    shares = {r["split"]: r["count"] for r in got.where("id IS NULL").groupBy("split").count().collect()}
    assert 700 < shares["train"] < 900 and shares["test"] > 50
    assert sorted(got.columns) == ["id", "n", "split"]


@pytest.mark.parametrize("size", [0, 1, 1500, 3000, 9000])
def test_sample_of_any_size(spark, size):
    df = spark.createDataFrame([(None if i % 10 == 0 else f"a{i}", i) for i in range(3000)], "id string, n int")
    got = A.sample_rows(df, "id", size)
    assert got.columns == ["id", "n"] and got.count() == min(size, 3000) == got.distinct().count()
    assert sorted(map(str, got.collect())) == sorted(map(str, A.sample_rows(df, "id", size).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def brute_auc(rows):
    pos, neg = ([p for p, y in rows if y == k] for k in (1, 0))
    if not pos or not neg:
        return 0.5
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics_of_groups_in_one_pass(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(40) / 40 if g else 0.25, rng.randrange(2) if g != "one" else 1)
            for g in ("a", "b", "one", None) for _ in range(80)]
    df = spark.createDataFrame(rows, "part string, match_probability double, label int").repartition(5)
    df = df.withColumn("class", (F.col("match_probability") > 0.5).cast("int"))
    got = {r["part"]: r for r in E.metrics(df, ["part"]).collect()}
    assert set(got) == {"a", "b", "one", None}
    for g, r in got.items():
        mine = [(p, y) for part, p, y in rows if part == g]
        assert r["auc"] == pytest.approx(brute_auc(mine))
        assert r["accuracy"] == pytest.approx(sum((p > 0.5) == y for p, y in mine) / len(mine))
    whole = E.metrics(df).first()
    assert whole["auc"] == pytest.approx(brute_auc([(p, y) for _, p, y in rows]))
    assert E.auc(df.limit(0)).first()["auc"] == 0.5
