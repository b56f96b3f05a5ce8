import json
import shutil

import pytest
from pyspark.sql import functions as F

from demandgrid.sources.runs import (
    MODEL_FOLDER,
    best_per_type,
    discover_runs,
    latest_run,
    load_all_submissions,
    load_runs,
    load_submission_predictions,
    pick_best,
    preferred_runs,
    rank_runs,
    scan_submissions,
)
from demandgrid.sources.tables import load_tables, save_submission


@pytest.fixture
def runs(tmp_path):
    def add(name, rmsle, kind, scope=None, sub=True, features="12", metrics=True):
        d = tmp_path / name
        d.mkdir()
        if metrics:
            body = {"metrics": {"val_rmsle": rmsle} if rmsle is not None else {},
                    "params": {"model_type": kind, "n_features": features},
                    "elapsed_seconds": 1.5}
            if scope:
                body["params"]["run_scope"] = scope
            (d / "metrics.json").write_text(json.dumps(body, indent=2))
        if sub:
            (d / "submission.csv").write_text("id,sales\n1,0.0\n2,4.5\n")

    add("20240101_log-ridge", 0.5, "linear", "full")
    add("20240102_log-ridge+fourier", 0.4, "linear", "full")
    add("20240103_boosted", 0.3, "trees", "smoke", features="many")
    add("20240104_open", 0.6, "trees")
    add("20240105_nosub", 0.1, "trees", "full", sub=False)
    add("20240106_unscored", None, "trees", "full")
    add("20240107_broken", 0.2, "trees", "full", metrics=False)
    return str(tmp_path)


def test_scope_filter_passes_unscoped_runs(spark, runs):
    rows = load_runs(spark, runs)
    assert rows.count() == 6
    scoped = {r["run"] for r in load_runs(spark, runs, "full").collect()}
    assert "20240104_open" in scoped and "20240103_boosted" not in scoped
    by = {r["run"]: r for r in rows.collect()}
    assert by["20240103_boosted"]["n_features"] is None
    assert by["20240101_log-ridge"]["n_features"] == 12
    assert not by["20240105_nosub"]["has_submission"]


def test_board_order_and_choice(spark, runs):
    rows = load_runs(spark, runs)
    names = [r["run"] for r in rank_runs(rows).collect()]
    assert names[0] == "20240105_nosub" and names[-1] == "20240106_unscored"
    assert pick_best(rows, "full").head()["run"] == "20240102_log-ridge+fourier"
    assert pick_best(rows, "full", "trees").head()["run"] == "20240104_open"
    types = {r["model_type"]: r["run"] for r in best_per_type(rows).collect()}
    assert types == {"linear": "20240102_log-ridge+fourier", "trees": "20240105_nosub"}


def test_preferred_patterns(spark, runs):
    rows = load_runs(spark, runs)
    pick = lambda p: [r["run"] for r in preferred_runs(rows, p).collect()]
    assert pick(["log-ridge", "boosted"]) == ["20240101_log-ridge", "20240103_boosted"]
    assert pick(["fourier", "log-ridge"])[0] == "20240102_log-ridge+fourier"
    assert pick(["nothing"]) == [r["run"] for r in best_per_type(rows).collect()]


def test_latest_finished_run(spark, runs):
    rows = load_runs(spark, runs)
    assert latest_run(rows, "boosted").head()["run"] == "20240103_boosted"
    assert latest_run(rows, "nosub").head() is None


def test_submissions_meet_test_rows(spark, runs):
    test = spark.createDataFrame(
        [(1, "2017-01-01", 1, "A"), (3, "2017-01-01", 2, "A")],
        "id bigint, date string, store_nbr bigint, family string",
    )
    out = load_all_submissions(spark, runs, test)
    assert out.count() == 12  # six runs with a submission, two rows each
    row = out.filter("run = '20240103_boosted' and id = 3").head()
    assert row["predicted"] is None and row["model_type"] == "trees" and row["split"] == "test"
    assert out.filter("run like '%broken' and model_type <> '?'").count() == 0


def test_one_run_reads_its_own_files(spark, runs):
    test = spark.createDataFrame(
        [(1, "2017-01-01", 1, "A"), (3, "2017-01-01", 2, "A")],
        "id bigint, date string, store_nbr bigint, family string",
    )
    every = load_all_submissions(spark, runs, test)
    for name in ("20240102_log-ridge+fourier", "20240107_broken", "20240105_nosub", "2024010*"):
        got = load_submission_predictions(spark, runs, name, test)
        want = every.filter(F.col("run") == name)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    files = scan_submissions(spark, runs, "20240103_boosted").inputFiles()
    assert len(files) == 1 and files[0].endswith("20240103_boosted/submission.csv")


def test_discovery_wants_score_scope_and_model(spark, runs, tmp_path):
    assert discover_runs(spark, runs).count() == 0
    facts = spark.createDataFrame([("kind", 0, "linear"), ("weight", 0, "1")], "part string, place int, value string")
    shutil.copytree(tmp_path / "20240103_boosted", tmp_path / "sandbox")
    for run in tmp_path.iterdir():
        if not run.name.startswith("20240101"):
            facts.write.parquet(f"{run}/{MODEL_FOLDER}/encoding")
    names = lambda **kw: [r["run"] for r in discover_runs(spark, runs, **kw).collect()]
    assert names() == ["20240105_nosub", "20240102_log-ridge+fourier"]
    assert names(patterns=["open", "log-ridge"]) == ["20240104_open"]
    assert names(scope="smoke") == ["20240103_boosted"]
    assert names(scope=None, patterns=["boosted"]) == ["20240103_boosted"]


def test_no_runs(spark, tmp_path):
    empty = str(tmp_path / "none")
    assert load_runs(spark, empty).count() == 0
    assert scan_submissions(spark, empty).count() == 0


def test_table_bundle(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        "date,id,store_nbr,family,sales,onpromotion\n2017-01-01,5,1,A,NaN,2\n"
    )
    t = load_tables(spark, str(tmp_path))
    row = t["train"].head()
    assert (row["id"], row["sales"], str(row["date"])) == (5, None, "2017-01-01")
    assert t["oil"].count() == 0 and t["oil"].columns == ["date", "dcoilwtico"]


def test_submission_pairs_by_row(spark, tmp_path):
    preds = spark.createDataFrame([(2, 1.5), (1, 0.5)], "id bigint, predicted double")
    save_submission(preds, str(tmp_path / "sub"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sub"))
    assert {tuple(r) for r in back.collect()} == {("2", "1.5"), ("1", "0.5")}
    assert back.agg(F.count("*")).head()[0] == 2
