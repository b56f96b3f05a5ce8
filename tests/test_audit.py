import pytest
from pyspark.sql import functions as F

from demandgrid.operators.audit import (
    bias_sign_flip,
    bootstrap_rmsle,
    enrich_holdout,
    error_tree_leaves,
    high_error_rows,
    multiaccuracy_audit,
    paired_bootstrap,
    residual_clusters,
)
from demandgrid.operators.metrics import (
    global_rmsle,
    relative_improvement,
    series_scores,
    shift_summary,
    slice_scores,
    velocity_tiers,
)
from demandgrid.plans.training import audit_run, audit_summary
from demandgrid.session import scratch_path


@pytest.fixture
def frame(audit_preds, audit_history):
    return enrich_holdout(audit_preds, audit_history, velocity_tiers(audit_history))


def test_enriched_rows_keep_their_number(frame, audit_preds):
    assert frame.count() == audit_preds.count() == 45
    row = frame.head()
    assert row["velocity_tier"] and row["abs_log_err"] == abs(row["log_resid"])


def test_unmatched_metadata_gets_defaults(audit_preds, audit_history):
    none = audit_history.filter("false")
    row = enrich_holdout(audit_preds, none, velocity_tiers(none)).head()
    assert (row["onpromotion"], row["velocity_tier"], row["velocity_mean"]) == (0, "mid", 0.0)


def test_bias_flips_between_tiers(frame):
    slices = slice_scores(frame)
    bias = {r["slice"]: r["bias_pct"] for r in slices.filter("axis = 'velocity_tier'").collect()}
    assert bias["slow"] > 0 > bias["fast"]
    assert bias_sign_flip(slices).head()[0] is True


def test_interval_holds_the_point(frame):
    got = bootstrap_rmsle(frame, 200).head()
    assert got["val_rmsle_ci_low"] <= got["val_rmsle"] <= got["val_rmsle_ci_high"]
    assert (got["n_series"], got["n_boot"]) == (9, 200)
    assert got["val_rmsle"] == pytest.approx(global_rmsle(frame).head()[0])


def test_bootstrap_of_nothing(frame):
    got = bootstrap_rmsle(frame.filter("false"), 10).head()
    assert got["val_rmsle"] is None and (got["n_series"], got["n_boot"]) == (0, 0)


def test_paired_delta_prefers_the_perfect_model(frame):
    perfect = frame.withColumn("predicted", F.col("actual"))
    got = paired_bootstrap(frame, perfect, 200).head()
    assert got["delta_rmsle"] > 0 and got["p_a_worse"] == 1.0
    same = paired_bootstrap(frame, frame, 50).head()
    assert (same["delta_ci_low"], same["delta_ci_high"]) == (0.0, 0.0)
    none = paired_bootstrap(frame, frame.filter("false"), 50).head()
    assert none["delta_rmsle"] is None and none["n_series"] == 0


def test_draws_follow_the_seed(frame):
    a, b, c = (bootstrap_rmsle(frame, 100, s).head()[2] for s in (1, 1, 2))
    assert a == b != c


def test_tree_finds_the_bad_leaf(frame):
    rows = error_tree_leaves(frame, min_leaf=5).collect()
    errors = [r["mean_abs_log_err"] for r in rows]
    assert errors == sorted(errors, reverse=True) and errors[0] > 0.2
    assert "velocity_mean" in rows[0]["rules"] or "store_nbr" in rows[0]["rules"]
    assert error_tree_leaves(frame, min_leaf=500).count() == 0


def test_multiaccuracy_sees_structure(frame):
    rows = multiaccuracy_audit(frame).collect()
    assert rows[0]["r2"] > 0.3
    assert (rows[0]["n_train"], rows[0]["n_val"]) == (34, 11)
    sizes = [abs(r["coef"]) for r in rows]
    assert sizes == sorted(sizes, reverse=True)
    few = multiaccuracy_audit(frame.limit(10)).head()
    assert few["r2"] is None and few["n_train"] == 0


def test_clusters_cover_the_worst_rows(frame):
    high = high_error_rows(frame, 0.5)
    assert 22 <= high.count() < 45
    rows = residual_clusters(frame, top_share=0.5, k=2, starts=2).collect()
    assert sum(r["n"] for r in rows) == high.count()
    assert all(abs(sum(r["type_mix"].values()) - 1) < 0.01 for r in rows)
    assert residual_clusters(frame.limit(5), k=5).count() == 0


def test_equal_mixes_do_not_diverge(audit_history):
    half = audit_history.withColumn("sales", F.col("sales") * 2)
    got = {r["period"]: r for r in shift_summary(audit_history, half, half.drop("sales")).collect()}
    assert got["val"]["js_from_train"] == pytest.approx(0, abs=1e-9)
    assert got["test"]["js_from_train"] > 0 and got["test"]["family_mix_entropy"] == 0
    assert got["train"]["n_rows"] == 270


def test_improvement_needs_a_reference_error(frame):
    perfect = series_scores(frame.withColumn("predicted", F.col("actual")))
    gains = relative_improvement(perfect, series_scores(frame))
    assert gains.filter("improvement_pct is not null").count() == 0


def test_whole_audit_writes_its_files(spark, audit_preds, audit_history):
    folder = scratch_path(spark, "audit-test")
    parts = audit_run(
        audit_preds, audit_history, audit_history, audit_history.drop("sales"),
        other=audit_preds.withColumn("predicted", F.col("actual")), n_boot=50, val_days=5,
        folder=folder,
    )
    assert {r["section"] for r in audit_summary(parts).collect()} >= {
        "metrics", "bootstrap", "paired", "sign_flip", "shift_train", "shift_test",
    }
    assert spark.read.json(f"{folder}/audit_summary.json").count() > 20
    assert spark.read.option("header", True).csv(f"{folder}/audit_slices.csv").count() > 5
