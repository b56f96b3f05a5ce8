"""Run folders: write, scan, compare, pick and rescore."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.catalog.base import PREDS, query, rnd, sql, tidy
from demandgrid.catalog.inputs import stacked_from, stacked_predictions
from demandgrid.catalog.model_queries import trained
from demandgrid.operators.metrics import (
    compare_submissions,
    model_comparison,
    submission_summary,
)
from demandgrid.plans.panel import as_long, retail_tables
from demandgrid.plans.runs import load_run_model, save_run_model, store_prediction_runs
from demandgrid.plans.training import direct_predictions, recursive_predictions
from demandgrid.session import scratch_path
from demandgrid.sources.runs import (
    best_per_type,
    latest_run,
    load_all_submissions,
    load_runs,
    load_submission_predictions,
    pick_best,
    preferred_runs,
    rank_runs,
    scan_submissions,
)
from demandgrid.sources.tables import load_tables, save_submission, write_table_csv

RMSLE = "sqrt(avg(pow(ln(1 + actual) - ln(1 + greatest({0}, 0)), 2)))"
# three runs: a naive full run, a seasonal naive full run and one of unknown scope
RUNS = f"""
subs AS (SELECT '20240101_naive' AS run, 'stats' AS model_type, 'full' AS scope, id, naive AS sales
           FROM preds
  UNION ALL SELECT '20240102_seasonal-naive', 'stats', 'full', id, predicted FROM preds
  UNION ALL SELECT '20240103_log-ridge', 'linear', NULL, id, (naive + predicted) / 2 FROM preds),
runs AS (SELECT run, model_type, scope, {RMSLE.format('s.sales')} AS val_rmsle, count(*) AS n
         FROM subs s JOIN preds USING (id) GROUP BY 1, 2, 3)"""


def _stored_runs(spark, folder):
    both = stacked_predictions(spark, folder)
    wide = both.groupBy("id", "actual").pivot("model", ["Naive", "SeasonalNaive"]).agg(
        F.first("predicted")
    )
    path = scratch_path(spark, "runs")
    store_prediction_runs(
        wide,
        path,
        {
            "20240101_naive": (F.col("Naive"), "stats", "full"),
            "20240102_seasonal-naive": (F.col("SeasonalNaive"), "stats", "full"),
            "20240103_log-ridge": (
                (F.col("Naive") + F.col("SeasonalNaive")) / 2, "linear", None,
            ),
        },
    )
    return path


@query(
    "run_registry_roundtrip",
    sql(
        f"""SELECT run, {rnd('val_rmsle', 'val_rmsle')}, n AS n_features, model_type,
        coalesce(scope, 'none') AS run_scope, true AS has_submission FROM runs""",
        PREDS,
        RUNS,
    ),
)
def _(spark, folder):
    runs = rank_runs(load_runs(spark, _stored_runs(spark, folder), "full"))
    return tidy(
        runs.drop("elapsed_seconds").withColumn("run_scope", F.coalesce("run_scope", F.lit("none")))
    )


@query(
    "best_run",
    sql(
        f"""SELECT run, {rnd('val_rmsle', 'val_rmsle')} FROM runs
        WHERE model_type = 'stats' ORDER BY runs.val_rmsle, run LIMIT 1""",
        PREDS,
        RUNS,
    ),
)
def _(spark, folder):
    runs = load_runs(spark, _stored_runs(spark, folder))
    return tidy(pick_best(runs, "full", "stats").select("run", "val_rmsle"))


@query(
    "best_per_type",
    sql(
        f"""SELECT model_type, arg_min(run, val_rmsle) AS run, {rnd('min(val_rmsle)', 'val_rmsle')}
        FROM runs GROUP BY 1""",
        PREDS,
        RUNS,
    ),
)
def _(spark, folder):
    runs = load_runs(spark, _stored_runs(spark, folder))
    return tidy(best_per_type(runs).select("model_type", "run", "val_rmsle"))


@query(
    "preferred_runs",
    sql(
        f"""SELECT run, {rnd('val_rmsle', 'val_rmsle')} FROM runs
        WHERE run LIKE '%log-ridge%' OR run = (SELECT arg_min(run, val_rmsle) FROM runs
          WHERE run LIKE '%naive%')""",
        PREDS,
        RUNS,
    ),
)
def _(spark, folder):
    runs = load_runs(spark, _stored_runs(spark, folder))
    return tidy(preferred_runs(runs, ["naive", "log-ridge"]).select("run", "val_rmsle"))


@query(
    "latest_run",
    sql("SELECT max(run) AS run FROM runs WHERE run LIKE '%naive'", PREDS, RUNS),
)
def _(spark, folder):
    runs = load_runs(spark, _stored_runs(spark, folder))
    return tidy(latest_run(runs, "naive").select("run"))


SUMMARY = """run, round(median(sales), 3) + 0.0 AS test_median, round(avg(sales), 1) + 0.0 AS test_mean,
  round(avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END) * 100, 1) + 0.0 AS pct_zero,
  round(avg(CASE WHEN sales < 1 THEN 1.0 ELSE 0.0 END) * 100, 1) + 0.0 AS pct_lt1"""


@query("submission_summary", sql(f"SELECT {SUMMARY} FROM subs GROUP BY run", PREDS, RUNS))
def _(spark, folder):
    subs = scan_submissions(spark, _stored_runs(spark, folder))
    return tidy(submission_summary(subs))


@query(
    "compare_submissions",
    sql(
        f"""SELECT s.*, r.model_type, {rnd('r.val_rmsle', 'val_rmsle')} FROM
        (SELECT {SUMMARY} FROM subs GROUP BY run) s JOIN runs r USING (run)""",
        PREDS,
        RUNS,
    ),
)
def _(spark, folder):
    path = _stored_runs(spark, folder)
    return tidy(compare_submissions(scan_submissions(spark, path), load_runs(spark, path)))


@query(
    "all_submissions",
    sql(
        """SELECT run, model_type, id, p.store_nbr, p.family, s.sales AS predicted, 'test' AS split
        FROM subs s JOIN preds p USING (id)""",
        PREDS,
        RUNS,
    ),
)
def _(spark, folder):
    test = retail_tables(spark, folder)["test"]
    out = load_all_submissions(spark, _stored_runs(spark, folder), test)
    return tidy(out.drop("actual", "date"), 3)


@query(
    "submission_predictions",
    sql(
        """SELECT run, model_type, id, s.sales AS predicted FROM subs s
        WHERE run = '20240101_naive'""",
        PREDS,
        RUNS,
    ),
)
def _(spark, folder):
    test = retail_tables(spark, folder)["test"]
    path = _stored_runs(spark, folder)
    out = load_submission_predictions(spark, path, "20240101_naive", test)
    return tidy(out.select("run", "model_type", "id", "predicted"))


@query(
    "table_bundle_roundtrip",
    sql(
        """SELECT 'train' AS name, count(*) AS n, sum(sales) AS total FROM train UNION ALL
        SELECT 'test', count(*), 0.0 FROM val UNION ALL
        SELECT 'stores', count(*), sum(r_regionkey) * 1.0 FROM region UNION ALL
        SELECT 'sample_submission', count(*), sum(predicted) FROM preds UNION ALL
        SELECT 'oil', 0, 0.0""",
        PREDS,
    ),
)
def _(spark, folder):
    """Tables written as CSV files and read back by name; the oil file is missing."""
    t = retail_tables(spark, folder)
    path = scratch_path(spark, "bundle")
    for name in ("train", "test", "stores"):
        write_table_csv(t[name], f"{path}/{name}.csv")
    preds = stacked_predictions(spark, folder, ["SeasonalNaive"])
    save_submission(preds, f"{path}/sample_submission.csv")
    back = load_tables(spark, path)
    parts = [
        back[n].agg(
            F.lit(n).alias("name"),
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(v).cast("double"), F.lit(0.0)).alias("total"),
        )
        for n, v in (
            ("train", F.col("sales")),
            ("test", F.lit(0)),
            ("stores", F.col("store_nbr")),
            ("sample_submission", F.col("sales")),
            ("oil", F.col("dcoilwtico")),
        )
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return tidy(out)


@query("saved_model_rescore")
def _(spark, folder):
    """A ridge run is stored, loaded again and scored; both predictions side by side."""
    run = trained(spark, folder, "ridge", "log1p")
    path = scratch_path(spark, "model")
    save_run_model(spark, run.model, path)
    again = direct_predictions(
        type(run)(load_run_model(spark, path), run.settings, run.features, run.label, run.val_days)
    )
    keys = ["store_nbr", "family", "date"]
    old = direct_predictions(run).select(*keys, F.col("predicted").alias("before"))
    both = again.filter("split <> 'train'").join(old, keys)
    return tidy(both.select(*keys, "split", "predicted", "before"), 4)


@query("model_metrics_table")
def _(spark, folder):
    """Recursive ridge next to the naive models on the same holdout."""
    run = trained(spark, folder, "ridge", "log1p")
    ridge = recursive_predictions(run).filter("split = 'val'")
    days = ridge.agg(F.min("date").alias("a")).scalar()
    panel = as_long(run.known.withColumn("id", F.lit(None).cast("bigint")))
    naive = stacked_from(panel).filter(F.col("date") >= days)
    cols = ["model", "actual", "predicted"]
    both = ridge.withColumn("model", F.lit("log-ridge")).select(*cols)
    return tidy(model_comparison(both.unionByName(naive.select(*cols))), 4)
