"""Error-analysis and metric queries over the predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rainweave.operators import errors, metrics
from rainweave.operators.partitioned import row_position
from rainweave.operators.traininglog import analyse_training, summarise_training
from rainweave.plans.common import rounded
from rainweave.plans.registry import query
from rainweave.plans.sampling import ROLE_SQL, station_roles
from rainweave.session import checkpoint_folder
from rainweave.sources import sinks, views

_ERRORS_SQL = """,
e as (select fold, station_id, avg(abs(true_value - pred_value)) as mean_abs_error,
             quantile_cont(abs(true_value - pred_value), 0.5) as median_abs_error,
             max(abs(true_value - pred_value)) as max_abs_error, stddev_samp(abs(true_value - pred_value)) as std_abs_error,
             avg(true_value) as mean_true, avg(pred_value) as mean_pred, avg(pred_value) - avg(true_value) as bias
      from predictions group by fold, station_id)"""
_ACROSS_SQL = _ERRORS_SQL + """,
x as (select station_id, avg(mean_abs_error) as mean_of_mean, avg(median_abs_error) as mean_of_median,
             max(max_abs_error) as max_of_max, avg(std_abs_error) as mean_of_std, avg(bias) as mean_of_bias, count(*) as folds
      from e group by station_id)"""


def fold_errors(spark, folder):
    return errors.station_errors(views.predictions(spark, folder))


def _round_all(df, names):
    return df.withColumns({n: rounded(F.col(n)) for n in names})


@query(
    "a15_station_errors",
    views.with_views("predictions") + _ERRORS_SQL + """
select fold, station_id, round(mean_abs_error, 6) as mean_abs_error, round(median_abs_error, 6) as median_abs_error,
       round(max_abs_error, 6) as max_abs_error, round(std_abs_error, 6) as std_abs_error, round(mean_true, 6) as mean_true,
       round(mean_pred, 6) as mean_pred, round(bias, 6) as bias from e""",
)
def a15_station_errors(spark, folder):
    df = fold_errors(spark, folder)
    return _round_all(df, [c for c in df.columns if c not in ("fold", "station_id")])


@query(
    "a16_errors_across_folds",
    views.with_views("predictions") + _ACROSS_SQL + """
select station_id, round(mean_of_mean, 6) as mean_of_mean, round(mean_of_median, 6) as mean_of_median,
       round(max_of_max, 6) as max_of_max, round(mean_of_std, 6) as mean_of_std, round(mean_of_bias, 6) as mean_of_bias, folds
from x""",
)
def a16_errors_across_folds(spark, folder):
    df = errors.across_folds(fold_errors(spark, folder))
    return _round_all(df, [c for c in df.columns if c not in ("folds", "station_id")])


@query(
    "a17_high_error_flag",
    views.with_views("predictions") + _ERRORS_SQL + """
select fold, station_id, max_abs_error >= (select quantile_cont(max_abs_error, 0.75) from e) as is_high from e""",
)
def a17_high_error_flag(spark, folder):
    return errors.flag_high(fold_errors(spark, folder), "max_abs_error").select("fold", "station_id", "is_high")


@query(
    "a18_error_tertiles",
    views.with_views("predictions") + _ERRORS_SQL + """,
r as (select fold, station_id, round(mean_abs_error, 6) as m from e)
select fold, station_id, case when m <= (select quantile_cont(m, 0.33) from r) then 'Low'
       when m <= (select quantile_cont(m, 0.67) from r) then 'Medium' else 'High' end as error_class
from r""",
)
def a18_error_tertiles(spark, folder):
    rows = fold_errors(spark, folder).select("fold", "station_id", rounded(F.col("mean_abs_error")).alias("m"))
    return errors.error_tertiles(rows, "m").select("fold", "station_id", "error_class")


@query(
    "a19_bias_class",
    views.with_views("predictions") + _ERRORS_SQL + """
select fold, station_id, case when bias > 1 then 'over' when bias < -1 then 'under' else 'neutral' end as bias_class,
       abs(bias) > 2 as is_extreme from e""",
)
def a19_bias_class(spark, folder):
    return fold_errors(spark, folder).select(
        "fold", "station_id", errors.bias_class(F.col("bias")).alias("bias_class"),
        errors.is_extreme_bias(F.col("bias")).alias("is_extreme"),
    )


@query(
    "a20_cluster_errors",
    views.with_views("predictions") + _ERRORS_SQL + """
select s_nationkey as cluster, round(avg(mean_abs_error), 3) as mean_error, round(max(mean_abs_error), 3) as max_error,
       round(avg(bias), 3) as mean_bias, count(*) as stations
from e join supplier on s_suppkey = station_id group by s_nationkey""",
)
def a20_cluster_errors(spark, folder):
    """Errors by cluster label; the label comes from a dimension join."""
    labels = views.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("cluster")
    )
    return errors.cluster_errors(fold_errors(spark, folder).join(labels, "station_id"))


@query(
    "a21_error_summary",
    views.with_views("predictions") + """
select round(avg(x), 6) as mean, round(quantile_cont(x, 0.5), 6) as median, max(x) as max, round(stddev_samp(x), 6) as std
from (select round(abs(true_value - pred_value), 6) as x from predictions)""",
)
def a21_error_summary(spark, folder):
    rows = errors.with_errors(views.predictions(spark, folder)).select(rounded(F.col("abs_error")).alias("x"))
    described = errors.describe(rows, "x")
    return described.select(
        rounded(F.col("mean")).alias("mean"), rounded(F.col("q50")).alias("median"), "max", rounded(F.col("std")).alias("std")
    )


@query(
    "a22_false_zeros",
    views.with_views("predictions") + """
select fold, station_id, station_type, timestep, sub, true_value, round(pred_value, 6) as pred_value
from predictions where true_value > 0 and pred_value between 0 and 2""",
)
def a22_false_zeros(spark, folder):
    rows = errors.with_errors(views.predictions(spark, folder)).where("is_false_zero")
    return rows.select(
        "fold", "station_id", "station_type", "timestep", "sub", "true_value", rounded(F.col("pred_value")).alias("pred_value")
    )


@query(
    "t2_worst_stations",
    views.with_views("predictions") + _ACROSS_SQL + """
select station_id, round(mean_of_mean, 6) as mean_of_mean from x order by round(mean_of_mean, 6) desc, station_id limit 10""",
)
def t2_worst_stations(spark, folder):
    table = a16_errors_across_folds(spark, folder)
    return errors.worst(table, F.col("mean_of_mean"), "station_id", 10).select("station_id", "mean_of_mean")


@query(
    "t2_worst_per_fold",
    views.with_views("predictions") + _ERRORS_SQL + """
select * from (select fold, station_id, round(abs(bias), 6) as size,
               cast(row_number() over (partition by fold order by round(abs(bias), 6) desc, station_id) as int) as rank from e)
where rank <= 2""",
)
def t2_worst_per_fold(spark, folder):
    rows = fold_errors(spark, folder).select("fold", "station_id", rounded(F.abs("bias")).alias("size"))
    return errors.worst_per_key(rows, ["fold"], F.col("size"), "station_id", 2)


@query(
    "u1_union_of_folds",
    views.with_views("predictions") + """
select fold, station_id, count(*) as n from predictions group by fold, station_id""",
)
def u1_union_of_folds(spark, folder):
    """The tables of all folds as one, the fold as a column: one scan, whatever folds the data hold."""
    return views.predictions(spark, folder).groupBy(F.col("fold").cast("long").alias("fold"), "station_id").agg(F.count(F.lit(1)).alias("n"))


# a missing truth for every first sub-row gives timesteps without any truth
_SCORED_SQL = """,
p as (select timestep, station_type, fold, station_id, sub, case when sub <> 1 then true_value end as truth, pred_value from predictions)"""


def _scored(spark, folder):
    return views.predictions(spark, folder).withColumn("truth", F.when(F.col("sub") != 1, F.col("true_value")))


@query(
    "m1_average_rmse",
    views.with_views("predictions") + _SCORED_SQL + """,
t as (select timestep, avg((truth - pred_value) ** 2) as mse from p group by timestep)
select count(*) as times, count(mse) as valid_times, round(sum(sqrt(mse)) / count(*), 6) as rmse_all,
       round(sum(sqrt(mse)) / count(mse), 6) as rmse_valid, round(sum(mse) / count(*), 6) as mse_all from t""",
)
def m1_average_rmse(spark, folder):
    df = metrics.average_rmse(_scored(spark, folder), ["timestep"], "truth", "pred_value")
    return _round_all(df, ["rmse_all", "rmse_valid", "mse_all"])


@query(
    "m2_rmse_per_fold",
    views.with_views("predictions") + _SCORED_SQL + """,
t as (select fold, timestep, avg((truth - pred_value) ** 2) as mse from p group by fold, timestep)
select fold, count(*) as times, count(mse) as valid_times, round(sum(sqrt(mse)) / count(*), 6) as rmse_all,
       round(sum(sqrt(mse)) / count(mse), 6) as rmse_valid, round(sum(mse) / count(*), 6) as mse_all from t group by fold""",
)
def m2_rmse_per_fold(spark, folder):
    df = metrics.average_rmse(_scored(spark, folder), ["timestep"], "truth", "pred_value", ["fold"])
    return _round_all(df, ["rmse_all", "rmse_valid", "mse_all"])


@query(
    "m3_pearson",
    views.with_views("predictions") + _SCORED_SQL + """
select station_type, round(corr(truth, pred_value), 6) as pearson, count(*) as n from p where truth is not null group by station_type""",
)
def m3_pearson(spark, folder):
    return _round_all(metrics.pearson(_scored(spark, folder), "truth", "pred_value", ["station_type"]), ["pearson"])


@query(
    "m4_spearman",
    views.with_views("predictions") + _SCORED_SQL + """,
v as (select truth, round(pred_value, 6) as pred from p where truth is not null),
r as (select rank() over (order by truth) + (count(*) over (partition by truth) - 1) / 2e0 as rt,
             rank() over (order by pred) + (count(*) over (partition by pred) - 1) / 2e0 as rp from v)
select round(corr(rt, rp), 6) as spearman, count(*) as n from r""",
)
def m4_spearman(spark, folder):
    rows = _scored(spark, folder).select("truth", rounded(F.col("pred_value")).alias("pred"))
    return _round_all(metrics.spearman(rows, "truth", "pred"), ["spearman"])


@query(
    "m5_test_rmse",
    views.with_views("predictions", "stations") + ROLE_SQL + """,
t as (select statistical_role as role, timestep, sqrt(avg((true_value - pred_value) ** 2)) as rmse
      from predictions join roles on roles.gid = station_id group by all)
select role, count(*) as times, round(avg(rmse), 6) as rmse from t group by role""",
)
def m5_test_rmse(spark, folder):
    """Mean over timesteps of the RMSE over the stations of a role, both types pooled."""
    roles = station_roles(spark, folder).select(F.col("gid").alias("station_id"), F.col("statistical_role").alias("role"))
    rows = views.predictions(spark, folder).join(roles, "station_id")
    scored = metrics.average_rmse(rows, ["timestep"], "true_value", "pred_value", ["role"])
    return scored.select("role", "times", rounded(F.col("rmse_valid")).alias("rmse"))


_BATCH_SQL = """,
n as (select timestep, (row_number() over (order by timestep) - 1) as time_idx from (select distinct timestep from predictions)),
b as (select timestep, time_idx, time_idx // 16 as batch from n)"""


def _batches(spark, folder):
    times = views.predictions(spark, folder).select("timestep").distinct()
    numbered = row_position(times, [], F.floor(F.col("timestep") / 4096), ["timestep"], "time_idx")
    return numbered.withColumn("batch", F.floor(F.col("time_idx") / 16))


@query("g13_time_batches", views.with_views("predictions") + _BATCH_SQL + "select timestep, time_idx, batch from b")
def g13_time_batches(spark, folder):
    return _batches(spark, folder)


@query(
    "m6_batch_loss",
    views.with_views("predictions") + _BATCH_SQL + """,
t as (select batch, station_type, sum((true_value - pred_value) ** 2) as s, count(*) as n
      from predictions join b using (timestep) group by batch, station_type)
select batch, round(sum(s / n), 6) as summed_mse, round(sum(s) / sum(n), 6) as pooled_mse from t group by batch""",
)
def m6_batch_loss(spark, folder):
    rows = views.predictions(spark, folder).join(_batches(spark, folder), "timestep")
    return _round_all(
        metrics.batch_loss(rows, "batch", "station_type", "true_value", "pred_value"), ["summed_mse", "pooled_mse"]
    )


@query(
    "m7_event_mse",
    views.with_views("predictions") + _BATCH_SQL + """
select station_id, round(avg((true_value - pred_value) ** 2), 6) as event_mse
from predictions join b using (timestep) where time_idx >= 593 and time_idx < 1797 group by station_id""",
)
def m7_event_mse(spark, folder):
    event = _batches(spark, folder).where((F.col("time_idx") >= 593) & (F.col("time_idx") < 1797)).select("timestep")
    rows = views.predictions(spark, folder).join(event, "timestep", "left_semi")
    return _round_all(metrics.event_mse(rows, "true_value", "pred_value", ["station_id"]), ["event_mse"])


@query(
    "m8_station_series",
    views.with_views("predictions") + """
select station_id, row_number() over (partition by station_id order by timestep, sub, true_value, pred_value) - 1 as position,
       timestep, true_value, round(pred_value, 6) as pred_value from predictions""",
)
def m8_station_series(spark, folder):
    """Truth and prediction of each station in time order, as numbered rows."""
    numbered = row_position(
        views.predictions(spark, folder), ["station_id"], F.floor(F.col("timestep") / 1024),
        ["timestep", "sub", "true_value", "pred_value"], "position",
    )
    return numbered.select("station_id", "position", "timestep", "true_value", rounded(F.col("pred_value")).alias("pred_value"))


_LOG_SQL = """
with e as (select event_type as run, row_number() over (partition by event_type order by date_trunc('day', ts)) as epoch,
                  round(avg(value), 6) as val_loss
           from events group by event_type, date_trunc('day', ts)),
b as (select *, min(val_loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as best_before,
             min(val_loss) over (partition by run order by epoch) as best_val_so_far from e),
c as (select *, coalesce(val_loss < best_before, true) as new_best,
             epoch - max(case when val_loss <= best_val_so_far then epoch end) over (partition by run order by epoch) as stale from b),
s as (select run, min(epoch) filter (stale >= 3) as stop_epoch from c group by run)"""


def _epochs(spark, folder):
    daily = views.table(spark, folder, "events").groupBy(
        F.col("event_type").alias("run"), F.to_date("ts").alias("day")
    ).agg(rounded(F.avg("value")).alias("val_loss"))
    return row_position(daily, ["run"], F.trunc("day", "month"), ["day"], "_n").select(
        "run", (F.col("_n") + 1).alias("epoch"), "val_loss"
    )


@query("w7_training_log", _LOG_SQL + "select run, epoch, val_loss, best_val_so_far, new_best, stale from c")
def w7_training_log(spark, folder):
    """Running best loss, new-best flag and early-stop counter per run; daily means play the epochs."""
    return analyse_training(_epochs(spark, folder), ["run"]).drop("stop")


@query(
    "w7_training_summary",
    _LOG_SQL + """
select c.run, count(*) as epochs, min(val_loss) as best_val_loss, max(case when new_best then epoch end) as best_epoch, any_value(s.stop_epoch) as stop_epoch
from c join s using (run) where s.stop_epoch is null or c.epoch <= s.stop_epoch group by c.run""",
)
def w7_training_summary(spark, folder):
    return summarise_training(analyse_training(_epochs(spark, folder), ["run"], patience=3), ["run"])


def _logged(spark, folder):
    """The epochs as an experiment log: JSON records next to one record of the setup and one of the summary per run."""
    epochs = _epochs(spark, folder)
    path = f"{checkpoint_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    run = F.concat(F.lit("{\"run\":\""), F.col("run"), F.lit("\"}")).alias("config")
    sinks.append_records(epochs.select("epoch", "val_loss", run), path)
    sinks.append_records(epochs.groupBy("run").agg(F.count(F.lit(1)).alias("epochs_completed"), F.min("val_loss").alias("best_validation_loss")).select(
        F.lit("training_summary").alias("type"), run, "epochs_completed", "best_validation_loss"), path)
    return sinks.read_experiment_log(spark, path).withColumn("run", F.get_json_object("config", "$.run"))


@query("s8_log_records", _LOG_SQL + """
select 'epoch' as kind, run, epoch, val_loss, null::bigint as epochs_completed, null::double as best_validation_loss from c
union all select 'training_summary', run, null, null, count(*), min(val_loss) from c group by run""")
def s8_log_records(spark, folder):
    """Records of two kinds, appended to a log and read back through one merged schema."""
    log = _logged(spark, folder)
    kind = F.coalesce("type", F.lit("epoch")).alias("kind")
    return log.select(kind, "run", "epoch", "val_loss", "epochs_completed", "best_validation_loss")


@query("w7_logged_training", _LOG_SQL + "select run, epoch, val_loss, best_val_so_far, new_best, stale from c")
def w7_logged_training(spark, folder):
    """Running best and early-stop counter on the epoch records of a written log."""
    epochs = _logged(spark, folder).where("epoch is not null").select("run", "epoch", "val_loss")
    return analyse_training(epochs, ["run"]).drop("stop")


@query("s7_written_and_read", views.with_views("predictions") + """
select fold, count(*) as n, count(*) filter (true_value > 0 and pred_value = 0) as false_zeros, round(sum(true_value), 6) as true_sum, round(sum(pred_value), 6) as pred_sum
from predictions where fold in (1, 3) group by fold""")
def s7_written_and_read(spark, folder):
    """Predictions written by fold as CSV and Parquet; two folds are read back, the others are not touched."""
    scored = views.predictions(spark, folder).withColumn("is_false_zero", (F.col("true_value") > 0) & (F.col("pred_value") == 0))
    path = f"{checkpoint_folder(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    sinks.write_predictions(scored, path)
    sinks.write_parquet(scored, f"{path}/parquet", ["fold"])
    held = spark.read.parquet(f"{path}/parquet").where(F.col("fold").isin(1, 3))
    zeros = spark.read.csv(f"{path}/false_zeros", header=True, schema="station_id long, true_value double").where(F.col("fold").isin(1, 3)) if scored.where("is_false_zero").limit(1).count() else None
    totals = held.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("true_value")).alias("true_sum"), rounded(F.sum("pred_value")).alias("pred_sum"))
    if zeros is None:
        return totals.withColumn("false_zeros", F.lit(0).cast("long"))
    counted = zeros.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("false_zeros"))
    return totals.join(counted, "fold", "left").withColumn("false_zeros", F.coalesce("false_zeros", F.lit(0).cast("long")))
