"""Experiment runs and model versions: search, selection, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.scan import segmented_scan


def search_runs(runs: DataFrame, experiment_id: str, status: str | None = None, metric: str | None = None, top: int | None = None) -> DataFrame:
    """Runs of an experiment; with metric the best first, runs without it left out, ties by run_id; top is a top-k."""
    out = runs.where(F.col("experiment_id") == experiment_id)
    out = out.where(F.col("status") == status) if status else out
    if metric:
        m = F.try_element_at("metrics", F.lit(metric))
        out = out.where(m.isNotNull()).orderBy(m.desc(), "run_id")
    return out.limit(top) if top else out


def best_with_version(best: DataFrame, versions: DataFrame, model: str) -> DataFrame:
    """The runs given with the version of the model that came from each, null where none did. The least version wins
    where one run has several."""
    linked = versions.where(F.col("name") == model).groupBy("run_id").agg(F.min_by(F.struct("version", "current_stage"), "version").alias("v"))
    return best.join(linked, "run_id", "left").select(best["*"], "v.version", "v.current_stage")


def model_uri(model: Column, stage: Column, version: Column, run_id: Column) -> Column:
    """The promoted stage where there is one, else the version, else the run's own path."""
    by_version = F.when(version.isNotNull(), F.concat(F.lit("models:/"), model, F.lit("/"), version.cast("string"))).otherwise(F.concat(F.lit("runs:/"), run_id, F.lit("/model")))
    return F.when(stage.isNotNull(), F.concat(F.lit("models:/"), model, F.lit("/"), stage)).otherwise(by_version)


def transition(versions: DataFrame, model: str, version: int, stage: str, archive_existing: bool = False) -> DataFrame:
    """The registry with one version in a new stage; others keep theirs unless those in the stage are to be archived."""
    it = (F.col("name") == model) & (F.col("version") == version)
    others = (F.col("name") == model) & (F.col("current_stage") == stage)
    now = F.when(it, F.lit(stage))
    if archive_existing:
        now = now.when(others, F.lit("Archived"))
    return versions.withColumn("current_stage", now.otherwise(F.col("current_stage")))


def delete_runs(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """The runs without those named."""
    return runs.join(ids.select("run_id"), "run_id", "left_anti")


def delete_runs_checked(runs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the runs left, a status row for each id): an id without a run is an error of its own row and stops nothing."""
    here = runs.select("run_id", F.lit(True).alias("_here")).distinct()
    judged = ids.select("run_id").join(here, "run_id", "left")
    status = judged.select("run_id", F.when(F.col("_here"), "deleted").otherwise("error").alias("status"), F.when(F.col("_here").isNull(), F.concat(F.lit("no run "), "run_id")).alias("error"))
    return delete_runs(runs, ids), status


def log_metrics(metrics: DataFrame, new: DataFrame) -> DataFrame:
    """The long table (run_id, key, value, step) with new entries; a metric of one step may be logged again."""
    return metrics.unionByName(new.select(*metrics.columns))


def log_params(runs: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The runs with new parameters (run_id, key, value) in their maps. A parameter keeps its first value, also among the
    new ones by their order; without an order, or at the same one, the least. That of an unknown run is ignored."""
    first = new.groupBy("run_id", "key").agg(F.min_by("value", F.struct(*([order] if order else []), "value")).alias("value"))
    added = first.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    j = runs.join(added, "run_id", "left")
    nothing = F.create_map().cast("map<string,string>")
    old, extra = F.coalesce("params", nothing), F.coalesce("_new", nothing)
    both = F.map_concat(old, F.map_filter(extra, lambda k, _: ~F.map_contains_key(old, k)))
    return j.withColumn("params", both).drop("_new").select(*runs.columns)


def log_artifacts(artifacts: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The table (run_id, path, content) with new files; one of the same run and path is replaced, and of several new ones
    the last by order stays; without an order, or at the same one, the greatest."""
    rest = [c for c in artifacts.columns if c not in ("run_id", "path")]
    body = F.struct(*rest)
    last = new.groupBy("run_id", "path").agg(F.max_by(body, F.struct(*([F.col(order).alias("_ord")] if order else []), body)).alias("_v")).select("run_id", "path", "_v.*")
    return artifacts.join(last.select("run_id", "path"), ["run_id", "path"], "left_anti").select(*artifacts.columns).unionByName(last.select(*artifacts.columns))


def running_best(df: DataFrame, value: str, order: list[str], by: list[str], large: bool = False) -> DataFrame:
    """df with best_before (0.0 at the start, or the greatest value before) and is_best: strictly above it. With large a
    group is spread over the tasks; otherwise it is one sorted partition."""
    if large:
        seen = segmented_scan(df, by, order, {"best_before": ("max", F.col(value))})
    else:
        seen = df.withColumn("best_before", F.max(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)))
    best = F.greatest(F.lit(0.0), F.coalesce(F.col("best_before"), F.lit(0.0)))
    return seen.withColumn("best_before", best).withColumn("is_best", F.col(value) > F.col("best_before"))


def best_by_key(df: DataFrame, by: list[str], value: str, step: str) -> DataFrame:
    """Per key the step of the greatest value, the earliest of equals, and the value; an aggregate, no sorting."""
    return df.groupBy(*by).agg(F.max_by(step, F.struct(F.col(value), -F.col(step))).alias("best_step"), F.max(value).alias("best_value"))
