"""Reporting tables: the data behind a report's figures, without drawing. Each takes one of the result or diagnostic tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.functions.order import counted_quantiles, grouped_quantiles, ranked
from specgrid.operators.grid import parse_data_id
from specgrid.operators.tables import LABELS, n
from specgrid.sources.scratch import saved

AXES = ["model_type", "transformation", "outlier", "sample_size", "null_type"]
OUTCOMES = ["significant_primary", "usable_nonsignificant", "singular", "non_converged", "extraction_or_preprocessing_error", "other_invalid"]
#: Display names of labels.
DISPLAY = {
    "shuffle": "Shuffle", "additive_qmap": "Quantile map", "additive_qmap_trial_bin": "Quantile map (trial bins)", "local_mean_residual": "Local mean residual", "local_median_residual": "Local median residual",
    "none": "None", "log_rt": "Log RT", "no_log_rt": "Raw RT", "present": "Effect present", "null_interaction": "Interaction removed",
}


def primary_rows(df: DataFrame, models: list[str] | None = None, null_types: list[str] | None = None) -> DataFrame:
    """Interpretable rows of the wanted models and null types (all known ones by default); rows of the present effect stay."""
    df = df.where(F.col("model_type").isin(*(models or [label for _, label in LABELS])))
    if "interpretable_fpr_source" in df.columns:
        df = df.where(F.col("interpretable_fpr_source") | F.col("null_type").isNull())
    return df.where(F.col("null_type").isNull() | F.col("null_type").isin(*null_types)) if null_types else df


def stable_rows(df: DataFrame, count: str = "n", min_n: int = 25) -> DataFrame:
    """Without the full sample and without cells of fewer than min_n; unknown counts stay."""
    return df.where((F.col("sample_size") < 1) & (F.col(count).isNull() | (F.col(count) >= min_n)))


def rank_specs(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., branch_id, rank, estimate, axis, level): usable branches ranked by estimate within keys, four axes stacked."""
    placed = ranked(curve.where("estimate is not null"), keys, ["estimate", "branch_id"]).withColumn("sample_size", F.col("sample_size").cast("string"))
    return placed.unpivot([*dict.fromkeys([*keys, "branch_id", "rank", "estimate"])], [c for c in ("model_type", "transformation", "outlier", "sample_size") if c not in keys], "axis", "level")


def strip_pivot(fpr: DataFrame, strips: list[str]) -> DataFrame:
    """Mean FPR weighted by n, a column for each strip method."""
    return fpr.groupBy("model_type", "transformation").pivot("strip_method", strips).agg(F.sum(F.col("FPR") * F.col("n")) / F.sum("n"))


def pooled_fpr(fpr: DataFrame, keys: list[str]) -> DataFrame:
    return fpr.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("false_positives").alias("false_positives"), (F.sum("false_positives") / F.sum("n")).alias("FPR"))


def outlier_heatmap(fpr: DataFrame) -> DataFrame:
    return pooled_fpr(fpr, ["model_type", "transformation", "outlier", "strip_method"])


def transform_delta(fpr: DataFrame) -> DataFrame:
    """FPR on raw less that on log times, where both exist."""
    rate = lambda t: F.sum(F.when(F.col("transformation") == t, F.col("false_positives"))) / F.sum(F.when(F.col("transformation") == t, F.col("n")))
    got = fpr.groupBy("model_type", "strip_method", "sample_size").agg(rate("no_log_rt").alias("FPR_raw"), rate("log_rt").alias("FPR_log"))
    return got.where("FPR_raw is not null and FPR_log is not null").withColumn("delta_raw_minus_log", F.col("FPR_raw") - F.col("FPR_log"))


def extreme_combinations(fpr: DataFrame, top: int = 18, alpha: float = 0.05) -> DataFrame:
    """The `top` cells by excess over alpha, then by n, then by name."""
    got = fpr.withColumn("excess", F.col("FPR") - alpha)
    return got.orderBy(F.round("excess", 9).desc(), F.col("n").desc(), "model_type", "transformation", "null_type", "sample_size", "outlier").limit(top)


def marginal_fpr(fpr: DataFrame) -> DataFrame:
    """(axis, level, n, FPR): rates by each of five axes, as grouping sets of one scan."""
    held = fpr.withColumn("sample_size", F.col("sample_size").cast("string"))
    stacked = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("level")) for a in AXES))
    return held.select("n", "false_positives", F.inline(stacked)).groupBy("axis", "level").agg(F.sum("n").alias("n"), (F.sum("false_positives") / F.sum("n")).alias("FPR"))


def power_heatmap(power: DataFrame) -> DataFrame:
    return power.groupBy("model_type", "transformation", "sample_size", "outlier").agg(F.count("*").alias("n"), F.avg(F.col("significant").cast("int")).alias("power"))


def health_long(health: DataFrame) -> DataFrame:
    return health.unpivot(["model_type", "transformation", "effect_condition", "null_type", "n_total"], ["pct_error", "pct_converged", "pct_singular", "pct_usable"], "outcome", "percent")


def inconsistent_specs(table: DataFrame) -> DataFrame:
    return table.where("n_usable >= 2")


def power_fpr_frontier(power: DataFrame, fpr: DataFrame) -> DataFrame:
    keys = ["model_type", "transformation", "sample_size"]
    p = power.select(*keys, "power", F.col("n").alias("n_present"))
    return fpr.select(*keys, "null_type", "FPR", F.col("n").alias("n_null")).join(p, keys).where(F.col("power").isNotNull() & F.col("FPR").isNotNull())


def attenuation(curve: DataFrame, cap: float = 2.0) -> DataFrame:
    """Mean absolute null estimate over mean absolute present estimate for each specification, at most cap."""
    keys = ["model_type", "transformation", "outlier", "sample_size"]
    usable = curve.where("estimate is not null")
    present = usable.where("effect_condition = 'present'").groupBy(*keys).agg(F.avg(F.abs("estimate")).alias("present_abs"))
    null = usable.where("effect_condition = 'null_interaction'").groupBy(*keys, "strip_method").agg(F.avg(F.abs("estimate")).alias("null_abs"))
    return null.join(present, keys).where("present_abs > 0").withColumn("ratio", F.least(F.col("null_abs") / F.col("present_abs"), F.lit(cap)))


def verdict_matrix(diags: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent verdict of each group, ties by name."""
    got = diags.groupBy(*keys, "nullification_verdict").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "nullification_verdict")
    return got.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def failure_composition(rates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., outcome, count, share of planned)."""
    got = rates.groupBy(*keys).agg(F.sum("n_planned").alias("n_planned"), *(F.sum(c).alias(c) for c in OUTCOMES))
    return got.unpivot([*keys, "n_planned"], OUTCOMES, "outcome", "n").withColumn("share", F.col("n") / F.col("n_planned"))


def gaps(roc: DataFrame) -> DataFrame:
    """roc with tpr_gap = 1 - TPR and utility_gap = FPR + max(0, 1 - TPR)."""
    gap = 1 - F.col("TPR")
    return roc.withColumns({"tpr_gap": gap, "utility_gap": F.col("FPR") + F.greatest(F.lit(0.0), gap)})


def share_of(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(keys..., level, n, share) of each level within its group."""
    got = df.groupBy(*keys, level).agg(F.count("*").alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def verdict_share(diags: DataFrame) -> DataFrame:
    return share_of(diags, ["strip_method", "transformation", "sample_size"], "nullification_verdict")


def flag_share(definitions: DataFrame) -> DataFrame:
    return share_of(definitions, ["strip_method"], "distributional_flag")


def shuffle_summary(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of matching groups, preserved multisets and passes, and the median absolute slope, stacked as (metric, value)."""
    rate = lambda c: F.avg(c.cast("int"))
    got = checks.groupBy(*keys).agg(rate(F.col("n_count_mismatch") == 0).alias("match_rate"), rate(F.col("preserved")).alias("preserved_rate"), rate(F.col("pass")).alias("pass_rate"), F.median(F.abs("conditional_prev_slope")).alias("median_abs_slope"))
    return got.unpivot(keys, ["match_rate", "preserved_rate", "pass_rate", "median_abs_slope"], "metric", "value")


def middle_and_tail(long: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys..., median_abs, p95_abs): both quantiles of every group, from counted values, so that no group's values meet in one task; a group without values has nulls."""
    # one key that is never null, though its parts may be
    values = saved(long.groupBy(F.struct(*keys).alias("__key"), value.cast("double").alias("value")).agg(F.count("*").alias("n")))
    found = counted_quantiles(values.where("value is not null"), ["__key"], (0.5, 0.95))
    got = values.select("__key").distinct().join(found, "__key", "left")
    return got.select("__key.*", F.col("quantiles")[0].alias("median_abs"), F.col("quantiles")[1].alias("p95_abs"))


def metric_summary(long: DataFrame, top: int = 24) -> DataFrame:
    """Median and 95th percentile of each metric's absolute value by method; the `top` rows by the metric's largest."""
    got = middle_and_tail(long, ["metric", "strip_method"], F.col("abs_cse_value"))
    got = got.withColumn("metric_max", F.max("p95_abs").over(Window.partitionBy("metric")))
    return got.orderBy(F.round("metric_max", 9).desc_nulls_last(), "metric", "strip_method").limit(top)


def gate_breakdown(gates: DataFrame, keys: list[str], min_n: int = 100) -> DataFrame:
    """(keys..., gate, n, share of the group's branches): failing gates split from the warnings, rare ones left out."""
    total = gates.groupBy(*keys).agg(F.count("*").alias("n_branches"))
    got = gates.withColumn("gate", F.explode(F.split("preservation_warnings", ";"))).where("gate <> ''").groupBy(*keys, "gate").agg(F.count("*").alias("n"))
    got = got.withColumn("__all", F.sum("n").over(Window.partitionBy("gate"))).where(F.col("__all") >= min_n).drop("__all")
    return got.join(total, keys).withColumn("share", F.col("n") / F.col("n_branches"))


def residual_deltas(gates: DataFrame) -> DataFrame:
    """Median and 95th percentile of every absolute difference from the present branch, by method."""
    columns = [c for c in gates.columns if c.endswith("_delta_from_present")]
    long = gates.unpivot(["strip_method"], columns, "metric", "delta").where("delta is not null")
    return middle_and_tail(long, ["strip_method", "metric"], F.abs("delta"))


def composition_by_model(rates: DataFrame) -> DataFrame:
    return failure_composition(rates, ["model_type"])


def conditional_vs_unconditional(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Both rates pooled again from their counts."""
    got = rates.groupBy(*keys).agg(F.sum("significant_primary").alias("significant_primary"), F.sum("n_planned").alias("n_planned"), F.sum("conditional_n_usable").alias("n_usable"))
    return got.withColumns({"unconditional_rate": F.col("significant_primary") / F.col("n_planned"), "conditional_rate": F.when(F.col("n_usable") > 0, F.col("significant_primary") / F.col("n_usable"))})


def interpretable_vs_all(fpr: DataFrame) -> DataFrame:
    """Pooled FPR of interpretable nullifiers beside that of all."""
    ok = F.col("interpretable_fpr_source")
    s = lambda c: F.sum(F.when(ok, F.col(c)))
    return fpr.groupBy("strip_method", "model_type").agg((F.sum("false_positives") / F.sum("n")).alias("FPR_all"), (s("false_positives") / s("n")).alias("FPR_interpretable"))


def fpr_story(fpr: DataFrame) -> DataFrame:
    """Pooled FPR by family of nullifier."""
    family = F.when(F.col("strip_method") == "shuffle", "permutation").when(F.col("strip_method").contains("qmap"), "distributional").otherwise("residual")
    return pooled_fpr(fpr.withColumn("family", family), ["family", "strip_method"])


def pooled_rate(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rate): numerator over denominator where both are known, else the mean weighted by n. Columns rate, numerator, denominator, n."""
    known = F.col("numerator").isNotNull() & F.col("denominator").isNotNull()
    exact = F.sum(F.when(known, F.col("numerator"))) / F.sum(F.when(known, F.col("denominator")))
    return table.groupBy(*keys).agg(F.coalesce(exact, F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("rate"))


def fpr_with_se(p: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    got = p.where("numerically_usable and is_null_effect").groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("main_p_value") < alpha).cast("int")).alias("FPR"))
    return got.withColumn("se", F.sqrt(F.col("FPR") * (1 - F.col("FPR")) / F.col("n")))


def display_labels(column: Column) -> Column:
    """The label's display name, itself if it has none."""
    names = F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair])
    return F.coalesce(names[column], column)


def data_id_parts(df: DataFrame) -> DataFrame:
    """df with missing axes filled from data_id."""
    axes = ["sample_size", "subsample_id", "transformation", "outlier", "effect_condition", "strip_method"]
    parts = parse_data_id(df.select("data_id").distinct()).select("data_id", *(F.col(c).alias(f"__{c}") for c in axes))
    got = df.join(parts, "data_id", "left")
    return got.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in df.columns else F.col(f"__{c}") for c in axes}).drop(*(f"__{c}" for c in axes))


def wide_profile(df: DataFrame, ids: list[str]) -> DataFrame:
    """Numeric columns as (ids..., metric, value), finite values only."""
    columns = [c for c, k in df.dtypes if c not in ids and (k in ("double", "float", "int", "bigint", "smallint") or k.startswith("decimal"))]
    long = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(ids, columns, "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def dashboard_residuals(gates: DataFrame) -> DataFrame:
    """Residual metrics, differences and quantiles stacked, with the row's own preservation status."""
    status = F.when(F.col("preservation_pass"), "pass").when(~F.col("preservation_pass"), "fail").otherwise("unknown")
    columns = ["mean_cse", "median_cse", "max_abs_timebin_q050_cse", *(c for c in gates.columns if c.endswith("_delta_from_present")), "q010_cse", "q025_cse", "q050_cse", "q075_cse", "q090_cse"]
    columns = [*dict.fromkeys(c for c in columns if c in gates.columns)]
    return gates.withColumn("preservation_status", status).unpivot(["data_id", "strip_method", "preservation_status"], columns, "metric", "value").where("value is not null")


def pvalue_histogram(p: DataFrame, bins: int = 20) -> DataFrame:
    """(effect_condition, transformation, bin, n) of usable p-values; 1 falls into the last bin."""
    at = F.least(F.floor(F.col("main_p_value") * bins), F.lit(bins - 1)).cast("int")
    return p.where("numerically_usable and main_p_value is not null").groupBy("effect_condition", "transformation", at.alias("bin")).agg(F.count("*").alias("n"))


def estimate_distribution(p: DataFrame, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    got = p.where("numerically_usable").groupBy("effect_condition", "transformation").agg(F.count("*").alias("n"), F.percentile("main_estimate", list(probs)).alias("q"))
    return got.select("effect_condition", "transformation", "n", *(F.col("q")[i].alias(f"q{int(round(1000 * x)):04d}") for i, x in enumerate(probs)))


def extreme_specs(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Usable branches ranked by estimate, a flag above the 99th percentile of absolute estimates, and the estimate clamped to its 1st and 99th percentile."""
    usable = ranked(curve.where("estimate is not null"), keys, ["estimate", "branch_id"])
    top = grouped_quantiles(usable.select(*keys, F.abs("estimate").alias("value")), [(keys, (0.99,))])[0].withColumnRenamed("quantiles", "__top")
    ends = grouped_quantiles(usable.select(*keys, F.col("estimate").alias("value")), [(keys, (0.01, 0.99))])[0].withColumnRenamed("quantiles", "__q")
    got = usable.join(F.broadcast(top.join(ends, keys)), keys)
    return got.withColumns({"extreme": F.abs("estimate") > F.col("__top")[0], "clamped": F.least(F.greatest(F.col("estimate"), F.col("__q")[0]), F.col("__q")[1])}).drop("__top", "__q")


def odds_ratio_table(fits: dict[str, DataFrame | None]) -> DataFrame | None:
    """Regressions' terms under one label column, separated terms left out."""
    parts = [t.withColumn("model", F.lit(k)).where("not separated") for k, t in fits.items() if t is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def decision_map(curve: DataFrame) -> DataFrame:
    """(branch_id, ..., decision, abs_estimate): significant, not significant or not usable, row by row."""
    label = F.when(F.col("significant"), "significant").when(~F.col("significant"), "not_significant").otherwise("not_usable")
    return curve.select("branch_id", "model_type", "transformation", "outlier", "sample_size", "effect_condition", "strip_method", label.alias("decision"), F.abs("estimate").alias("abs_estimate"))


def paired_slopes(checks: DataFrame) -> DataFrame:
    return checks.where("conditional_prev_slope is not null and present_prev_slope is not null").withColumn("change", F.col("conditional_prev_slope") - F.col("present_prev_slope"))


def location_vs_shape(definitions: DataFrame) -> DataFrame:
    return definitions.where("max_abs_location_cse is not null and max_abs_distributional_cse is not null").select("strip_method", "transformation", "sample_size", "outlier", "max_abs_location_cse", "max_abs_distributional_cse", "distributional_flag")


def roc_points(roc: DataFrame) -> DataFrame:
    return roc.where("(TPR is not null and FPR is not null) or d_prime is not null")


def interpretable_counts(p: DataFrame) -> DataFrame:
    return p.groupBy("null_type").agg(F.count("*").alias("n"), n(F.col("interpretable_fpr_source")).alias("n_interpretable"))
