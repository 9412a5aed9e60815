"""Result tables over prepared branch results: health, detection rates, ROC, specification curves. Failures stay in every denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgrid.functions.stats import qnorm
from specgrid.sources.scratch import saved

ALPHA = 0.05
#: Model names, by the part they contain, in order of precedence, and their labels.
LABELS = (("rmanova", "rmANOVA"), ("full_slope", "LMM (full)"), ("cong_slope", "LMM (random congruency slope)"), ("intercept", "LMM (random intercept)"))
NULL_KEYS = ["rate_source", "rate_label", "interpretable_fpr_source", "null_type", "effect_condition", "strip_method", "model_type", "transformation"]


def join_diagnostics(results: DataFrame, diags: DataFrame) -> DataFrame:
    """Results with their data branch's diagnostics."""
    own = [c for c in diags.columns if c == "data_id" or c not in results.columns]
    return results.join(diags.select(*own), "data_id", "left")


def allowed(results: DataFrame) -> DataFrame:
    return results.where("(effect_condition = 'present' and strip_method = 'none') or (effect_condition = 'null_interaction' and strip_method <> 'none')")


def model_label(model: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, label in reversed(LABELS):
        out = F.when(model.contains(part), label).otherwise(out)
    return F.coalesce(out, model)


def column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def prepare(results: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Allowed combinations with every derived column that the tables read."""
    df = allowed(results)
    get = lambda name, kind="double": column(df, name, kind)
    singular = (
        F.when(F.col("error"), F.lit(None).cast("boolean")).when(get("full_is_singular", "boolean").isNotNull(), get("full_is_singular", "boolean"))
        .when(F.lower(get("error_message", "string")).contains("singular"), True).when(get("random_intercept_var") == 0, True).when(get("random_slope_var") == 0, True).otherwise(False)
    )
    df = df.withColumns({
        "converged_both": F.col("full_converged") & F.coalesce(get("null_converged", "boolean"), F.lit(True)), "is_singular": singular,
        "fallback_level": get("fallback_level", "string"), "nullification_verdict": get("nullification_verdict", "string"), "preservation_pass": get("preservation_pass", "boolean"),
        "AIC_diff": get("AIC_diff"), "BIC_diff": get("BIC_diff"), "effect_ci_lower": get("effect_ci_lower"), "effect_ci_upper": get("effect_ci_upper"),
    })
    df = df.withColumn("numerically_usable", ~F.col("error") & F.col("converged_both") & ~F.col("is_singular"))
    usable = lambda c: F.when(F.col("numerically_usable"), c)
    null = F.col("effect_condition") == "null_interaction"
    df = df.withColumns({
        "is_true_effect": F.col("effect_condition") == "present", "is_null_effect": null, "null_type": F.when(null, F.concat(F.lit("null_interaction:"), "strip_method")),
        "rate_source": F.when(null, "empirical_nullification").otherwise("empirical_present"), "has_fallback_sensitivity": F.col("fallback_level").isNotNull(), "primary_inference_only": F.lit(True),
        "is_interpretable_nullifier": null & (F.col("nullification_verdict") == "interpretable_nullifier"), "model_type": model_label(F.col("model")),
        "is_significant": usable(F.col("main_p_value") < alpha), "aic_improvement": usable(-F.col("AIC_diff")), "bic_improvement": usable(-F.col("BIC_diff")),
        "ci_width": usable(F.col("effect_ci_upper") - F.col("effect_ci_lower")), "small_sample": F.col("n_obs") < 100,
    })
    wide = F.col("numerically_usable") & F.col("is_true_effect") & (F.abs("main_estimate") > 1e-6) & F.col("ci_width").isNotNull()
    df = df.withColumn("poor_ci", F.when(wide, F.col("ci_width") > 2 * F.abs("main_estimate")).otherwise(False))
    spec = F.coalesce("is_interpretable_nullifier", F.lit(False))
    return df.withColumns({"interpretable_fpr_source": spec, "rate_label": F.when(spec, "nullification-based FPR").otherwise("diagnostic nullification detection rate")})


def n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def mean(name: str) -> Column:
    return F.avg(F.col(name))


def branch_health(p: DataFrame) -> DataFrame:
    ok = ~F.col("error")
    got = p.groupBy("model_type", "transformation", "effect_condition", "null_type").agg(
        F.count("*").alias("n_total"), n(F.col("error")).alias("n_error"), n(ok).alias("n_no_error"), n(F.col("converged_both") & ok).alias("n_converged"),
        n(F.col("is_singular") & ok).alias("n_singular"), n(F.col("numerically_usable")).alias("n_usable"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b))
    return got.withColumns({"pct_error": share("n_error", "n_total"), "pct_converged": share("n_converged", "n_no_error"), "pct_singular": share("n_singular", "n_no_error"), "pct_usable": share("n_usable", "n_total")})


def branch_health_by_spec(p: DataFrame) -> DataFrame:
    got = p.groupBy("model_type", "transformation", "effect_condition", "null_type", "sample_size", "outlier").agg(F.count("*").alias("n_total"), n(F.col("numerically_usable")).alias("n_usable"), F.count_distinct("subsample_id").alias("n_subsamples"))
    return got.withColumn("pct_usable", 100 * F.col("n_usable") / F.col("n_total"))


def problem_branches(p: DataFrame) -> DataFrame:
    ok = ~F.col("error")
    text = F.concat(*(F.when(F.coalesce(c, F.lit(False)), label).otherwise("") for c, label in (
        (F.col("error"), "error;"), (ok & ~F.col("converged_both"), "non-converged;"), (ok & F.col("is_singular"), "singular;"), (F.col("poor_ci"), "wide-CI;"), (F.col("small_sample"), "small-n;"),
    )))
    keep = ["branch_id", "model_type", "effect_condition", "null_type", "transformation", "subsample_id", "error", "converged_both", "is_singular", "numerically_usable", "small_sample", "poor_ci", "main_estimate", "main_std_error", "ci_width", "main_p_value", "n_obs"]
    return p.where("error or not converged_both or is_singular or poor_ci or small_sample").select(*keep, text.alias("problems"))


def estimate_summary(p: DataFrame) -> DataFrame:
    """Location and spread of usable estimates; the median absolute deviation is scaled by 1.4826."""
    keys = ["model_type", "transformation", "effect_condition", "null_type"]
    usable = p.where("numerically_usable")
    base = usable.groupBy(*keys).agg(
        F.count("*").alias("n_usable"), mean("main_estimate").alias("mean_estimate"), F.median("main_estimate").alias("median_estimate"), F.stddev_samp("main_estimate").alias("sd_estimate"),
        mean("main_std_error").alias("mean_se"), mean("aic_improvement").alias("mean_aic_improvement"), mean("bic_improvement").alias("mean_bic_improvement"),
    )
    mid = base.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("median_estimate").alias("__m"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    away = usable.join(mid, same).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col("main_estimate") - F.col("__m")))).alias("__mad"))
    away = away.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__mad").alias("mad_estimate"))
    return base.join(away, same, "left").drop(*(f"__{k}" for k in keys))


def detection(p: DataFrame, keys: list[str], alpha: float, names: tuple[str, str]) -> DataFrame:
    return p.groupBy(*keys).agg(
        F.count("*").alias("n"), n(F.col("main_p_value") < alpha).alias(names[0]), (n(F.col("main_p_value") < alpha) / F.count("*")).alias(names[1]),
        mean("main_p_value").alias("mean_p"), F.median("main_p_value").alias("median_p"), mean("main_estimate").alias("mean_estimate"), F.stddev_samp("main_estimate").alias("sd_estimate"),
    )


def row_level(p: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    return p.select(*keys, (F.col("main_p_value") < alpha).alias("significant"), F.col("main_p_value").alias("p_value"), F.col("main_estimate").alias("estimate"), F.col("main_std_error").alias("std_error"))


def power_tables(p: DataFrame, alpha: float = ALPHA) -> dict[str, DataFrame]:
    usable, keys = p.where("numerically_usable and is_true_effect"), ["model_type", "transformation"]
    return {
        "coarse": detection(usable, keys, alpha, ("detected", "power")), "by_sample_size": detection(usable, [*keys, "sample_size"], alpha, ("detected", "power")).drop("median_p", "sd_estimate"),
        "by_outlier": row_level(usable, [*keys, "sample_size", "outlier"], alpha), "per_branch": row_level(usable, [*keys, "sample_size", "subsample_id", "outlier"], alpha),
    }


def fpr_tables(p: DataFrame, alpha: float = ALPHA) -> dict[str, DataFrame]:
    usable, names = p.where("numerically_usable and is_null_effect"), ("false_positives", "FPR")
    return {
        "coarse": detection(usable, NULL_KEYS, alpha, names).drop("sd_estimate"), "by_sample_size": detection(usable, [*NULL_KEYS, "sample_size"], alpha, names).drop("median_p", "sd_estimate"),
        "by_outlier": detection(usable, [*NULL_KEYS, "sample_size", "outlier"], alpha, names).drop("median_p", "sd_estimate", "mean_p"),
        "per_branch": row_level(usable, [*NULL_KEYS, "sample_size", "subsample_id", "outlier"], alpha),
    }


def failure_aware_rates(p: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Six exclusive outcomes of null branches, and rates over all that were planned as well as over the usable."""
    usable, err = F.coalesce("numerically_usable", F.lit(False)), F.col("error")
    sig = usable & F.coalesce(F.col("main_p_value") < alpha, F.lit(False))
    lost, odd = ~err & ~F.col("converged_both"), ~err & F.col("converged_both") & F.coalesce("is_singular", F.lit(False))
    kinds = {"significant_primary": sig, "usable_nonsignificant": usable & ~sig, "singular": odd, "non_converged": lost, "extraction_or_preprocessing_error": err}
    other = ~sig & ~(usable & ~sig) & ~F.coalesce(lost, F.lit(False)) & ~F.coalesce(odd, F.lit(False)) & ~err
    got = p.where("is_null_effect").groupBy(*NULL_KEYS, "sample_size", "outlier").agg(F.count("*").alias("n_planned"), *(n(c).alias(k) for k, c in kinds.items()), n(other).alias("other_invalid"))
    got = got.withColumn("conditional_n_usable", F.col("significant_primary") + F.col("usable_nonsignificant"))
    per = lambda c: F.col(c) / F.col("n_planned")
    return got.withColumns({
        "unconditional_rate": per("significant_primary"), "conditional_rate": F.when(F.col("conditional_n_usable") > 0, F.col("significant_primary") / F.col("conditional_n_usable")),
        "singular_rate": per("singular"), "non_converged_rate": per("non_converged"), "error_rate": per("extraction_or_preprocessing_error"),
    })


def paired_rates(p: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    usable = p.where("numerically_usable")
    sig = n(F.col("main_p_value") < alpha)
    tpr = usable.where("is_true_effect").groupBy(*keys).agg(F.count("*").alias("n_true"), sig.alias("detected"), (sig / F.count("*")).alias("TPR"), mean("main_estimate").alias("mean_effect_present"))
    fpr = usable.where("is_null_effect").groupBy(*keys, "null_type").agg(F.count("*").alias("n_null"), sig.alias("false_positives"), (sig / F.count("*")).alias("FPR"), mean("main_estimate").alias("mean_effect_null"))
    return fpr.join(tpr, keys, "left")


def roc(p: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """True against false positives by model, transformation and sample: d' (rates kept 1/(2n) from 0 and 1), Youden's J (a missing TPR counts 0), diagnostic odds ratio."""
    df = paired_rates(p, ["model_type", "transformation", "sample_size"], alpha)
    keep = lambda rate, count: F.least(F.greatest(rate, 1 / (2 * F.col(count))), 1 - 1 / (2 * F.col(count)))
    d = F.when(F.col("n_true").isNotNull(), qnorm(keep(F.coalesce("TPR", F.lit(0.0)), "n_true")) - qnorm(keep(F.col("FPR"), "n_null")))
    t, f = F.col("TPR"), F.col("FPR")
    dor = F.when(t.isNull() | f.isNull(), None).when(t == 0, 0.0).when((f == 0) | (t == 1) | (f == 1), None).otherwise((t / (1 - t)) / (f / (1 - f)))
    return df.withColumns({"has_tpr": t.isNotNull(), "d_prime": d, "youden_j": F.coalesce(t, F.lit(0.0)) - f, "DOR": dor})


def roc_by_outlier(p: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return paired_rates(p, ["model_type", "transformation", "sample_size", "outlier"], alpha).drop("mean_effect_present", "mean_effect_null")


def spec_curve(p: DataFrame) -> DataFrame:
    """One row for each branch: its status and, if usable, its values."""
    status = F.when(F.col("error"), "error").when(~F.col("converged_both"), "non-converged").when(F.col("is_singular"), "singular").otherwise("usable")
    usable = lambda c, name: F.when(F.col("numerically_usable"), F.col(c)).alias(name)
    return p.select(
        "branch_id", "model_type", "transformation", "outlier", "sample_size", "subsample_id", "effect_condition", "null_type", "strip_method", status.alias("status"), "numerically_usable",
        F.col("is_significant").alias("significant"), usable("main_p_value", "p_value"), usable("main_estimate", "estimate"), usable("main_std_error", "std_error"), usable("effect_ci_lower", "ci_lower"), usable("effect_ci_upper", "ci_upper"),
    )


def spec_inconsistency(p: DataFrame, alpha: float = ALPHA) -> DataFrame:
    ok = F.col("numerically_usable")
    pv = F.when(ok, F.col("main_p_value"))
    est = F.when(ok, F.col("main_estimate"))
    got = p.groupBy("model_type", "effect_condition", "null_type", "transformation", "sample_size").agg(
        F.count("*").alias("n_total"), n(ok).alias("n_usable"), F.count_distinct(F.when(ok, F.col("subsample_id"))).alias("n_subsamples"), n(pv < alpha).alias("n_sig"),
        F.avg(est).alias("effect_mean"), F.stddev_samp(est).alias("effect_sd"), F.min(pv).alias("p_min"), F.max(pv).alias("p_max"),
    )
    got = got.withColumn("n_nonsig", F.col("n_usable") - F.col("n_sig")).withColumn("n_failed", F.col("n_total") - F.col("n_usable"))
    return got.withColumns({
        "pct_significant": F.when(F.col("n_usable") > 0, 100 * F.col("n_sig") / F.col("n_usable")), "is_inconsistent": (F.col("n_sig") > 0) & (F.col("n_nonsig") > 0),
        "pct_failed": 100 * F.col("n_failed") / F.col("n_total"), "effect_cv": F.when((F.col("n_usable") >= 2) & (F.abs("effect_mean") > 1e-6), F.col("effect_sd") / F.abs("effect_mean")), "p_range": F.col("p_max") - F.col("p_min"),
    })


def by_factor(p: DataFrame, factors: list[str], alpha: float = ALPHA) -> DataFrame:
    """Health and rates by any factors, in one aggregate."""
    ok = F.col("numerically_usable")
    val = lambda c: F.when(ok, F.col(c))
    got = p.groupBy(*factors, "effect_condition", "null_type").agg(
        F.count("*").alias("n_total"), n(ok).alias("n_usable"), n(ok & (F.col("main_p_value") < alpha)).alias("n_significant"),
        F.avg(val("main_estimate")).alias("mean_estimate"), F.median(val("main_estimate")).alias("median_estimate"), F.avg(val("main_p_value")).alias("mean_p"),
    )
    return got.withColumns({"pct_usable": 100 * F.col("n_usable") / F.col("n_total"), "pct_significant": F.when(F.col("n_usable") > 0, 100 * F.col("n_significant") / F.col("n_usable"))})


def summary_table(p: DataFrame, alpha: float = ALPHA) -> DataFrame:
    ok = F.col("numerically_usable")
    val = lambda c: F.when(ok, F.col(c))
    got = p.groupBy("model_type", "transformation", "effect_condition", "null_type").agg(
        F.count("*").alias("n_total"), n(ok).alias("n_usable"), n(ok & (F.col("main_p_value") < alpha)).alias("n_sig"),
        F.avg(val("main_estimate")).alias("mean_effect"), F.stddev_samp(val("main_estimate")).alias("sd_effect"), F.median(val("main_p_value")).alias("median_p"),
    )
    label = F.when(F.col("effect_condition") == "present", "Power (TPR)").when(F.col("effect_condition") == "null_interaction", F.concat(F.lit("FPR ("), "null_type", F.lit(")")))
    return got.withColumns({"pct_usable": 100 * F.col("n_usable") / F.col("n_total"), "pct_significant": F.when(F.col("n_usable") > 0, 100 * F.col("n_sig") / F.col("n_usable")), "metric_type": label}).drop("n_sig")


def operating_tables(results: DataFrame, diags: DataFrame, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """False-positive tables and failure-aware rates of results joined to their diagnostics.

    All of them are of null branches, whose columns that the tables read are joined and written once.
    """
    read = [*NULL_KEYS, "sample_size", "subsample_id", "outlier", "is_null_effect", "numerically_usable", "error", "converged_both", "is_singular", "main_p_value", "main_estimate", "main_std_error"]
    p = saved(prepare(join_diagnostics(results, diags), alpha).where("is_null_effect").select(*read))
    return {f"fpr_{k}": v for k, v in fpr_tables(p, alpha).items()} | {"failure_aware": failure_aware_rates(p, alpha)}


def known_truth_rates(results: DataFrame) -> DataFrame:
    """Rates by known truth: FPR where the null holds, TPR where it does not; an unknown condition raises."""
    truth = F.when(F.col("condition") == "null_location", "known_null").when(F.col("condition") == "present_location", "known_alternative")
    truth = F.when(truth.isNull(), F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce("condition", F.lit("null")))).cast("string")).otherwise(truth)
    err, p = F.col("error"), F.col("p_value")
    usable = ~err & p.isNotNull()
    got = results.withColumn("truth_type", truth).groupBy("truth_type", "condition", "truth_interaction_log", "model").agg(
        F.count("*").alias("n_planned"), n(usable).alias("n_usable"), n(usable & F.col("is_significant")).alias("n_significant"), n(usable & ~F.col("is_significant")).alias("n_usable_non_significant"),
        n(err).alias("n_error"), n(~err & p.isNull()).alias("n_missing_p"),
    )
    per = lambda c: F.col(c) / F.col("n_planned")
    return got.withColumns({
        "rate_name": F.when(F.col("truth_type") == "known_null", "FPR").otherwise("TPR"), "unconditional_rate": per("n_significant"), "conditional_rate": F.when(F.col("n_usable") > 0, F.col("n_significant") / F.col("n_usable")),
        "pct_significant": per("n_significant"), "pct_usable_non_significant": per("n_usable_non_significant"), "pct_error": per("n_error"), "pct_missing_p": per("n_missing_p"),
    })


def run_all(results: DataFrame, diags: DataFrame | None = None, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """Every table, lazily, over one prepared frame (cache it before running several)."""
    p = prepare(results if diags is None else join_diagnostics(results, diags), alpha)
    power, fpr = power_tables(p, alpha), fpr_tables(p, alpha)
    return {
        "branch_health": branch_health(p), "branch_health_by_spec": branch_health_by_spec(p), "problem_branches": problem_branches(p), "estimate_summary": estimate_summary(p),
        **{f"power_{k}": v for k, v in power.items()}, **{f"fpr_{k}": v for k, v in fpr.items()}, "failure_aware": failure_aware_rates(p, alpha), "roc": roc(p, alpha), "roc_by_outlier": roc_by_outlier(p, alpha),
        "spec_curve": spec_curve(p), "spec_inconsistency": spec_inconsistency(p, alpha), "summary": summary_table(p, alpha),
        **{name: by_factor(p, [factor, "transformation"], alpha) for name, factor in (("by_outlier", "outlier"), ("by_sample_size", "sample_size"), ("by_model", "model_type"))},
    }
