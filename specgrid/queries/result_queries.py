"""Queries over branch results: health, rates, ROC, specification curves and reporting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrid.functions import stats
from specgrid.operators import logit, models, report, tables
from specgrid.registry import query
from specgrid.schema import RESULTS_SCHEMA
from specgrid.sources import io
from specgrid.sources.scratch import saved, scratch

OF = "results_li"
PREPARED = """
p0 as (select *, full_converged and coalesce(null_converged, true) as converged_both, case when error then null when full_is_singular is not null then full_is_singular else false end as is_singular,
    case when model like '%rmanova%' then 'rmANOVA' when model like '%full_slope%' then 'LMM (full)' when model like '%cong_slope%' then 'LMM (random congruency slope)' when model like '%intercept%' then 'LMM (random intercept)' else model end as model_type
  from results where (effect_condition = 'present' and strip_method = 'none') or (effect_condition = 'null_interaction' and strip_method <> 'none')),
p1 as (select *, coalesce(not error and converged_both and not is_singular, false) as usable, effect_condition = 'present' as is_present, effect_condition = 'null_interaction' as is_null,
    case when effect_condition = 'null_interaction' then 'null_interaction:' || strip_method end as null_type, effect_condition = 'null_interaction' and nullification_verdict = 'interpretable_nullifier' as interpretable,
    case when effect_condition = 'null_interaction' then 'empirical_nullification' else 'empirical_present' end as rate_source from p0),
p as (select *, main_p_value < 0.05 as sig, case when usable then effect_ci_upper - effect_ci_lower end as ci_width, n_obs < 100 as small_sample,
    coalesce(usable and is_present and abs(main_estimate) > 1e-6 and effect_ci_upper - effect_ci_lower > 2 * abs(main_estimate), false) as poor_ci,
    case when interpretable then 'nullification-based FPR' else 'diagnostic nullification detection rate' end as rate_label from p1)
"""
HEALTH_KEYS = "model_type, transformation, effect_condition, null_type"
NULL_KEYS = "rate_source, rate_label, interpretable, null_type, effect_condition, strip_method, model_type, transformation"
FPR = f"select {NULL_KEYS}, interpretable as interpretable_fpr_source, sample_size, outlier, count(*) as n, count(case when sig then 1 end) as false_positives, count(case when sig then 1 end) / count(*) as FPR, avg(main_estimate) as mean_estimate from p where usable and is_null group by all"
CURVE = """select branch_id, model_type, transformation, outlier, sample_size, subsample_id, effect_condition, null_type, strip_method, case when error then 'error' when not converged_both then 'non-converged' when is_singular then 'singular' else 'usable' end as status,
  case when usable then sig end as significant, case when usable then main_p_value end as p_value, case when usable then main_estimate end as estimate, case when usable then main_std_error end as std_error, case when usable then effect_ci_lower end as ci_lower, case when usable then effect_ci_upper end as ci_upper from p"""
RATES = f"""select {NULL_KEYS}, interpretable as interpretable_fpr_source, sample_size, outlier, count(*) as n_planned, count(case when usable and sig then 1 end) as significant_primary, count(case when usable and not coalesce(sig, false) then 1 end) as usable_nonsignificant,
  count(case when not error and converged_both and is_singular then 1 end) as singular, count(case when not error and not converged_both then 1 end) as non_converged, count(case when error then 1 end) as extraction_or_preprocessing_error, 0 as other_invalid from p where is_null group by all"""


def sql(body: str, *more: str) -> str:
    return f"with {', '.join([PREPARED, *more])} {body}"


def prep(df: DataFrame) -> DataFrame:
    return tables.prepare(df)


def fpr_by_outlier(df: DataFrame) -> DataFrame:
    return tables.fpr_tables(prep(df))["by_outlier"]


@query(OF, "branch_id:s model_type:s null_type:s rate_source:s numerically_usable:b is_significant:b ci_width:d small_sample:b poor_ci:b is_interpretable_nullifier:b", sql("""
select branch_id, model_type, null_type, rate_source, case when is_singular is null then case when error then false end else not error and converged_both and not is_singular end as numerically_usable, case when usable then sig end as is_significant, ci_width, small_sample, poor_ci, interpretable as is_interpretable_nullifier from p"""))
def results_prepared(df):
    return prep(df)


@query(OF, "model_type:s transformation:s effect_condition:s null_type:s n_total n_error n_converged n_singular n_usable pct_error:d pct_converged:d pct_singular:d pct_usable:d", sql(f"""
select *, 100.0 * n_error / n_total as pct_error, 100.0 * n_converged / nullif(n_ok, 0) as pct_converged, 100.0 * n_singular / nullif(n_ok, 0) as pct_singular, 100.0 * n_usable / n_total as pct_usable from (
  select {HEALTH_KEYS}, count(*) as n_total, count(case when error then 1 end) as n_error, count(case when not error then 1 end) as n_ok, count(case when converged_both and not error then 1 end) as n_converged, count(case when is_singular and not error then 1 end) as n_singular, count(case when usable then 1 end) as n_usable from p group by all)"""))
def results_branch_health(df):
    return tables.branch_health(prep(df))


@query(OF, "model_type:s null_type:s sample_size:d outlier:s transformation:s n_total n_usable n_subsamples pct_usable:d", sql(f"""
select {HEALTH_KEYS}, sample_size, outlier, count(*) as n_total, count(case when usable then 1 end) as n_usable, count(distinct subsample_id) as n_subsamples, 100.0 * count(case when usable then 1 end) / count(*) as pct_usable from p group by all"""))
def results_health_by_spec(df):
    return tables.branch_health_by_spec(prep(df))


@query(OF, "branch_id:s model_type:s problems:s main_estimate:d n_obs", sql("""
select branch_id, model_type, main_estimate, n_obs, concat(case when error then 'error;' else '' end, case when not error and not converged_both then 'non-converged;' else '' end, case when not error and is_singular then 'singular;' else '' end,
  case when poor_ci then 'wide-CI;' else '' end, case when small_sample then 'small-n;' else '' end) as problems from p where error or not converged_both or is_singular or poor_ci or small_sample"""))
def results_problems(df):
    return tables.problem_branches(prep(df))


@query(OF, "model_type:s transformation:s null_type:s n_usable mean_estimate:d median_estimate:d sd_estimate:d mad_estimate:d mean_se:d", sql(f"""
select {HEALTH_KEYS}, count(*) as n_usable, avg(main_estimate) as mean_estimate, median(main_estimate) as median_estimate, stddev_samp(main_estimate) as sd_estimate, 1.4826 * mad(main_estimate) as mad_estimate, avg(main_std_error) as mean_se from p where usable group by all"""))
def results_estimates(df):
    return tables.estimate_summary(prep(df))


@query(OF, "model_type:s transformation:s n detected power:d mean_p:d median_p:d mean_estimate:d sd_estimate:d", sql("""
select model_type, transformation, count(*) as n, count(case when sig then 1 end) as detected, count(case when sig then 1 end) / count(*) as power, avg(main_p_value) as mean_p, median(main_p_value) as median_p, avg(main_estimate) as mean_estimate, stddev_samp(main_estimate) as sd_estimate from p where usable and is_present group by all"""))
def results_power(df):
    return tables.power_tables(prep(df))["coarse"]


@query(OF, "model_type:s transformation:s sample_size:d n detected power:d mean_p:d", sql("""
select model_type, transformation, sample_size, count(*) as n, count(case when sig then 1 end) as detected, count(case when sig then 1 end) / count(*) as power, avg(main_p_value) as mean_p from p where usable and is_present group by all"""))
def results_power_by_sample(df):
    return tables.power_tables(prep(df))["by_sample_size"]


@query(OF, "model_type:s sample_size:d subsample_id outlier:s significant:b p_value:d estimate:d std_error:d", sql("""
select model_type, sample_size, subsample_id, outlier, sig as significant, main_p_value as p_value, main_estimate as estimate, main_std_error as std_error from p where usable and is_present"""))
def results_power_per_branch(df):
    return tables.power_tables(prep(df))["per_branch"]


@query(OF, "rate_label:s interpretable_fpr_source:b null_type:s model_type:s transformation:s n false_positives FPR:d mean_p:d median_p:d mean_estimate:d", sql(f"""
select {NULL_KEYS}, interpretable as interpretable_fpr_source, count(*) as n, count(case when sig then 1 end) as false_positives, count(case when sig then 1 end) / count(*) as FPR, avg(main_p_value) as mean_p, median(main_p_value) as median_p, avg(main_estimate) as mean_estimate from p where usable and is_null group by all"""))
def results_fpr(df):
    return tables.fpr_tables(prep(df))["coarse"]


@query(OF, "rate_label:s null_type:s model_type:s transformation:s sample_size:d outlier:s n false_positives FPR:d mean_estimate:d", sql(FPR))
def results_fpr_by_outlier(df):
    return fpr_by_outlier(df)


@query(OF, "rate_label:s null_type:s model_type:s sample_size:d outlier:s n_planned significant_primary usable_nonsignificant singular non_converged extraction_or_preprocessing_error other_invalid unconditional_rate:d conditional_rate:d error_rate:d", sql("""
select *, significant_primary / n_planned as unconditional_rate, significant_primary / nullif(significant_primary + usable_nonsignificant, 0) as conditional_rate, extraction_or_preprocessing_error / n_planned as error_rate from rates""", f"rates as ({RATES})"))
def results_failure_aware(df):
    return tables.failure_aware_rates(prep(df))


ROC_KEYS = "model_type, transformation, sample_size"


def roc_sql(keys: str) -> str:
    return f"""tpr as (select {keys}, count(*) as n_true, count(case when sig then 1 end) as detected, count(case when sig then 1 end) / count(*) as TPR from p where usable and is_present group by all),
fpr as (select {keys}, null_type, count(*) as n_null, count(case when sig then 1 end) as false_positives, count(case when sig then 1 end) / count(*) as FPR from p where usable and is_null group by all), roc as (select * from fpr left join tpr using ({keys}))"""


@query(OF, "model_type:s transformation:s sample_size:d null_type:s n_null false_positives FPR:d n_true detected TPR:d has_tpr:b youden_j:d DOR:d", sql("""
select *, TPR is not null as has_tpr, coalesce(TPR, 0) - FPR as youden_j, case when TPR is null or FPR is null then null when TPR = 0 then 0 when FPR = 0 or TPR = 1 or FPR = 1 then null else (TPR / (1 - TPR)) / (FPR / (1 - FPR)) end as DOR from roc""", roc_sql(ROC_KEYS)))
def results_roc(df):
    return report.roc_points(tables.roc(prep(df)))


def ratio_sql(x: str, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    """A ratio of polynomials, coefficients from the highest power down."""
    top, below = (" + ".join(f"{c!r} * pow({x}, {len(cs) - 1 - i})" for i, c in enumerate(cs)) for cs in parts)
    return f"(({top}) / ({below}))"


D_PRIME = f"""sides as (select model_type, transformation, sample_size, null_type, n_true is not null as paired, unnest(['t', 'f']) as side,
  unnest([least(greatest(coalesce(TPR, 0), 1 / (2 * n_true)), 1 - 1 / (2 * n_true)), least(greatest(FPR, 1 / (2 * n_null)), 1 - 1 / (2 * n_null))]) as x from roc),
far as (select *, x - 0.5 as q, sqrt(-ln(least(x, 1 - x))) as r from sides),
z as (select *, case when abs(q) <= 0.425 then q * {ratio_sql('(0.180625 - q * q)', stats.CENTRE)} else sign(q) * case when r <= 5 then {ratio_sql('(r - 1.6)', stats.MIDDLE)} else {ratio_sql('(r - 5)', stats.FAR)} end end as z from far)"""


@query(OF, "model_type:s transformation:s sample_size:d null_type:s d_prime:d", sql("""
select model_type, transformation, sample_size, null_type, case when bool_and(paired) then sum(case side when 't' then z else -z end) end as d_prime from z group by model_type, transformation, sample_size, null_type""", roc_sql(ROC_KEYS), D_PRIME))
def results_d_prime(df):
    return tables.roc(prep(df))


@query(OF, "model_type:s transformation:s sample_size:d outlier:s null_type:s FPR:d TPR:d tpr_gap:d utility_gap:d", sql("""
select *, 1 - TPR as tpr_gap, FPR + case when TPR is null then 0 else greatest(0, 1 - TPR) end as utility_gap from roc""", roc_sql(ROC_KEYS + ", outlier")))
def results_roc_by_outlier(df):
    return report.gaps(tables.roc_by_outlier(prep(df)))


@query(OF, "branch_id:s model_type:s outlier:s status:s significant:b p_value:d estimate:d ci_lower:d ci_upper:d", sql(CURVE))
def results_spec_curve(df):
    return tables.spec_curve(prep(df))


@query(OF, "model_type:s null_type:s transformation:s sample_size:d n_total n_usable n_subsamples n_sig n_nonsig pct_significant:d is_inconsistent:b pct_failed:d effect_cv:d p_range:d", sql("""
select *, n_usable - n_sig as n_nonsig, 100.0 * n_sig / nullif(n_usable, 0) as pct_significant, n_sig > 0 and n_usable - n_sig > 0 as is_inconsistent, 100.0 * (n_total - n_usable) / n_total as pct_failed, case when n_usable >= 2 and abs(m) > 1e-6 then s / abs(m) end as effect_cv, hi - lo as p_range from (
  select model_type, effect_condition, null_type, transformation, sample_size, count(*) as n_total, count(case when usable then 1 end) as n_usable, count(distinct case when usable then subsample_id end) as n_subsamples, count(case when usable and sig then 1 end) as n_sig,
    avg(case when usable then main_estimate end) as m, stddev_samp(case when usable then main_estimate end) as s, min(case when usable then main_p_value end) as lo, max(case when usable then main_p_value end) as hi from p group by all) where n_usable >= 2"""))
def results_inconsistency(df):
    return report.inconsistent_specs(tables.spec_inconsistency(prep(df)))


@query(OF, "outlier:s null_type:s n_total n_usable n_significant pct_usable:d pct_significant:d mean_estimate:d median_estimate:d mean_p:d", sql("""
select outlier, effect_condition, null_type, count(*) as n_total, count(case when usable then 1 end) as n_usable, count(case when usable and sig then 1 end) as n_significant, 100.0 * count(case when usable then 1 end) / count(*) as pct_usable, 100.0 * count(case when usable and sig then 1 end) / nullif(count(case when usable then 1 end), 0) as pct_significant,
  avg(case when usable then main_estimate end) as mean_estimate, median(case when usable then main_estimate end) as median_estimate, avg(case when usable then main_p_value end) as mean_p from p group by all"""))
def results_by_factor(df):
    return tables.by_factor(prep(df), ["outlier"])


@query(OF, "model_type:s transformation:s null_type:s n_total n_usable pct_usable:d pct_significant:d mean_effect:d sd_effect:d median_p:d metric_type:s", sql(f"""
select {HEALTH_KEYS}, count(*) as n_total, count(case when usable then 1 end) as n_usable, 100.0 * count(case when usable then 1 end) / count(*) as pct_usable, 100.0 * count(case when usable and sig then 1 end) / nullif(count(case when usable then 1 end), 0) as pct_significant, avg(case when usable then main_estimate end) as mean_effect,
  stddev_samp(case when usable then main_estimate end) as sd_effect, median(case when usable then main_p_value end) as median_p, case when effect_condition = 'present' then 'Power (TPR)' else 'FPR (' || null_type || ')' end as metric_type from p group by all"""))
def results_summary(df):
    return tables.summary_table(prep(df))


TRUTH = "select case when effect_condition = 'present' then 'present_location' else 'null_location' end as condition, case when effect_condition = 'present' then 0.05 else 0.0 end as truth_interaction_log, model, error, case when branch_idx % 19 = 0 then null else main_p_value end as p_value from results"


@query(OF, "truth_type:s condition:s truth_interaction_log:d model:s rate_name:s n_planned n_usable n_significant n_error n_missing_p unconditional_rate:d conditional_rate:d pct_missing_p:d", f"""
with t as ({TRUTH}) select *, n_significant / n_planned as unconditional_rate, n_significant / nullif(n_usable, 0) as conditional_rate, n_missing_p / n_planned as pct_missing_p from (
  select case when condition = 'null_location' then 'known_null' else 'known_alternative' end as truth_type, condition, truth_interaction_log, model, case when condition = 'null_location' then 'FPR' else 'TPR' end as rate_name, count(*) as n_planned,
    count(case when not error and p_value is not null then 1 end) as n_usable, count(case when not error and p_value < 0.05 then 1 end) as n_significant, count(case when error then 1 end) as n_error, count(case when not error and p_value is null then 1 end) as n_missing_p from t group by all)""")
def results_known_truth(df):
    p = F.when(F.col("branch_idx") % 19 != 0, F.col("main_p_value"))
    present = F.col("effect_condition") == "present"
    rows = df.select(F.when(present, "present_location").otherwise("null_location").alias("condition"), F.when(present, 0.05).otherwise(0.0).alias("truth_interaction_log"), "model", "error", p.alias("p_value"), (p < 0.05).alias("is_significant"))
    return tables.known_truth_rates(rows)


@query(OF, "table:s n_rows n_columns")
def results_all_tables(df):
    every = tables.run_all(df)
    return io.table_manifest(every)


@query(OF, "table:s n_rows", sql(f"""
select 'fpr_coarse' as "table", (select count(*) from (select distinct {NULL_KEYS} from p where usable and is_null)) as n_rows union all select 'failure_aware', (select count(*) from (select distinct {NULL_KEYS}, sample_size, outlier from p where is_null))"""))
def results_operating_tables(df):
    base = df.withColumn("data_id", F.concat_ws("__", "sample_size", "subsample_id", "transformation", "outlier", "effect_condition", "strip_method", "branch_id"))
    diags = base.select("data_id", "nullification_verdict")
    got = tables.operating_tables(base.drop("nullification_verdict"), diags)
    return io.table_manifest({k: got[k] for k in ("fpr_coarse", "failure_aware")})


@query(OF, "branch_id:s error:b error_message:s stage_completed:s main_estimate:d", """
select branch_id, error or branch_idx % 23 = 0 as error, case when branch_idx % 23 = 0 then 'no fit for this branch' end as error_message, case when branch_idx % 23 = 0 then 'planned' else 'fitted' end as stage_completed, case when branch_idx % 23 <> 0 then main_estimate end as main_estimate from results""")
def results_rows(df):
    fits = df.where("branch_idx % 23 <> 0").select("branch_id", "main_estimate", "main_std_error", "error")
    return io.latest_results(models.result_rows(df.select("branch_id", F.lit(1).alias("branch_idx"), "sample_size", "subsample_id", "transformation", "outlier", "model", "effect_condition", "strip_method"), fits))


@query(OF, "model:s n error:b", """
with h as (select model, model = 'rmanova' or (error and branch_idx % 2 = 0) as sep from results), r as (select model, count(*) as n, avg(cast(sep as int)) as rate from h group by model),
c as (select case when rate in (0, 1) then 'other_separated' else model end as model, n from r) select model, sum(n) as n, model = 'other_separated' as error from c group by model""")
def results_collapse_separated(df):
    held = df.withColumn("sep", (F.col("model") == "rmanova") | (F.col("error") & (F.col("branch_idx") % 2 == 0)))
    got = models.collapse_separated(held, "sep", "model")
    return got.groupBy("model").agg(F.count("*").alias("n")).withColumn("error", F.col("model") == "other_separated")


@query(OF, "effect_condition:s model_type:s transformation:s sample_size:d n hits", sql("""
select effect_condition, model_type, transformation, sample_size, count(*) as n, count(case when sig then 1 end) as hits from p where usable and sig is not null group by all"""))
def results_logit_patterns(df):
    """What the grid's regressions read: branches and detections of each combination."""
    p = prep(df).where("numerically_usable").withColumn("sig", F.col("main_p_value") < 0.05)
    return logit.covariate_patterns(p, "sig", ["effect_condition", "model_type", "transformation", "sample_size"])


@query(OF, "term:s model:s estimate:d odds_ratio:d base_rate:d n")
def results_grid_logit(df):
    p = prep(df).where("numerically_usable")
    fits = {k: logit.grid_logit(p.where(F.col("effect_condition") == k).withColumn("sig", F.col("main_p_value") < 0.05), "sig", "model_type + transformation + sample_size") for k in ("present", "null_interaction")}
    got = report.odds_ratio_table(fits)
    return got if got is not None else df.sparkSession.createDataFrame([], "term string, model string, estimate double, odds_ratio double, base_rate double, n long")


# --- reporting ---------------------------------------------------------------------------------------------------------

F0 = f"f as ({FPR})"
STRIPS = ["shuffle", "additive_qmap", "local_mean_residual"]


@query(OF, "model_type:s null_type:s sample_size:d outlier:s n FPR:d", sql("select * from f where interpretable and sample_size < 1 and n >= 3", F0))
def report_stable_primary(df):
    return report.stable_rows(report.primary_rows(fpr_by_outlier(df)), "n", 3)


@query(OF, "effect_condition:s branch_id:s rank estimate:d axis:s level:s", sql("""
select effect_condition, branch_id, rank, estimate, unnest(['model_type', 'transformation', 'outlier', 'sample_size']) as axis, unnest([model_type, transformation, outlier, cast(sample_size as varchar)]) as level
from (select *, row_number() over (partition by effect_condition order by estimate, branch_id) as rank from c where estimate is not null)""", f"c as ({CURVE})"))
def report_rank_specs(df):
    return report.rank_specs(tables.spec_curve(prep(df)), ["effect_condition"])


@query(OF, "model_type:s transformation:s shuffle:d additive_qmap:d local_mean_residual:d", sql(f"""
select model_type, transformation, {', '.join(f"sum(case when strip_method = '{s}' then FPR * n end) / sum(case when strip_method = '{s}' then n end) as {s}" for s in STRIPS)} from f group by all""", F0))
def report_strip_pivot(df):
    return report.strip_pivot(fpr_by_outlier(df), STRIPS)


@query(OF, "model_type:s transformation:s outlier:s strip_method:s n false_positives FPR:d", sql("select model_type, transformation, outlier, strip_method, sum(n) as n, sum(false_positives) as false_positives, sum(false_positives) / sum(n) as FPR from f group by all", F0))
def report_outlier_heatmap(df):
    return report.outlier_heatmap(fpr_by_outlier(df))


@query(OF, "model_type:s strip_method:s sample_size:d FPR_raw:d FPR_log:d delta_raw_minus_log:d", sql("""
select *, FPR_raw - FPR_log as delta_raw_minus_log from (select model_type, strip_method, sample_size, sum(case when transformation = 'no_log_rt' then false_positives end) / sum(case when transformation = 'no_log_rt' then n end) as FPR_raw,
  sum(case when transformation = 'log_rt' then false_positives end) / sum(case when transformation = 'log_rt' then n end) as FPR_log from f group by all) where FPR_raw is not null and FPR_log is not null""", F0))
def report_transform_delta(df):
    return report.transform_delta(fpr_by_outlier(df))


@query(OF, "model_type:s transformation:s null_type:s sample_size:d outlier:s n excess:d", sql("""
select *, FPR - 0.05 as excess from (select model_type, transformation, null_type, sample_size, outlier, sum(n) as n, sum(false_positives) / sum(n) as FPR from f group by all) order by round(FPR - 0.05, 9) desc, n desc, model_type, transformation, null_type, sample_size, outlier limit 18""", F0))
def report_extreme_combinations(df):
    return report.extreme_combinations(report.pooled_fpr(fpr_by_outlier(df), ["model_type", "transformation", "null_type", "sample_size", "outlier"]))


@query(OF, "axis:s level:s n FPR:d", sql(" union all ".join(f"select '{a}' as axis, cast({a} as varchar) as level, sum(n) as n, sum(false_positives) / sum(n) as FPR from f group by {a}" for a in report.AXES), F0))
def report_marginal_fpr(df):
    return report.marginal_fpr(fpr_by_outlier(df))


@query(OF, "model_type:s transformation:s sample_size:d outlier:s n power:d", sql("select model_type, transformation, sample_size, outlier, count(*) as n, avg(cast(sig as int)) as power from p where usable and is_present group by all"))
def report_power_heatmap(df):
    return report.power_heatmap(tables.power_tables(prep(df))["by_outlier"])


@query(OF, "model_type:s transformation:s null_type:s outcome:s percent:d", sql(f"""
select model_type, transformation, null_type, unnest(['pct_error', 'pct_usable', 'pct_converged', 'pct_singular']) as outcome, unnest([e, u, c, s]) as percent from (select {HEALTH_KEYS}, 100.0 * count(case when error then 1 end) / count(*) as e, 100.0 * count(case when usable then 1 end) / count(*) as u,
  100.0 * count(case when converged_both and not error then 1 end) / nullif(count(case when not error then 1 end), 0) as c, 100.0 * count(case when is_singular and not error then 1 end) / nullif(count(case when not error then 1 end), 0) as s from p group by all)"""))
def report_health_long(df):
    return report.health_long(tables.branch_health(prep(df)))


@query(OF, "model_type:s transformation:s sample_size:d null_type:s FPR:d power:d n_null n_present", sql("select *, TPR as power, n_true as n_present from roc where TPR is not null and FPR is not null", roc_sql(ROC_KEYS)))
def report_frontier(df):
    p = prep(df)
    pooled = report.pooled_fpr(tables.fpr_tables(p)["by_sample_size"], ["model_type", "transformation", "sample_size", "null_type"])
    return report.power_fpr_frontier(tables.power_tables(p)["by_sample_size"], pooled)


@query(OF, "model_type:s transformation:s outlier:s sample_size:d strip_method:s ratio:d", sql("""
select *, least(a / b, 2) as ratio from (select model_type, transformation, outlier, sample_size, strip_method, avg(abs(estimate)) as a from c where estimate is not null and effect_condition = 'null_interaction' group by all)
join (select model_type, transformation, outlier, sample_size, avg(abs(estimate)) as b from c where estimate is not null and effect_condition = 'present' group by all) using (model_type, transformation, outlier, sample_size) where b > 0""", f"c as ({CURVE})"))
def report_attenuation(df):
    return report.attenuation(tables.spec_curve(prep(df)))


@query(OF, "strip_method:s transformation:s nullification_verdict:s n", """
select strip_method, transformation, nullification_verdict, n from (select *, row_number() over (partition by strip_method, transformation order by n desc, nullification_verdict) as k from (select strip_method, transformation, nullification_verdict, count(*) as n from results group by all)) where k = 1""")
def report_verdict_matrix(df):
    return report.verdict_matrix(df, ["strip_method", "transformation"])


R0 = f"r as ({RATES})"


@query(OF, "model_type:s outcome:s n n_planned share:d", sql(f"""
select *, n / n_planned as share from (select model_type, sum(n_planned) as n_planned, unnest([{', '.join(f"'{o}'" for o in report.OUTCOMES)}]) as outcome, unnest([{', '.join(f'sum({o})' for o in report.OUTCOMES)}]) as n from r group by model_type)""", R0))
def report_composition(df):
    return report.composition_by_model(tables.failure_aware_rates(prep(df)))


@query(OF, "strip_method:s transformation:s sample_size:d nullification_verdict:s n share:d", """
select *, n / sum(n) over (partition by strip_method, transformation, sample_size) as share from (select strip_method, transformation, sample_size, nullification_verdict, count(*) as n from results group by all)""")
def report_verdict_share(df):
    return report.verdict_share(df)


@query(OF, "strip_method:s gate:s n n_branches share:d", """
with g as (select strip_method, unnest(case when branch_idx % 3 = 0 then ['a', 'b'] when branch_idx % 3 = 1 then ['b'] else [] end) as gate from results), t as (select strip_method, count(*) as n_branches from results group by all)
select strip_method, gate, count(*) as n, n_branches, count(*) / n_branches as share from g join t using (strip_method) group by strip_method, gate, n_branches""")
def report_gate_breakdown(df):
    text = F.when(F.col("branch_idx") % 3 == 0, "a;b").when(F.col("branch_idx") % 3 == 1, "b").otherwise("")
    return report.gate_breakdown(df.withColumn("preservation_warnings", text), ["strip_method"])


@query(OF, "strip_method:s metric:s median_abs:d p95_abs:d", """
select strip_method, unnest(['a_delta_from_present', 'b_delta_from_present']) as metric, unnest([median(abs(main_estimate)), median(abs(main_std_error))]) as median_abs, unnest([quantile_cont(abs(main_estimate), 0.95), quantile_cont(abs(main_std_error), 0.95)]) as p95_abs from results group by strip_method""")
def report_residual_deltas(df):
    return report.residual_deltas(df.select("strip_method", F.col("main_estimate").alias("a_delta_from_present"), F.col("main_std_error").alias("b_delta_from_present")))


@query(OF, "strip_method:s significant_primary n_planned n_usable unconditional_rate:d conditional_rate:d", sql("""
select strip_method, sum(significant_primary) as significant_primary, sum(n_planned) as n_planned, sum(significant_primary + usable_nonsignificant) as n_usable, sum(significant_primary) / sum(n_planned) as unconditional_rate, sum(significant_primary) / nullif(sum(significant_primary + usable_nonsignificant), 0) as conditional_rate from r group by all""", R0))
def report_conditional(df):
    return report.conditional_vs_unconditional(tables.failure_aware_rates(prep(df)), ["strip_method"])


@query(OF, "strip_method:s model_type:s FPR_all:d FPR_interpretable:d", sql("""
select strip_method, model_type, sum(false_positives) / sum(n) as FPR_all, sum(case when interpretable then false_positives end) / sum(case when interpretable then n end) as FPR_interpretable from f group by all""", F0))
def report_interpretable(df):
    return report.interpretable_vs_all(fpr_by_outlier(df))


@query(OF, "family:s strip_method:s n FPR:d", sql("""
select case when strip_method = 'shuffle' then 'permutation' when strip_method like '%qmap%' then 'distributional' else 'residual' end as family, strip_method, sum(n) as n, sum(false_positives) / sum(n) as FPR from f group by all""", F0))
def report_fpr_story(df):
    return report.fpr_story(fpr_by_outlier(df))


@query(OF, "strip_method:s rate:d", sql("select strip_method, sum(false_positives) / sum(n) as rate from f group by all", F0))
def report_pooled_rate(df):
    return report.pooled_rate(fpr_by_outlier(df).select("strip_method", F.col("FPR").alias("rate"), F.col("false_positives").alias("numerator"), F.col("n").alias("denominator"), "n"), ["strip_method"])


@query(OF, "sample_size:d label:s n FPR:d se:d", sql("""
select *, sqrt(FPR * (1 - FPR) / n) as se from (select sample_size, case strip_method when 'shuffle' then 'Shuffle' when 'additive_qmap' then 'Quantile map' when 'additive_qmap_trial_bin' then 'Quantile map (trial bins)' when 'local_mean_residual' then 'Local mean residual' else 'Local median residual' end as label,
  count(*) as n, avg(cast(sig as int)) as FPR from p where usable and is_null group by all)"""))
def report_fpr_with_se(df):
    got = report.fpr_with_se(prep(df), ["sample_size", "strip_method"])
    return got.withColumn("label", report.display_labels(F.col("strip_method")))


@query(OF, "branch_id:s sample_size:d subsample_id outlier:s strip_method:s", "select branch_id, sample_size, subsample_id, outlier, strip_method from results")
def report_data_id_parts(df):
    ids = F.concat_ws("__", F.col("sample_size").cast("string"), F.col("subsample_id").cast("string"), "transformation", "outlier", "effect_condition", "strip_method")
    return report.data_id_parts(df.select("branch_id", ids.alias("data_id"), F.when(F.col("branch_idx") % 2 == 0, F.col("outlier")).alias("outlier")))


@query(OF, "branch_id:s metric:s value:d", """
select branch_id, unnest(['main_estimate', 'main_p_value']) as metric, unnest([main_estimate, main_p_value]) as value from results where main_estimate is not null""")
def report_wide_profile(df):
    return report.wide_profile(df.select("branch_id", "model", "main_estimate", "main_p_value").drop("model"), ["branch_id"])


@query(OF, "data_id:s preservation_status:s metric:s value:d", """
select branch_id as data_id, case when branch_idx % 3 = 0 then 'pass' when branch_idx % 3 = 1 then 'fail' else 'unknown' end as preservation_status, unnest(['mean_cse', 'q050_cse']) as metric, unnest([main_estimate, main_std_error]) as value from results""")
def report_dashboard(df):
    ok = F.when(F.col("branch_idx") % 3 == 0, True).when(F.col("branch_idx") % 3 == 1, False)
    return report.dashboard_residuals(df.select(F.col("branch_id").alias("data_id"), "strip_method", ok.alias("preservation_pass"), F.col("main_estimate").alias("mean_cse"), F.col("main_std_error").alias("q050_cse")))


@query(OF, "effect_condition:s transformation:s bin n", sql("select effect_condition, transformation, least(floor(main_p_value * 20), 19) as bin, count(*) as n from p where usable and main_p_value is not null group by all"))
def report_pvalue_histogram(df):
    return report.pvalue_histogram(prep(df))


@query(OF, "effect_condition:s transformation:s n q0050:d q0250:d q0500:d q0750:d q0950:d", sql(f"""
select effect_condition, transformation, count(*) as n, {', '.join(f'quantile_cont(main_estimate, {q}) as q{int(q * 1000):04d}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))} from p where usable group by all"""))
def report_estimate_distribution(df):
    return report.estimate_distribution(prep(df))


@query(OF, "effect_condition:s branch_id:s rank extreme:b clamped:f", sql("""
select c.effect_condition, branch_id, row_number() over (partition by c.effect_condition order by estimate, branch_id) as rank, abs(estimate) > t as extreme, least(greatest(estimate, lo), hi) as clamped from c join (
  select effect_condition, quantile_cont(abs(estimate), 0.99) as t, quantile_cont(estimate, 0.01) as lo, quantile_cont(estimate, 0.99) as hi from c where estimate is not null group by 1) q using (effect_condition) where estimate is not null""", f"c as ({CURVE})"))
def report_extreme_specs(df):
    return report.extreme_specs(tables.spec_curve(prep(df)), ["effect_condition"])


@query(OF, "branch_id:s decision:s abs_estimate:d", sql("select branch_id, case when significant then 'significant' when not significant then 'not_significant' else 'not_usable' end as decision, abs(estimate) as abs_estimate from c", f"c as ({CURVE})"))
def report_decision_map(df):
    return report.decision_map(tables.spec_curve(prep(df)))


@query(OF, "outlier:s metric:s value:d", """
select outlier, unnest(['match_rate', 'preserved_rate', 'pass_rate', 'median_abs_slope']) as metric, unnest([avg(cast(branch_idx % 4 = 0 as int)), avg(cast(full_converged as int)), avg(cast(null_converged as int)), median(abs(main_estimate))]) as value from results group by outlier""")
def report_shuffle_summary(df):
    checks = df.select("outlier", (F.col("branch_idx") % 4).alias("n_count_mismatch"), F.col("full_converged").alias("preserved"), F.col("null_converged").alias("pass"), F.col("main_estimate").alias("conditional_prev_slope"))
    return report.shuffle_summary(checks, ["outlier"])


@query(OF, "metric:s strip_method:s median_abs:d p95_abs:d metric_max:d", """
with l as (select strip_method, unnest(['mean_cse', 'q050_cse']) as metric, unnest([abs(main_estimate), abs(main_std_error)]) as v from results), g as (select metric, strip_method, median(v) as median_abs, quantile_cont(v, 0.95) as p95_abs from l group by all)
select * from (select *, max(p95_abs) over (partition by metric) as metric_max from g) order by round(metric_max, 9) desc nulls last, metric, strip_method limit 24""")
def report_metric_summary(df):
    long = df.select("strip_method", F.inline(F.array(F.struct(F.lit("mean_cse").alias("metric"), F.abs("main_estimate").alias("abs_cse_value")), F.struct(F.lit("q050_cse").alias("metric"), F.abs("main_std_error").alias("abs_cse_value")))))
    return report.metric_summary(long)


DEFS = "select strip_method, transformation, sample_size, outlier, case when branch_idx % 3 = 0 then 'near_zero' else 'present' end as distributional_flag, abs(main_estimate) as max_abs_location_cse, case when branch_idx % 5 = 0 then null else main_std_error end as max_abs_distributional_cse from results"


def definitions(df: DataFrame) -> DataFrame:
    flag = F.when(F.col("branch_idx") % 3 == 0, "near_zero").otherwise("present").alias("distributional_flag")
    return df.select("strip_method", "transformation", "sample_size", "outlier", flag, F.abs("main_estimate").alias("max_abs_location_cse"), F.when(F.col("branch_idx") % 5 != 0, F.col("main_std_error")).alias("max_abs_distributional_cse"))


@query(OF, "strip_method:s distributional_flag:s n share:d", f"with d as ({DEFS}) select *, n / sum(n) over (partition by strip_method) as share from (select strip_method, distributional_flag, count(*) as n from d group by all)")
def report_flag_share(df):
    return report.flag_share(definitions(df))


@query(OF, "strip_method:s outlier:s max_abs_location_cse:d max_abs_distributional_cse:d distributional_flag:s", f"with d as ({DEFS}) select * from d where max_abs_location_cse is not null and max_abs_distributional_cse is not null")
def report_location_vs_shape(df):
    return report.location_vs_shape(definitions(df))


@query(OF, "branch_id:s conditional_prev_slope:d present_prev_slope:d change:d", "select branch_id, main_estimate as conditional_prev_slope, main_std_error as present_prev_slope, main_estimate - main_std_error as change from results where branch_idx % 5 <> 0")
def report_paired_slopes(df):
    return report.paired_slopes(df.select("branch_id", F.col("main_estimate").alias("conditional_prev_slope"), F.when(F.col("branch_idx") % 5 != 0, F.col("main_std_error")).alias("present_prev_slope")))


@query(OF, "model:s n main_estimate:f stages:s", "select model, count(*) as n, sum(main_estimate) as main_estimate, 'fitted' as stages from results group by model", dealt=True)
def io_results_again(df):
    """Results written twice, and those of one model also by an earlier run with other numbers: a branch counts once, with its latest row."""
    path, spark = scratch(df.sparkSession), df.sparkSession
    df = saved(df)
    full = df.withColumns({"timestamp": F.lit("2024-02-01 00:00:00").cast("timestamp"), "stage_completed": F.lit("fitted")})
    full = full.select(*(F.col(f.name) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA))
    first = io.write_results(full, path, stored=True)
    early = full.where("model = 'rmanova'").withColumns({"timestamp": F.lit("2024-01-01 00:00:00").cast("timestamp"), "main_estimate": F.lit(0.0), "stage_completed": F.lit("planned")})
    io.write_results(early, path, run="early")
    io.write_results(full, path, run=first)
    return io.load_results(spark, path).groupBy("model").agg(F.count("*").alias("n"), F.sum("main_estimate").alias("main_estimate"), F.max("stage_completed").alias("stages"))
