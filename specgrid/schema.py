"""Fixed schemas: trials, and the 61 columns of a branch's result."""

from __future__ import annotations

from pyspark.sql import types as T

TRIAL_FIELDS = {
    "study": T.StringType(), "participant_id": T.StringType(), "source_row": T.LongType(), "trial_index": T.LongType(), "block_index": T.LongType(),
    "cong": T.IntegerType(), "prev_cong": T.IntegerType(), "rt": T.DoubleType(), "correct": T.BooleanType(), "prev_correct": T.BooleanType(),
}
TRIALS_SCHEMA = T.StructType([T.StructField(n, t) for n, t in TRIAL_FIELDS.items()])

#: Columns of a branch's result, in order: fixed names.
RESULT_COLUMNS = (
    "branch_id string, branch_idx bigint, sample_size double, subsample_id int, transformation string, outlier string, model string, effect_condition string, strip_method string,"
    " n_obs int, null_n_obs int, n_participants int, full_converged boolean, null_converged boolean, full_is_singular boolean, null_is_singular boolean,"
    " full_repca_min_sd double, null_repca_min_sd double, AIC_diff double, BIC_diff double, LR_stat double, LR_df int, LR_p double,"
    " main_estimate double, null_main_estimate double, main_std_error double, null_std_error double, main_t_stat double, null_t_stat double, main_p_value double, null_main_p_value double,"
    " effect_size double, null_effect double, effect_ci_lower double, null_effect_ci_lower double, effect_ci_upper double, null_effect_ci_upper double,"
    " random_intercept_var double, null_random_intercept_var double, random_slope_var double, null_random_slope_var double, random_cong_slope_var double, null_random_cong_slope_var double,"
    " random_prev_cong_slope_var double, null_random_prev_cong_slope_var double, random_cse_slope_var double, null_random_cse_slope_var double, residual_var double, null_residual_var double,"
    " loglik_full double, loglik_null double, npar_full int, npar_null int, fallback_level string, fallback_formula string, fallback_p_value double, inference_source string,"
    " error boolean, error_message string, stage_completed string, timestamp timestamp"
)
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
RESULTS_SCHEMA = T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (c.split() for c in RESULT_COLUMNS.split(","))])
