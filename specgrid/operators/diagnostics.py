"""Diagnostics of data branches: what is left of the interaction, and what a nullifier has changed besides.

Every operator takes trials with the branch's key columns and gives one row for each branch; statistics per participant come
first and are averaged after. The unit of every window is a participant within a branch. Metrics are of valid trials: a finite
time above 0 and both codes. A participant or branch without any has no row of its own in a metric (null once joined).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgrid.functions.order import grouped_quantiles, medians, quantiles
from specgrid.operators.nullify import contrast
from specgrid.sources.scratch import saved, spread

#: Codes of the cells.
CELLS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)
QUANTILE_NAMES = ("q010_cse", "q025_cse", "q050_cse", "q075_cse", "q090_cse")
#: Metrics that are compared with the present branch's: fixed names.
DELTAS = ("current_cong_effect", "previous_cong_effect", "lag1_autocorr_mean", "trial_rt_slope_mean", "block_mean_sd", "transition_imbalance", "post_error_slowing", "max_abs_timebin_q050_cse", "mean_cse", *QUANTILE_NAMES)
#: What a gate reads, its largest absolute value and its label: fixed names.
GATES = (
    ("mean_cse", 5.0, "residual_mean_cse_gt_5ms"),
    ("q050_cse", 5.0, "residual_median_quantile_cse_gt_5ms"),
    ("current_cong_effect_delta_from_present", 5.0, "current_cong_effect_delta_gt_5ms"),
    ("previous_cong_effect_delta_from_present", 5.0, "previous_cong_effect_delta_gt_5ms"),
    ("lag1_autocorr_mean_delta_from_present", 0.05, "lag1_autocorr_delta_gt_0.05"),
    ("trial_rt_slope_mean_delta_from_present", 0.05, "trial_slope_delta_gt_0.05ms"),
    ("block_mean_sd_delta_from_present", 10.0, "block_mean_sd_delta_gt_10ms"),
    ("transition_imbalance_delta_from_present", 0.01, "transition_imbalance_delta_gt_0.01"),
    ("max_abs_timebin_q050_cse", 10.0, "timebin_median_quantile_cse_gt_10ms"),
    ("post_error_slowing_delta_from_present", 10.0, "post_error_slowing_delta_gt_10ms"),
)


def is_valid() -> Column:
    fine = F.col("rt").isNotNull() & ~F.isnan("rt") & (F.col("rt") > 0) & (F.col("rt") < float("inf"))
    return F.coalesce(fine, F.lit(False)) & F.col("cong").isNotNull() & F.col("prev_cong").isNotNull()


def valid(df: DataFrame) -> DataFrame:
    return df.where(is_valid())


def rt() -> Column:
    """The time of a valid trial, else null."""
    return F.when(is_valid(), F.col("rt"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def cell(c: int, p: int) -> Column:
    return (F.col("cong") == c) & (F.col("prev_cong") == p)


def participant_cse(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., participant_id, cse): contrast of cell means, null if a cell is missing."""
    return valid(df).groupBy(*by, "participant_id").agg(contrast({c: F.avg(F.when(cell(*c), F.col("rt"))) for c in CELLS}).alias("cse"))


def cse_summary(df: DataFrame, by: list[str]) -> DataFrame:
    each = participant_cse(df, by).groupBy(*by)
    return each.agg(F.avg("cse").alias("mean_cse"), F.median("cse").alias("median_cse"), F.max(F.abs("cse")).alias("max_abs_cse"), F.count_if(F.col("cse").isNull()).alias("n_incomplete"))


def cell_shares() -> list[Column]:
    """Each cell's share of the valid trials, among the cells whose two codes both occur; an empty one of these has 0."""
    n = lambda cond: F.count(F.when(is_valid() & cond, 1))
    occur = {(name, code): n(F.col(name) == code) > 0 for name in ("cong", "prev_cong") for code in (1, -1)}
    return [F.when(occur["cong", c] & occur["prev_cong", p], n(cell(c, p)) / n(F.lit(True))) for c, p in CELLS]


def pooled(df: DataFrame, by: list[str], approximate: int | None = None) -> DataFrame:
    """Statistics over a branch's trials: contrasts of pooled cell quantiles, least cell count, main effects, error slowing, counts.

    approximate: accuracy of percentile_approx instead of exact quantiles.
    """
    side = lambda name: F.avg(F.when(F.col(name) == 1, rt())) - F.avg(F.when(F.col(name) == -1, rt()))
    seen = cell_shares()
    got = df.groupBy(*by).agg(
        F.least(*(F.count(F.when(cell(*c), rt())) for c in CELLS)).alias("cell_min_n"), side("cong").alias("current_cong_effect"), side("prev_cong").alias("previous_cong_effect"),
        (F.avg(F.when(~F.col("prev_correct"), rt())) - F.avg(F.when(F.col("prev_correct"), rt()))).alias("post_error_slowing"),
        (F.greatest(*seen) - F.least(*seen)).alias("transition_imbalance"),
        F.count("*").alias("n_rows"), F.count(rt()).alias("n_valid"), F.count_distinct(F.when(is_valid(), F.col("participant_id"))).alias("n_participants"), F.count_distinct(F.when(is_valid(), F.col("study"))).alias("n_studies"),
    )
    keys = [*by, "cong", "prev_cong"]
    good = valid(df).select(*keys, F.col("rt").alias("value"))
    own = quantiles(good, keys, PROBS) if approximate is None else good.groupBy(*keys).agg(F.percentile_approx("value", list(PROBS), approximate).alias("quantiles"))
    at = lambda i: contrast({c: F.max(F.when(cell(*c), F.col("quantiles")[i])) for c in CELLS})
    curves = own.groupBy(*by).agg(*(at(i).alias(n) for i, n in enumerate(QUANTILE_NAMES)))
    return got.join(curves, by, "left")


def lag1_autocorrelation(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean over participants (3 trials and some spread at least) of the correlation of each time with the one before."""
    own = Window.partitionBy(*by, "participant_id").orderBy(F.col("trial_index").asc_nulls_last(), "source_row")
    pairs = valid(df).withColumn("__before", F.lag("rt").over(own))
    each = pairs.groupBy(*by, "participant_id").agg(F.count("*").alias("n"), F.stddev_samp("rt").alias("sd"), F.corr("__before", "rt").alias("r"))
    return each.groupBy(*by).agg(F.avg(F.when((F.col("n") >= 3) & (F.col("sd") > 0) & is_finite(F.col("r")), F.col("r"))).alias("lag1_autocorr_mean"))


def trial_slope(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean over participants (two different trials at least) of the least-squares slope of time on trial."""
    trial = F.col("trial_index").cast("double")
    each = valid(df).groupBy(*by, "participant_id").agg((F.max(trial) > F.min(trial)).alias("two"), F.regr_slope("rt", trial).alias("slope"))
    return each.groupBy(*by).agg(F.avg(F.when(F.col("two") & is_finite(F.col("slope")), F.col("slope"))).alias("trial_rt_slope_mean"))


def block_spread(df: DataFrame, by: list[str], unit: str = "participant_id") -> DataFrame:
    """Standard deviation of the means of (unit, block)."""
    return valid(df).groupBy(*by, unit, "block_index").agg(F.avg("rt").alias("m")).groupBy(*by).agg(F.stddev_samp("m").alias("block_mean_sd"))


def source_rows_monotonic(df: DataFrame, by: list[str], order: str = "trial_index") -> DataFrame:
    """(by..., n_falls, source_row_monotonic): whether no participant's source rows fall when read in the given order (a DataFrame has none of its own)."""
    own = Window.partitionBy(*by, "participant_id").orderBy(F.col(order).asc_nulls_last(), "source_row")
    falls = df.withColumn("__falls", F.coalesce(F.col("source_row") < F.lag("source_row").over(own), F.lit(False)))
    return falls.groupBy(*by).agg(F.count_if("__falls").alias("n_falls")).withColumn("source_row_monotonic", F.col("n_falls") == 0)


def source_rows_kept(present: DataFrame, branch: DataFrame) -> DataFrame:
    """One row: whether the branch holds the same source rows (a DataFrame has no order to keep)."""
    a, b = present.select("source_row"), branch.select("source_row")
    lost, new = a.join(b, "source_row", "left_anti").agg(F.count("*").alias("n_lost")), b.join(a, "source_row", "left_anti").agg(F.count("*").alias("n_new"))
    return lost.crossJoin(new).withColumn("kept", (F.col("n_lost") == 0) & (F.col("n_new") == 0))


def time_bin_contrast(df: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """Largest absolute contrast of cell medians in `bins` bins of trial_index, cut at pooled quantiles (right-closed, equal cuts merged); null below `bins` different trials."""
    shares, good = [i / bins for i in range(1, bins)], valid(df).where("trial_index is not null")
    # counted values: a branch has as many rows here as it has different trials
    counted = good.groupBy(*by, "trial_index").agg(F.count("*").alias("__n"))
    edges = counted.groupBy(*by).agg(F.percentile(F.col("trial_index").cast("double"), shares, F.col("__n")).alias("__edges"), F.count("*").alias("__trials")).where(F.col("__trials") >= bins)
    # a row for each branch
    edges = F.broadcast(saved(edges))
    at = good.join(edges, by) if by else good.crossJoin(edges)
    binned = at.withColumn("__bin", F.size(F.filter(F.array_distinct("__edges"), lambda e: e < F.col("trial_index"))))
    keys = [*by, "__bin", "cong", "prev_cong"]
    own = medians(binned.select(*keys, F.col("rt").alias("value")), keys)
    each = own.groupBy(*by, "__bin").agg(contrast({c: F.max(F.when(cell(*c), F.col("median"))) for c in CELLS}).alias("d"))
    return each.groupBy(*by).agg(F.max(F.abs("d")).alias("max_abs_timebin_q050_cse"))


#: The sums of a block over valid trials: y the time, x the one before it, t the trial.
SUMS = (
    {f"{k}_{name}_{i}": f"{f}(if({name} = {v}, y, null))" for k, f in (("n", "count"), ("s", "sum")) for name in ("cong", "prev_cong") for i, v in enumerate((1, -1))}
    | {f"{k}_cell_{i}": f"{f}(if(cong = {c} and prev_cong = {p}, y, null))" for k, f in (("n", "count"), ("s", "sum")) for i, (c, p) in enumerate(CELLS)}
    | {f"{k}_error_{i}": f"{f}(if(prev_correct = {v}, y, null))" for k, f in (("n", "count"), ("s", "sum")) for i, v in enumerate(("false", "true"))}
    | {"n_rows": "count(*)", "n": "count(y)", "y": "sum(y)", "falls": "count_if(falls)"}
    | {"p_n": "count(x)", "p_x": "sum(x)", "p_y": "sum(if(x is null, null, y))", "p_xx": "sum(x * x)", "p_yy": "sum(if(x is null, null, y * y))", "p_xy": "sum(x * y)"}
    | {"t_n": "count(t)", "t_t": "sum(t)", "t_y": "sum(if(t is null, null, y))", "t_tt": "sum(t * t)", "t_ty": "sum(t * y)"}
)
ENDS = {f"{c}_{f}": f"{f}({x})" for c, x in (("y", "y"), ("t", "t"), ("p_x", "x"), ("p_y", "if(x is null, null, y)")) for f in ("min", "max")}


def block_sums(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., participant_id, block_index, sums...): everything that the diagnostics add up, for each block of a participant, in one shuffle of the trials."""
    own = Window.partitionBy(*by, "participant_id").orderBy(F.col("trial_index").asc_nulls_last(), "source_row")
    rows = df.select(
        *by, "participant_id", "block_index", "cong", "prev_cong", "prev_correct", rt().alias("y"), F.last(rt(), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("last"),
        F.when(is_valid(), F.col("trial_index").cast("double")).alias("t"), (F.col("source_row") < F.lag("source_row").over(own)).alias("falls"),
    ).withColumn("x", F.expr("if(y is null, null, last)"))
    return rows.groupBy(*by, "participant_id", "block_index").agg(*(F.expr(f"{x} as {k}") for k, x in (SUMS | ENDS).items()))


def participant_sums(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The sums of blocks for each participant, with contrast (cse), correlation of each time with the one before (r) and slope of time on trial."""
    got = blocks.groupBy(*by, "participant_id").agg(*(F.expr(f"sum({k}) as {k}") for k in SUMS), *(F.expr(f"{k[-3:]}({k}) as {k}") for k in ENDS))
    xx, yy, xy = (f"(p_n * p_{c} - p_{c[0]} * p_{c[1]})" for c in ("xx", "yy", "xy"))
    got = got.withColumns({
        "cse": F.expr("try_divide(s_cell_0, n_cell_0) - try_divide(s_cell_1, n_cell_1) - try_divide(s_cell_2, n_cell_2) + try_divide(s_cell_3, n_cell_3)"),
        "r": F.expr(f"if(n >= 3 and y_min < y_max and p_x_min < p_x_max and p_y_min < p_y_max and {xx} > 0 and {yy} > 0, {xy} / (sqrt({xx}) * sqrt({yy})), null)"),
        "slope": F.expr("if(t_min < t_max, (t_n * t_ty - t_t * t_y) / (t_n * t_tt - t_t * t_t), null)"),
    })
    return got.withColumns({c: F.when(is_finite(F.col(c)), F.col(c)) for c in ("r", "slope")})


def summed_diagnostics(df: DataFrame, by: list[str], studies: DataFrame) -> DataFrame:
    """Every diagnostic of a branch but its quantiles, from sums of blocks; studies has (by..., studies), the sorted studies of a branch's valid trials."""
    blocks = saved(block_sums(df, by))
    means = blocks.groupBy(*by).agg(F.stddev_samp(F.when(F.col("n") > 0, F.col("y") / F.col("n"))).alias("block_mean_sd"))
    people = participant_sums(blocks, by)
    total = [k for k in SUMS if k[:2] in ("n_", "s_") and k != "n_rows"]
    got = people.groupBy(*by).agg(
        *(F.expr(f"sum({c}) as {c}") for c in (*total, "n_rows", "n", "falls")), F.expr("count_if(n > 0) as n_participants"),
        F.expr("avg(cse) as mean_cse"), F.expr("median(cse) as median_cse"), F.expr("max(abs(cse)) as max_abs_cse"), F.expr("count_if(n > 0 and cse is null) as n_incomplete"),
        F.expr("avg(r) as lag1_autocorr_mean"), F.expr("avg(slope) as trial_rt_slope_mean"),
    )
    mean = lambda k: f"try_divide(s_{k}, n_{k})"
    shares = ", ".join(f"if(n_cong_{(1 - c) // 2} > 0 and n_prev_cong_{(1 - p) // 2} > 0, n_cell_{i} / n, null)" for i, (c, p) in enumerate(CELLS))
    metrics = {k: F.expr(x) for k, x in {
        "cell_min_n": "least(n_cell_0, n_cell_1, n_cell_2, n_cell_3)", "current_cong_effect": f"{mean('cong_0')} - {mean('cong_1')}", "previous_cong_effect": f"{mean('prev_cong_0')} - {mean('prev_cong_1')}",
        "post_error_slowing": f"{mean('error_0')} - {mean('error_1')}", "transition_imbalance": f"greatest({shares}) - least({shares})", "n_valid": "n", "n_studies": "size(studies)",
        "studies": "concat_ws(';', studies)", "source_row_monotonic": "falls = 0", "n_incomplete": "if(n > 0, n_incomplete, null)",
    }.items()}
    got = got.join(studies, by, "left").withColumn("studies", F.coalesce("studies", F.array().cast("array<string>")))
    return got.withColumns(metrics).drop(*total, "n", "falls").join(means, by)


def branch_diagnostics(df: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """Every diagnostic of every branch, with a text of warnings.

    The trials are written to the scratch folder. One shuffle of them makes the sums of blocks from which all but the
    quantiles follow; a histogram of all branches, time bins and cells at once, and the buckets of it in which ranks lie, make those.
    """
    df = saved(df.select(*dict.fromkeys([*by, "participant_id", "study", "source_row", "trial_index", "block_index", "cong", "prev_cong", "rt", "prev_correct"])))
    # a number stands for the keys of a branch
    branches = saved(df.select(*by).distinct().coalesce(1).withColumn("__branch", F.monotonically_increasing_id()))
    named = branches.withColumnsRenamed({c: f"__of_{c}" for c in by})
    rows = df.join(F.broadcast(named), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by), F.lit(True))).drop(*by, *named.columns[:-1]) if by else df.withColumn("__branch", F.lit(0).cast("long"))
    if "study" in by:
        rows = rows.join(F.broadcast(branches.select("__branch", "study")), "__branch")
    good = valid(rows)
    # counted values: how often each trial occurs in each study of a branch
    counted = saved(good.groupBy("__branch", F.col("study").cast("string").alias("study"), F.col("trial_index").cast("double").alias("trial")).agg(F.count("*").alias("n")))
    sums = summed_diagnostics(rows, ["__branch"], counted.groupBy("__branch").agg(F.sort_array(F.collect_set("study")).alias("studies")))
    times = counted.where("trial is not null").groupBy("__branch", "trial").agg(F.sum("n").alias("n"))
    edges = times.groupBy("__branch").agg(F.percentile("trial", [i / bins for i in range(1, bins)], F.col("n")).alias("edges"), F.count("*").alias("trials")).where(F.col("trials") >= bins)
    # a column for each different edge: sums of comparisons are compiled, functions over arrays are not
    cuts = [f"__cut_{i}" for i in range(bins - 1)]
    edges = edges.select("__branch", F.array_distinct("edges").alias("edges")).select("__branch", F.lit(True).alias("__cut"), *(F.get("edges", F.lit(i)).alias(c) for i, c in enumerate(cuts)))
    place = sum((F.coalesce((F.col(c) < F.col("trial_index")).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    binned = good.select("__branch", "trial_index", "cong", "prev_cong", F.col("rt").alias("value")).join(F.broadcast(saved(edges)), "__branch", "left")
    binned = binned.withColumn("bin", F.when(F.col("__cut") & F.col("trial_index").isNotNull(), place)).drop("__cut", *cuts, "trial_index")
    whole, parts = grouped_quantiles(binned, [(["__branch", "cong", "prev_cong"], PROBS), (["__branch", "bin", "cong", "prev_cong"], (0.5,))])
    at = lambda i: contrast({c: F.max(F.when(cell(*c), F.col("quantiles")[i])) for c in CELLS})
    curves = whole.groupBy("__branch").agg(*(at(i).alias(n) for i, n in enumerate(QUANTILE_NAMES)))
    over_time = parts.where("bin is not null").groupBy("__branch", "bin").agg(at(0).alias("d")).groupBy("__branch").agg(F.max(F.abs("d")).alias("max_abs_timebin_q050_cse"))
    got = sums.join(curves, "__branch", "left").join(over_time, "__branch", "left")
    got = branches.join(got, "__branch").drop("__branch")
    dropped = F.col("n_rows") - F.col("n_valid")
    warn = F.array_compact(F.array(
        F.when(dropped > 0, F.concat(F.lit("dropped_invalid_rows="), dropped.cast("string"))),
        F.when(F.coalesce(F.col("n_incomplete") > 0, F.lit(True)), "incomplete_participant_cells"),
        F.when(F.col("mean_cse").isNull(), "no_finite_participant_cse"), F.when(F.col("cell_min_n") == 0, "missing_pooled_cell"),
    ))
    return got.withColumn("warnings", F.concat_ws(";", warn))


def preservation_gates(diags: DataFrame) -> DataFrame:
    """diags with 14 differences from the present branch of the same sample, transformation and outlier rule, the gates that fail, and the verdict."""
    key = ["sample_size", "subsample_id", "transformation", "outlier"]
    ref = diags.where("effect_condition = 'present' and strip_method = 'none'").select(*(F.col(c).alias(f"__{c}") for c in key), *(F.col(c).alias(f"__ref_{c}") for c in DELTAS), F.lit(True).alias("__paired"))
    got = diags.join(ref, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left")
    null = (F.col("effect_condition") != "present") & F.col("__paired").isNotNull()
    got = got.withColumns({f"{c}_delta_from_present": F.when(null, F.col(c) - F.col(f"__ref_{c}")) for c in DELTAS})
    fails = [F.when(is_finite(F.col(c)) & (F.abs(F.col(c)) > most), label) for c, most, label in GATES]
    text = F.concat_ws(";", F.array_compact(F.array(*fails)))
    got = got.withColumns({"preservation_warnings": F.when(null, text).otherwise(""), "preservation_pass": F.when(null, text == "")})
    verdict = F.when(null & F.col("preservation_pass"), "interpretable_nullifier").when(null, "fails_preservation_gates").when(F.col("effect_condition") == "present", "reference_present").otherwise("unpaired")
    scale = F.when(F.col("transformation") == "log_rt", "log").otherwise("ms")
    return got.withColumns({"nullification_verdict": verdict, "scale": scale}).drop(*(f"__{c}" for c in key), *(f"__ref_{c}" for c in DELTAS), "__paired")


def exchangeability(df: DataFrame) -> DataFrame:
    """Order and balance diagnostics for each study, with the standing advice on shuffling; the imbalance is null unless all codes occur. Trials without a block count in none."""
    by, df = ["study"], valid(df).where("cong in (-1, 1) and prev_cong in (-1, 1)")
    share = cell_shares()
    every = reduce(lambda a, b: a & b, [s.isNotNull() for s in share])
    balance = df.groupBy(*by).agg(
        F.count_distinct("participant_id").alias("n_participants"), F.count("*").alias("n_rows"), F.when(every, F.greatest(*(F.abs(s - 0.25) for s in share))).alias("transition_imbalance"),
        (F.avg(F.when(~F.col("prev_correct"), F.col("rt"))) - F.avg(F.when(F.col("prev_correct"), F.col("rt")))).alias("post_error_slowing"),
    )
    blocks = block_spread(df.where("block_index is not null"), by, "study").withColumnRenamed("block_mean_sd", "block_sd")
    parts = [balance, lag1_autocorrelation(df, by), trial_slope(df, by), blocks]
    got = reduce(lambda a, b: a.join(b, by, "left"), parts)
    return got.withColumns({"unrestricted_shuffle_plausible": F.lit(False), "recommendation": F.lit("do_not_use_as_primary_counterfactual")})


def multiset_compare(present: DataFrame, shuffled: DataFrame, by: list[str] | None = None, digits: int = 10) -> DataFrame:
    """(by..., n_groups, n_count_mismatch, n_value_mismatch, preserved) over groups of (participant, cong): counts of equal values on both sides, no arrays."""
    by = by or []
    keys = [*by, "participant_id", "cong"]
    side = lambda df, a: df.select(*keys, F.round("rt", digits).alias("v"), F.lit(a).alias("of_a"))
    # both sides in one list, dealt out by value too: no join, and no group in one task
    both = spread(side(present, 1).unionByName(side(shuffled, 0)), "participant_id", "cong", "v")
    both = both.groupBy(*keys, "v").agg(F.sum("of_a").alias("a"), F.sum(1 - F.col("of_a")).alias("b"))
    groups = both.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("off"))
    got = groups.groupBy(*by).agg(F.count("*").alias("n_groups"), F.count(F.when(F.col("na") != F.col("nb"), 1)).alias("n_count_mismatch"), F.count(F.when(F.col("off") > 0, 1)).alias("n_value_mismatch"))
    return got.withColumn("preserved", F.col("n_value_mismatch") == 0)


def rt_fingerprint(df: DataFrame, keys: list[str], digits: int = 10) -> DataFrame:
    """(keys..., fingerprint): count and two sums of 60-bit hashes of the group's values, a missing one included.

    Sums don't depend on order and add up over parts of a group, so none is ever sorted or held in one place.
    """
    digest = F.md5(F.coalesce(F.round("rt", digits).cast("string"), F.lit("NA")).cast("binary"))
    total = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*keys).agg(F.concat_ws("-", F.count("*").cast("string"), total(1), total(16)).alias("fingerprint"))


def conditional_previous_slope(df: DataFrame, by: list[str]) -> DataFrame:
    """Slope of time on prev_cong after both are centred within (participant, cong), over finite times with a previous code.

    Null below four such trials, with one code only, or if no group has both codes.
    """
    own = Window.partitionBy(*by, "participant_id", "cong")
    good = spread(df.where(is_finite(F.col("rt")) & F.col("prev_cong").isin(-1, 1)), *by, "participant_id", "cong")
    x, y = F.col("prev_cong") - F.avg("prev_cong").over(own), F.col("rt") - F.avg("rt").over(own)
    sums = good.withColumns({"x": x, "y": y}).groupBy(*by).agg(
        F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.count("*").alias("n"), (F.min("prev_cong") < F.max("prev_cong")).alias("both")
    )
    enough = (F.col("n") >= 4) & F.col("both") & (F.col("xx") > 0)
    return sums.select(*by, F.when(enough, F.col("xy") / F.col("xx")).alias("conditional_prev_slope"))


def shuffle_check(trials: DataFrame, most: float = 5.0) -> DataFrame:
    """For every shuffle branch (4 sample keys): same multisets as the present branch, slopes of both, pass; a branch without its present partner is an error."""
    key = ["sample_size", "subsample_id", "transformation", "outlier"]
    # written once, as every part below reads them
    trials = saved(trials.where("strip_method in ('none', 'shuffle')").select(*key, "strip_method", "participant_id", "cong", "prev_cong", "rt"))
    present, shuffled = trials.where("strip_method = 'none'"), trials.where("strip_method = 'shuffle'")
    branches = saved(trials.select(*key, "strip_method").distinct())
    wanted = branches.where("strip_method = 'shuffle'").select(*key)
    have = branches.where("strip_method = 'none'").select(*key, F.lit(True).alias("has_present"))
    same = multiset_compare(present.join(F.broadcast(wanted), key, "left_semi"), shuffled, key)
    each = saved(conditional_previous_slope(trials, [*key, "strip_method"]))
    of = lambda method: each.where(F.col("strip_method") == method).drop("strip_method")
    slopes = of("shuffle").join(of("none").withColumnRenamed("conditional_prev_slope", "present_prev_slope"), key, "left")
    got = wanted.join(have, key, "left").join(same, key, "left").join(slopes, key, "left").withColumn("error", F.col("has_present").isNull())
    passed = ~F.col("error") & F.col("preserved") & (F.abs("conditional_prev_slope") <= most)
    return got.withColumn("pass", F.coalesce(passed, F.lit(False))).drop("has_present")


#: Family of each metric: fixed names.
FAMILIES = {"mean_cse": "location", "median_cse": "distributional", **dict.fromkeys(QUANTILE_NAMES, "distributional"), "max_abs_timebin_q050_cse": "time_local_distributional"}


def cse_long(diags: DataFrame) -> DataFrame:
    """A row for each branch and metric, with the metric's family and absolute value."""
    ids = [c for c in ("data_id", "effect_condition", "strip_method", "sample_size", "outlier", "transformation", "nullification_verdict", "preservation_pass") if c in diags.columns]
    long = diags.unpivot(ids, [m for m in FAMILIES if m in diags.columns], "metric", "cse_value")
    family = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return long.withColumns({"definition_family": family[F.col("metric")], "abs_cse_value": F.abs("cse_value")})


def cse_definitions(diags: DataFrame) -> DataFrame:
    """Per group: location against distributional and time-local contrasts, and a four-way flag (10 and 5 ms)."""
    keys = ["effect_condition", "strip_method", "sample_size", "outlier", "transformation", "nullification_verdict", "preservation_pass"]
    of = lambda family: F.max(F.when(F.col("definition_family") == family, F.col("abs_cse_value")))
    got = cse_long(diags).groupBy(*keys).agg(
        F.count_distinct("data_id").alias("n_branches"), F.avg(F.when(F.col("metric") == "mean_cse", F.col("cse_value"))).alias("location_mean_cse"),
        of("distributional").alias("max_abs_distributional_cse"), of("time_local_distributional").alias("max_abs_time_local_distributional_cse"),
    )
    got = got.withColumn("max_abs_location_cse", F.abs("location_mean_cse"))
    spread, near = F.col("max_abs_distributional_cse"), F.abs("location_mean_cse") <= 5
    flag = (
        F.when(spread.isNull(), "missing_distributional_metrics").when((spread > 10) & near, "distributional_residual_without_location_cse")
        .when((spread <= 10) & near, "location_and_distributional_near_zero").otherwise("location_cse_present")
    )
    return got.withColumns({
        "distribution_minus_location_abs": spread - F.col("max_abs_location_cse"),
        "time_local_minus_location_abs": F.col("max_abs_time_local_distributional_cse") - F.col("max_abs_location_cse"), "distributional_flag": flag,
    })
