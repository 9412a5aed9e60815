"""Study exports into one trial table: previous-trial fields, block indexes and the eligibility filter.

Every window is over one participant and ends its order in source_row, so results don't depend on how rows arrive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUE, FALSE = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")
CELLS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
MIN_OVERALL, MIN_BLOCK, MIN_RATIO = 0.70, 0.70, 0.5


def boolish(column: Column) -> Column:
    """true, t, yes, y, 1 and their opposites in any case; anything else is null."""
    low = F.lower(F.trim(column.cast("string")))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def coded(column: Column) -> Column:
    """-1 for incongruent, +1 for anything else, null for null."""
    return F.when(column.isNull(), None).when(column == "incongruent", -1).otherwise(1).cast("int")


def own(*order: str):
    return Window.partitionBy("participant_id").orderBy(*order, "source_row")


def suffixed(raw: DataFrame, pid: str, study: str) -> DataFrame:
    return raw.withColumns({"participant_id": F.concat_ws("_", F.col(pid).cast("string"), F.lit(study)), "study": F.lit(study)})


def adapt_zeng(raw: DataFrame, pid: str = "participant", study: str = "zeng") -> DataFrame:
    """Columns trial_index, congruency, correct, rt, source_row: previous fields are those of the trial before."""
    df = suffixed(raw, pid, study)
    w = own("trial_index")
    return df.withColumns({"prev_cong": coded(F.lag("congruency").over(w)), "prev_correct": F.lag("correct").over(w), "cong": coded(F.col("congruency"))})


def block_by_change(df: DataFrame, column: str = "condition", order: str = "trial_index") -> DataFrame:
    """block_index = 1 + the changes of a column so far."""
    w = own(order)
    changed = F.coalesce((F.col(column) != F.lag(column).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__changed", changed).withColumn("block_index", 1 + F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")


def block_by_marker(df: DataFrame, marker: Column, order: str = "trial_index") -> DataFrame:
    """block_index = 1 + the markers so far, counted before any filter."""
    w = own(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("block_index", 1 + F.sum(F.coalesce(marker.cast("int"), F.lit(0))).over(w))


def adapt_zhang(raw: DataFrame, pid: str = "participant", study: str = "zhang") -> DataFrame:
    """Columns condition, is_response, correct, rt, block_index, name: no_conflict is +1, low and high conflict -1; previous fields after non-responses are dropped."""
    df = suffixed(raw, pid, study).where("is_response")
    cong = F.when(F.col("condition") == "no_conflict", 1).when(F.col("condition").isin("low_conflict", "high_conflict"), -1).cast("int")
    df = df.withColumn("cong", cong)
    w = own("trial_index")
    return df.withColumns({"prev_cong": F.lag("cong").over(w), "prev_correct": F.lag("correct").over(w), "is_practice": F.col("name") == "practice"})


def feedback_class(stimulus: Column) -> Column:
    """Feedback by the first marker that its markup holds."""
    return (
        F.when(stimulus.contains(">✘</div>"), "visual_punishment").when(stimulus.contains("&#11036"), "neutral")
        .when(stimulus.contains("✘<br>"), "monetary_loss").when(stimulus.contains("✔"), "tickmark")
    )


def adapt_yang(raw: DataFrame, pid: str = "participant", study: str = "yang") -> DataFrame:
    """Columns task, stimulus, congruency, correct, rt, feedback_type, name: lags count all rows, of which the probes are kept afterwards."""
    w = own("trial_index")
    df = suffixed(raw, pid, study).withColumn("feedback", feedback_class(F.col("stimulus")))
    probe = F.col("task") == "probe"
    df = df.withColumns({
        "prev_feedback": F.when(probe, F.lag("feedback", 4).over(w)).otherwise(""), "prev_correct": F.lag("correct", 5).over(w), "__prev": F.lag("congruency", 5).over(w),
        "block_feedback_type": F.lead("feedback_type").over(w),
    })
    df = df.where(probe).withColumns({"prev_loss": (F.col("prev_feedback") == "monetary_loss").cast("int"), "prev_cong": coded(F.col("__prev")), "cong": coded(F.col("congruency")), "is_practice": F.col("name") == "practice"})
    return block_by_missing_prev(df).drop("__prev")


def block_by_missing_prev(df: DataFrame, order: str = "trial_index") -> DataFrame:
    """block_index = the rows so far without both previous fields."""
    w = own(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("block_index", F.sum((F.col("prev_cong").isNull() & F.col("prev_correct").isNull()).cast("int")).over(w))


def adapt_supplied_prev(raw: DataFrame, study: str, pid: str = "participant") -> DataFrame:
    """Studies that supply prev_cong: trial_index is the row's number, prev_correct is lagged, the first trial is marked."""
    df = suffixed(raw, pid, study)
    w = own()
    return df.withColumn("trial_index", F.row_number().over(w).cast("long")).withColumns({"prev_correct": F.lag("correct").over(w), "is_first_trial": F.row_number().over(w) == 1})


def union_studies(studies: list[DataFrame]) -> DataFrame:
    """All studies by column name, types settled; source_row must be unique within a study."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), studies)
    kinds = {"participant_id": "string", "rt": "double", "cong": "int", "prev_cong": "int", "trial_index": "long", "block_index": "long"}
    df = df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in df.columns})
    flags = {f"{c}_bool": boolish(F.col(c)) for c in ("correct", "prev_correct") if c in df.columns}
    practice = F.coalesce(boolish(F.col("is_practice")), F.lit(False)) if "is_practice" in df.columns else F.lit(False)
    return df.withColumns(flags | {"is_practice_bool": practice})


def first_in_block(df: DataFrame) -> DataFrame:
    """df with is_first_trial_block: the first trial of each study, participant and block."""
    order = (F.coalesce("block_index", F.lit(0)), F.coalesce("trial_index", "source_row"), "source_row")
    return df.withColumn("is_first_trial_block", F.row_number().over(Window.partitionBy("study", "participant_id", "block_index").orderBy(*order)) == 1)


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., accuracy, n_trials) without practice and unknown answers."""
    base = df.where(~F.col("is_practice_bool") & F.col("correct_bool").isNotNull())
    return base.groupBy(*by).agg(F.avg(F.col("correct_bool").cast("int")).alias("accuracy"), F.count("*").alias("n_trials"))


def block_instability(blocks: DataFrame, least: float = MIN_BLOCK) -> DataFrame:
    return blocks.groupBy("study", "participant_id").agg(F.min("accuracy").alias("min_block_accuracy"), F.bool_or(F.col("accuracy") < least).alias("any_block_below"))


def exclusion_reasons(overall: DataFrame, blocks: DataFrame, least: float = MIN_OVERALL) -> DataFrame:
    """Per participant: two flags and their reasons as text; one without block data is excluded."""
    got = overall.join(blocks, ["study", "participant_id"], "left")
    low, unstable = F.col("accuracy") < least, F.coalesce("any_block_below", F.lit(True))
    reason = F.concat_ws(";", F.array_compact(F.array(F.when(low, "low_overall_accuracy"), F.when(unstable, "unstable_block_accuracy"))))
    return got.withColumns({"exclude_low_overall_accuracy": low, "exclude_unstable_block_accuracy": unstable, "exclude_pre_cell": low | unstable, "pre_cell_exclusion_reason": reason})


def eligible_trials(df: DataFrame, people: DataFrame) -> DataFrame:
    """Correct trials after correct ones, not practice nor first in a block, with a finite positive rt and both codes, of participants that are known and not excluded."""
    kept = people.where(~F.col("exclude_pre_cell")).select("study", "participant_id")
    fine = ~F.col("is_practice_bool") & F.col("correct_bool") & F.col("prev_correct_bool") & ~F.col("is_first_trial_block")
    rt = F.col("rt")
    fine = fine & (rt > 0) & ~F.isnan(rt) & (rt < float("inf")) & F.col("cong").isNotNull() & F.col("prev_cong").isNotNull()
    return df.where(fine).join(kept, ["study", "participant_id"], "left_semi")


def cell_counts_complete(df: DataFrame) -> DataFrame:
    """(study, participant_id, cong, prev_cong, cell_n) with zero rows for missing cells: four counts side by side, then stacked."""
    wide = df.groupBy("study", "participant_id").agg(*(F.count(F.when((F.col("cong") == c) & (F.col("prev_cong") == p), 1)).alias(f"n{i}") for i, (c, p) in enumerate(CELLS)))
    rows = F.array(*(F.struct(F.lit(c).alias("cong"), F.lit(p).alias("prev_cong"), F.col(f"n{i}").alias("cell_n")) for i, (c, p) in enumerate(CELLS)))
    return wide.select("study", "participant_id", F.inline(rows))


def cell_balance(counts: DataFrame, least: float = MIN_RATIO) -> DataFrame:
    got = counts.groupBy("study", "participant_id").agg(F.min("cell_n").alias("min_cell_n"), F.max("cell_n").alias("max_cell_n"))
    got = got.withColumn("cell_ratio", F.when(F.col("max_cell_n") > 0, F.col("min_cell_n") / F.col("max_cell_n")).otherwise(0.0)).withColumn("complete", F.col("min_cell_n") > 0)
    return got.withColumn("balanced", F.col("complete") & (F.col("cell_ratio") >= least))


def filter_summary(people: DataFrame, balance: DataFrame) -> DataFrame:
    """Per participant: what excludes it, all reasons joined."""
    got = people.join(balance, ["study", "participant_id"], "left")
    odd = ~F.col("exclude_pre_cell") & ~F.coalesce("balanced", F.lit(False))
    reason = F.concat_ws(";", F.array_compact(F.array(F.when(F.col("pre_cell_exclusion_reason") != "", F.col("pre_cell_exclusion_reason")), F.when(odd, "imbalanced_condition_cells"))))
    return got.withColumns({"exclude_imbalanced": odd, "excluded": F.col("exclude_pre_cell") | odd, "exclusion_reason": reason})


def final_eligible(eligible: DataFrame, summary: DataFrame) -> DataFrame:
    return eligible.join(summary.where(~F.col("excluded")).select("study", "participant_id"), ["study", "participant_id"], "left_semi")


def filter_funnel(df: DataFrame, people: DataFrame, summary: DataFrame) -> DataFrame:
    """(filter_stage, study, n_rows, n_participants): one scan, each row exploded into the stages it reaches."""
    stage = people.select("study", "participant_id", F.col("exclude_pre_cell").alias("__pre")).join(summary.select("study", "participant_id", F.col("excluded").alias("__out")), ["study", "participant_id"], "left")
    rt = F.col("rt")
    fine = F.coalesce(~F.col("is_practice_bool") & F.col("correct_bool") & F.col("prev_correct_bool") & ~F.col("is_first_trial_block") & (rt > 0) & ~F.isnan(rt) & (rt < float("inf")) & F.col("cong").isNotNull() & F.col("prev_cong").isNotNull(), F.lit(False))
    got = df.join(stage, ["study", "participant_id"], "left")
    pre = fine & ~F.coalesce("__pre", F.lit(True))
    stages = F.array_compact(F.array(F.lit("unfiltered_indexed"), F.when(~F.col("is_practice_bool"), "non_practice"), F.when(pre, "trial_filtered_pre_cell"), F.when(pre & ~F.coalesce("__out", F.lit(True)), "final_cse_eligible")))
    return got.select("study", "participant_id", F.explode(stages).alias("filter_stage")).groupBy("filter_stage", "study").agg(F.count("*").alias("n_rows"), F.count_distinct("participant_id").alias("n_participants"))
