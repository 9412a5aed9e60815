"""Audits of a trial table, and checks that return violations instead of stopping at the first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
#: Studies that supply their own previous-trial fields.
SUPPLIED = ("yang", "primeprobe", "flanker")
MISSING = ("", "NA", "NaN", "NULL")
#: Confounds of a sequence effect, the columns that speak to each, and its status while the first of them is there.
CONFOUNDS = (
    ("previous congruency", ("prev_cong",), "available_but_recompute_required"),
    ("previous accuracy/post-error slowing", ("prev_correct",), "available_but_recompute_required"),
    ("current accuracy filtering", ("correct",), "available"),
    ("trial index/fatigue/practice trend", ("trial_index", "is_practice"), "available"),
    ("block effects", ("block_index", "name", "condition"), "available_study_specific"),
    ("practice trials", ("is_practice", "name"), "available_study_sparse"),
    ("stimulus identity/repetition", (), "insufficient"),
    ("response identity/repetition", (), "missing"),
    ("feature/event-file integration", (), "missing"),
    ("contingency learning/item-specific proportion congruency", (), "missing"),
    ("study-specific affect/conflict condition", ("condition", "congruency", "name"), "available_study_sparse"),
)
#: Shares of missing rows up to which a column counts as whole, or as thin.
WHOLE, THIN = 0.01, 0.5


def normalize_missing(column: Column) -> Column:
    """Text with the tokens for missing as null."""
    text = F.trim(column.cast("string"))
    return F.when(~text.isin(*MISSING), text)


def study_of(pid: Column) -> Column:
    return F.regexp_extract(pid, r"_([^_]*)$", 1)


def mismatch(a: Column, b: Column) -> Column:
    """Null-safe: two nulls match, one null doesn't."""
    return ~a.eqNullSafe(b)


def canonical_previous(df: DataFrame, supplied: tuple[str, ...] = SUPPLIED) -> DataFrame:
    """df with canonical_prev_cong, canonical_prev_correct and canonical_is_first_trial: lags by participant, except where a study supplies its own."""
    w = Window.partitionBy("participant_id").orderBy("study", "block_index", "trial_index", "source_row")
    keep = F.col("study").isin(*supplied) if supplied else F.lit(False)
    return df.withColumns({
        "canonical_prev_cong": F.when(keep, F.col("prev_cong")).otherwise(F.lag("cong").over(w)),
        "canonical_prev_correct": F.when(keep, F.col("prev_correct")).otherwise(F.lag("correct").over(w)), "canonical_is_first_trial": F.row_number().over(w) == 1,
    })


def n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def previous_audit(df: DataFrame) -> DataFrame:
    """Per participant: mismatches with the canonical fields, bad times, missing codes, least cell."""
    df = canonical_previous(df)
    cells = [n((F.col("cong") == c) & (F.col("prev_cong") == p)) for c, p in CELLS]
    got = df.groupBy("study", "participant_id").agg(
        F.count("*").alias("rows"), n(F.col("rt").isNull() | F.isnan("rt")).alias("missing_rt"), n((F.col("rt") <= 0)).alias("nonpositive_rt"),
        n(mismatch(F.col("prev_cong"), F.col("canonical_prev_cong"))).alias("prev_cong_mismatch"), n(mismatch(F.col("prev_correct"), F.col("canonical_prev_correct"))).alias("prev_correct_mismatch"),
        n(F.col("prev_cong").isNull()).alias("missing_prev_cong"), F.least(*cells).alias("min_cell_n"),
    )
    return got.withColumns({"complete_four_cells": F.col("min_cell_n") > 0, "prev_cong_mismatch_rate": F.col("prev_cong_mismatch") / F.col("rows"), "prev_correct_mismatch_rate": F.col("prev_correct_mismatch") / F.col("rows")})


def design_inventory(df: DataFrame) -> DataFrame:
    """Per study: the participants' sums as rates, and the least and median of their least cells."""
    per = previous_audit(df)
    rate = lambda c: (F.sum(c) / F.sum("rows")).alias(f"{c}_rate")
    return per.groupBy("study").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("participants"), n(F.col("complete_four_cells")).alias("complete_participants"),
        *(rate(c) for c in ("missing_rt", "nonpositive_rt", "prev_cong_mismatch", "prev_correct_mismatch", "missing_prev_cong")),
        F.min("min_cell_n").alias("min_cell_n"), F.median("min_cell_n").alias("median_cell_n"),
    )


def column_inventory(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, missing values, distinct values, studies with values, and the five smallest values, all from one pass over the columns stacked.

    Distinct values are counted once each after a first grouping, so no column's values meet in one set.
    """
    stacked = F.array(*(F.struct(F.lit(c).alias("column"), normalize_missing(F.col(c)).alias("value")) for c in columns))
    long = df.select("study", F.inline(stacked))
    base = long.groupBy("column").agg(F.count("*").alias("rows"), n(F.col("value").isNull()).alias("n_missing"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("study"))).alias("studies_present"))
    values = long.where("value is not null").groupBy("column", "value").agg(F.lit(1).alias("one"))
    first = values.withColumn("at", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where("at <= 5")
    examples = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "; ").alias("examples"))
    got = base.join(values.groupBy("column").agg(F.count("*").alias("n_distinct")), "column", "left").join(examples, "column", "left").fillna({"n_distinct": 0, "examples": ""})
    return got.withColumn("missing_rate", F.col("n_missing") / F.col("rows"))


def confound_risk(inventory: DataFrame) -> DataFrame:
    """(confound, columns, column, status, n_columns, n_present, missing_rate, worst_rate, risk): what the table holds on each confound.

    A confound without a column of its own keeps its status; of the others those whose key column isn't in the inventory are missing.
    The sparse study conditions count as such whether the column is there or not. risk is made from what was measured: the
    share of rows without the key column, and how many of the confound's columns are there at all.
    """
    rows = [(name, "; ".join(columns), list(columns), columns[0] if columns else None, status, not columns or name.startswith("study-specific")) for name, columns, status in CONFOUNDS]
    known = inventory.sparkSession.createDataFrame(rows, "confound string, columns string, each array<string>, column string, held string, always boolean")
    rates = inventory.select("column", "missing_rate")
    seen = known.select("confound", F.explode("each").alias("column")).join(rates, "column").groupBy("confound").agg(F.count("*").alias("n_present"), F.max("missing_rate").alias("worst_rate"))
    got = known.join(rates, "column", "left").join(seen, "confound", "left").withColumns({"n_columns": F.size("each"), "n_present": F.coalesce("n_present", F.lit(0))})
    status = F.when(F.col("always") | F.col("missing_rate").isNotNull(), F.col("held")).otherwise("missing")
    rate, share = F.col("missing_rate"), F.concat(F.round(F.col("missing_rate") * 100, 1).cast("string"), F.lit("% of rows lack "), F.col("column"))
    risk = (
        F.when(F.col("n_present") == 0, F.concat(F.lit("nothing measured on "), "confound"))
        .when(rate.isNull(), F.concat("column", F.lit(" not there, "), F.col("n_present").cast("string"), F.lit(" other column(s)")))
        .when(rate <= WHOLE, F.concat(F.lit("can be conditioned on: "), share)).when(rate <= THIN, F.concat(F.lit("conditioning loses rows: "), share)).otherwise(F.concat(F.lit("mostly unknown: "), share))
    )
    return got.withColumn("status", status).select("confound", "columns", "column", "status", "n_columns", "n_present", "missing_rate", "worst_rate", risk.alias("risk"))


def check_required(df: DataFrame, columns: list[str]) -> None:
    """Raises at planning time if columns are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def violation(df: DataFrame, check: str, bad: Column, example: Column | None = None) -> DataFrame:
    """(check, n_bad, examples): one row, up to ten examples; distinct ones are grouped before they are gathered."""
    held = df.where(bad)
    count = held.agg(F.lit(check).alias("check"), F.count("*").alias("n_bad"))
    if example is None:
        return count.withColumn("examples", F.lit(""))
    some = held.select(example.cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(10)
    return count.crossJoin(some.agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("examples")))


def check_codes(df: DataFrame, column: str, allow_na: bool = False) -> DataFrame:
    bad = ~F.coalesce(F.col(column).isin(-1, 1), F.lit(False))
    return violation(df, f"codes_{column}", bad & F.col(column).isNotNull() if allow_na else bad, F.col(column))


def check_rt(df: DataFrame, slow: float = 5000.0) -> DataFrame:
    """(check, n_bad): missing, not-positive and not-finite times, and slow ones."""
    rt = F.col("rt")
    kinds = {"rt_missing": rt.isNull(), "rt_nonpositive": rt <= 0, "rt_nonfinite": F.isnan(rt) | (F.abs(rt) == float("inf")), "rt_slow": (rt > slow) & ~F.isnan(rt) & (rt < float("inf"))}
    wide = df.agg(*(n(c).alias(k) for k, c in kinds.items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in kinds)))).withColumn("examples", F.lit(""))


def check_trial_order(df: DataFrame) -> DataFrame:
    """Participants with a null or falling trial_index in source order."""
    w = Window.partitionBy("participant_id").orderBy("source_row")
    bad = F.col("trial_index").isNull() | (F.col("trial_index") < F.lag("trial_index").over(w))
    return df.withColumn("__bad", bad).groupBy("participant_id").agg(F.bool_or(F.coalesce("__bad", F.lit(False))).alias("bad")).where("bad").select("participant_id")


def check_log_rt(df: DataFrame) -> DataFrame:
    return violation(df, "log_rt_undefined", F.col("rt") <= 0)


def check_cells(df: DataFrame, min_n: int = 1) -> DataFrame:
    """Participants with a missing or sparse cell."""
    cells = [n((F.col("cong") == c) & (F.col("prev_cong") == p) & F.col("rt").isNotNull()) for c, p in CELLS]
    return df.groupBy("participant_id").agg(F.least(*cells).alias("least")).where(F.col("least") < min_n).select("participant_id", "least")


def validate_trials(df: DataFrame, min_cell: int = 1, allow_na_prev: bool = True, log_rt: bool = False, strict: bool = False) -> DataFrame:
    """All violations together as (check, n_bad, examples), checks without any left out; strict raises instead."""
    check_required(df, ["participant_id", "cong", "prev_cong", "rt", "trial_index"])
    people = lambda bad, name: bad.agg(F.lit(name).alias("check"), F.count("*").alias("n_bad")).withColumn("examples", F.lit(""))
    parts = [check_codes(df, "cong"), check_codes(df, "prev_cong", allow_na_prev), check_rt(df), people(check_trial_order(df), "trial_order"), people(check_cells(df, min_cell), "cells")]
    parts += [check_log_rt(df)] if log_rt else []
    found = reduce(DataFrame.unionByName, parts).where("n_bad > 0")
    if strict and (bad := found.limit(20).collect()):
        raise ValueError("; ".join(f"{r['check']}: {r['n_bad']}" for r in bad))
    return found


def branch_contract(branches: DataFrame, n_base: int, n_transforms: int, n_outliers: int, n_variants: int, n_models: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rule, n_bad): labels that don't go together, ids that repeat, and counts other than the axes call for."""
    data = n_base * n_transforms * n_outliers * n_variants
    wrong = ((F.col("effect_condition") == "present") & (F.col("strip_method") != "none")) | ((F.col("effect_condition") == "null_interaction") & (F.col("strip_method") == "none"))
    ids = branches.groupBy(*by, "branch_id").count().groupBy(*by).agg(n(F.col("count") > 1).alias("repeated_ids"))
    sums = branches.groupBy(*by).agg(n(wrong).alias("labels"), F.abs(F.count("*") - data * n_models).alias("rows"), F.abs(F.count_distinct("data_id") - data).alias("data_ids"))
    wide = sums.join(ids, list(by)) if by else sums.crossJoin(ids)
    return wide.select(*by, F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("n_bad")) for k in ("labels", "rows", "data_ids", "repeated_ids")))))


def branch_coverage(branches: DataFrame, done: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    held = branches.join(done.select(*by, "branch_id").distinct().withColumn("__done", F.lit(True)), [*by, "branch_id"], "left")
    return held.groupBy(*by).agg(F.count("*").alias("expected"), n(F.col("__done")).alias("present"), n(F.col("__done").isNull()).alias("missing"))


def attach_data_id(results: DataFrame, branches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Results with their data_id; a result without a branch, or a branch id that repeats, is marked in id_problem."""
    ids = branches.groupBy(*by, "branch_id").agg(F.min("data_id").alias("data_id"), F.count("*").alias("__n"))
    got = results.drop("data_id").join(ids, [*by, "branch_id"], "left")
    return got.withColumn("id_problem", F.when(F.col("__n").isNull(), "absent").when(F.col("__n") > 1, "repeated")).drop("__n")
